"""Graph, routing, clustering and calibration queries over the taxonomy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.functions.vectors import centroids, dot, sums
from canopyrank.operators import graph as G
from canopyrank.plans.base import DAG, LEAVES, TREE, VEC, dag_edges, r6, tree_edges, vectors
from canopyrank.plans.registry import register
from canopyrank.session import table


def _tree(body):
    return f"WITH RECURSIVE {TREE}, up AS (SELECT c AS node, c AS anc, 0 AS d FROM ed UNION ALL SELECT 'root', 'root', 0 UNION ALL SELECT node, p, d + 1 FROM up JOIN ed ON c = anc) {body}"


def _dag(body):
    return f"WITH RECURSIVE {DAG}, nd AS (SELECT c AS node FROM ed UNION SELECT p FROM ed), up AS (SELECT node, node AS anc, 0 AS d FROM nd UNION SELECT node, p, d + 1 FROM up JOIN ed ON c = anc), cl AS (SELECT node, anc, min(d) AS d FROM up GROUP BY ALL), dp AS (SELECT node, d AS depth FROM cl WHERE anc = 'root') {body}"


@register("grf01_ancestor_closure", _tree("SELECT DISTINCT node, anc, d FROM up"))
def grf01(spark, sf):
    return G.closure(tree_edges(spark, sf))


@register("grf02_dag_ancestors", _dag("SELECT node, anc, d FROM cl WHERE d > 0"))
def grf02(spark, sf):
    return G.closure(dag_edges(spark, sf)).filter("d > 0")


@register("grf03_tree_only_ancestors", _dag("SELECT c.node, c.anc FROM (WITH RECURSIVE t AS (SELECT node, node AS anc FROM nd UNION SELECT node, p FROM t JOIN ed ON c = anc AND kind = 'TREE') SELECT * FROM t) c WHERE node <> anc"))
def grf03(spark, sf):
    return G.closure(dag_edges(spark, sf).filter("kind = 'TREE'")).filter("d > 0").select("node", "anc")


@register("grf04_subtree_nodes", _dag("SELECT anc AS node, count(*) AS size FROM cl GROUP BY anc"))
def grf04(spark, sf):
    return G.closure(dag_edges(spark, sf)).groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("size"))


_LCA_PAIRS = "pr AS (SELECT 'p' || p_partkey AS x, 'p' || (p_partkey + 1) AS y FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part))"


@register("grf05_lowest_common_ancestor", _dag(f", {_LCA_PAIRS} SELECT x, y, lca, depth FROM (SELECT x, y, a.anc AS lca, depth, row_number() OVER (PARTITION BY x, y ORDER BY depth DESC, a.anc) AS k FROM pr JOIN cl a ON a.node = x JOIN cl b ON b.node = y AND a.anc = b.anc JOIN dp ON dp.node = a.anc) WHERE k = 1"))
def grf05(spark, sf):
    e = dag_edges(spark, sf)
    reach = G.closure(e)
    p = table(spark, sf, "part").select("p_partkey")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"))
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    pairs = p.join(nxt, "p_partkey").select(name(F.col("p_partkey")).alias("x"), name(F.col("p_partkey") + 1).alias("y"))
    return G.lowest_common(pairs, reach.select("node", "anc"), reach.filter("anc = 'root'").select("node", F.col("d").alias("depth")))


@register("grf06_tree_lca", _tree(", dp AS (SELECT node, d AS depth FROM up WHERE anc = 'root'), pr AS (SELECT 's' || s_suppkey AS x, 's' || (s_suppkey + 1) AS y FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)) SELECT x, y, max_by(a.anc, depth) AS lca, max(depth) AS depth FROM pr JOIN up a ON a.node = x JOIN up b ON b.node = y AND a.anc = b.anc JOIN dp ON dp.node = a.anc GROUP BY x, y"))
def grf06(spark, sf):
    reach = G.closure(tree_edges(spark, sf))
    s = table(spark, sf, "supplier").select("s_suppkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    pairs = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey").select(name(F.col("s_suppkey")).alias("x"), name(F.col("s_suppkey") + 1).alias("y"))
    return G.lowest_common(pairs, reach.select("node", "anc"), reach.filter("anc = 'root'").select("node", F.col("d").alias("depth")))


@register("grf07_depth_one_anchors", _dag("SELECT c.node, string_agg(c.anc, ',' ORDER BY c.anc) AS anchors FROM cl c JOIN dp ON dp.node = c.anc AND depth = 1 GROUP BY c.node"))
def grf07(spark, sf):
    reach = G.closure(dag_edges(spark, sf))
    one = reach.filter("anc = 'root' AND d = 1").select(F.col("node").alias("anc"))
    return reach.join(one, "anc", "left_semi").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("anc")), ",").alias("anchors"))


@register("grf09_is_ancestor", _dag("SELECT DISTINCT node FROM cl WHERE anc = (SELECT min(p_type) FROM (SELECT 't' || p_type AS p_type FROM part))"))
def grf09(spark, sf):
    first = table(spark, sf, "part").agg(F.concat(F.lit("t"), F.min("p_type")).alias("anc"))
    return G.closure(dag_edges(spark, sf)).join(F.broadcast(first), "anc", "left_semi").select("node").distinct()


@register("grf10_transitive_reduction", _tree(", e2 AS (SELECT p, c FROM ed UNION SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT p, c FROM ed"))
def grf10(spark, sf):
    e = tree_edges(spark, sf)
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    skip = s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("c"))
    return G.reduce_edges(e.union(skip))


@register("grf11_stale_parents", _dag("SELECT c, count(*) AS kept FROM ed WHERE p IN (SELECT node FROM dp) GROUP BY c"))
def grf11(spark, sf):
    e = dag_edges(spark, sf)
    return e.join(G.depths(e).select(F.col("node").alias("p")), "p", "left_semi").groupBy("c").agg(F.count("*").alias("kept"))


@register("grf16_acyclic", _dag("SELECT count(*) = 0 AS acyclic FROM up WHERE node = anc AND d > 0"))
def grf16(spark, sf):
    e = dag_edges(spark, sf).select("p", "c")
    # a node on a cycle is its own ancestor at a positive distance
    reach = G.closure(e).filter("d > 0").select("node", "anc")
    loop = e.select(F.col("c").alias("anc"), F.col("p").alias("node")).join(reach.union(e.filter("p = c").select(F.col("c"), F.col("p"))), ["node", "anc"], "left_semi")
    return loop.agg((F.count("*") == 0).alias("acyclic"))


@register("grf17_validity_report", _dag("SELECT depth, count(*) AS nodes, count(*) FILTER (WHERE dp.node NOT IN (SELECT p FROM ed)) AS leaves, count(*) FILTER (WHERE dp.node IN (SELECT c FROM ed GROUP BY c HAVING count(*) > 1)) AS bridges FROM dp GROUP BY depth"))
def grf17(spark, sf):
    e = dag_edges(spark, sf)
    kids = e.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("kids"))
    ups = e.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("ups"))
    d = G.depths(e).join(kids, "node", "left").join(ups, "node", "left")
    return d.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if(F.col("kids").isNull()).alias("leaves"), F.count_if(F.coalesce("ups", F.lit(0)) > 1).alias("bridges"))


@register("grf18_depths", _dag("SELECT node, depth FROM dp"))
def grf18(spark, sf):
    return G.depths(dag_edges(spark, sf))


@register("grf19_mean_leaf_distance", _tree("SELECT anc AS node, round(avg(d::DOUBLE), 6) AS mean_distance FROM up WHERE node NOT IN (SELECT p FROM ed) GROUP BY anc"))
def grf19(spark, sf):
    e = tree_edges(spark, sf)
    return G.closure(e).join(e.select(F.col("p").alias("node")).distinct(), "node", "left_anti").groupBy(F.col("anc").alias("node")).agg(r6(F.avg(F.col("d").cast("double"))).alias("mean_distance"))


@register("grf21_leaf_size_gini", "WITH s AS (SELECT p_brand, count(*)::DOUBLE AS n FROM part GROUP BY p_brand), r AS (SELECT n, row_number() OVER (ORDER BY n, p_brand) AS k FROM s) SELECT count(*) AS leaves, round((2 * sum(k * n) / (count(*) * sum(n))) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r")
def grf21(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").cast("double").alias("n"))
    r = n.select("n", F.row_number().over(W.orderBy("n", "p_brand")).alias("k"))
    c = F.count("*")
    return r.agg(c.alias("leaves"), r6(2 * F.sum(F.col("k") * F.col("n")) / (c * F.sum("n")) - (c + 1) / c).alias("gini"))


@register("grf23_node_edge_count", _dag("SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges"))
def grf23(spark, sf):
    e = dag_edges(spark, sf)
    nodes = e.select("p").union(e.select("c")).distinct().agg(F.count("*").alias("nodes"))
    return nodes.join(e.agg(F.count("*").alias("edges")))


@register("grf25_ancestor_path", _tree("SELECT node, string_agg(anc, ' > ' ORDER BY d DESC) AS path FROM up GROUP BY node"))
def grf25(spark, sf):
    return G.closure(tree_edges(spark, sf)).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("k"), "anc"))), lambda x: x["anc"]), " > ").alias("path"))


@register("prj13_leaf_bridge_flags", _dag("SELECT nd.node, nd.node NOT IN (SELECT p FROM ed WHERE kind = 'TREE') AS no_children, (SELECT count(*) FROM ed WHERE c = nd.node) AS parents FROM nd"))
def prj13(spark, sf):
    e = dag_edges(spark, sf)
    nodes = e.select(F.col("p").alias("node")).union(e.select("c")).distinct()
    kids = e.filter("kind = 'TREE'").select(F.col("p").alias("node"), F.lit(True).alias("has")).distinct()
    ups = e.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(kids, "node", "left").join(ups, "node", "left").select("node", F.col("has").isNull().alias("no_children"), F.coalesce("n", F.lit(0)).alias("parents"))


@register("set01_graph_edit_distance", _dag("SELECT (SELECT count(*) FROM (SELECT p, c FROM ed EXCEPT SELECT p, c FROM ed WHERE kind = 'TREE')) AS removed, 0 AS added"))
def set01(spark, sf):
    e = dag_edges(spark, sf)
    a, b = e.select("p", "c"), e.filter("kind = 'TREE'").select("p", "c")
    return a.subtract(b).agg(F.count("*").alias("removed")).join(b.subtract(a).agg(F.count("*").cast("int").alias("added")))


@register("set02_ancestor_overlap", _dag(f", {_LCA_PAIRS} SELECT x, y, count(*) AS shared FROM pr JOIN cl a ON a.node = x JOIN cl b ON b.node = y AND a.anc = b.anc GROUP BY x, y"))
def set02(spark, sf):
    reach = G.closure(dag_edges(spark, sf)).select("node", "anc")
    p = table(spark, sf, "part").select("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey").select(name(F.col("p_partkey")).alias("x"), name(F.col("p_partkey") + 1).alias("y"))
    return pairs.join(reach.withColumnRenamed("node", "x"), "x").join(reach.withColumnRenamed("node", "y"), ["y", "anc"]).groupBy("x", "y").agg(F.count("*").alias("shared"))


# vectors: leaves are (label, vec_id mod 2); there are as many as the taxonomy has, and the node table is broadcast


def _with_leaves(spark, sf) -> DataFrame:
    """vec_id, label, own, v and, beside every query, the leaves as one array m (leaf, leaf_label, mu): the node table, as small as the taxonomy."""
    q = vectors(spark, sf)
    mu = centroids(q, "leaf", "v").select("leaf", F.expr("leaf div 2").alias("leaf_label"), "mu")
    one = mu.agg(F.array_sort(F.collect_list(F.struct("leaf", "leaf_label", "mu"))).alias("m"))
    return q.withColumnRenamed("leaf", "own").crossJoin(F.broadcast(one))


def _product(v: Column, mu: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(v, mu, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9)


def leaf_scores(spark, sf):
    """vec_id, label, own, leaf, leaf_label, c: every query against every leaf's mean direction."""
    scored = F.transform("m", lambda x: F.struct(x["leaf"].alias("leaf"), x["leaf_label"].alias("leaf_label"), _product(F.col("v"), x["mu"]).alias("c")))
    return _with_leaves(spark, sf).select("vec_id", "label", "own", F.explode(scored).alias("x")).select("vec_id", "label", "own", "x.*")


def leaves_in_order(spark, sf) -> DataFrame:
    """vec_id, label, own, t: the leaves of each query from the closest on (k, leaf, leaf_label), sorted within its row; nothing is shuffled."""
    scored = F.transform("m", lambda x: F.struct((-_product(F.col("v"), x["mu"])).alias("k"), x["leaf"].alias("leaf"), x["leaf_label"].alias("leaf_label")))
    return _with_leaves(spark, sf).select("vec_id", "label", "own", F.array_sort(scored).alias("t"))


def _lv(body):
    return f"WITH {LEAVES} {body}"


#: Nats between the two best leaves of a query that may belong to both, and queries in the report.
BAND, AMBIGUOUS = 0.15, 200

_BEST = "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, leaf) AS k FROM cosx) WHERE k <= 10)"


def ranked(spark, sf, k: int):
    """vec_id, label, own, leaf, leaf_label, c, k: the k closest leaves of each query."""
    top = leaves_in_order(spark, sf).select("vec_id", "label", "own", F.posexplode(F.slice("t", 1, k)).alias("i", "x"))
    return top.select("vec_id", "label", "own", "x.leaf", "x.leaf_label", (-F.col("x.k") + F.lit(0.0)).alias("c"), (F.col("i") + 1).alias("k"))


@register("top03_nearest_centroids", _lv(f", {_BEST} SELECT count(*) FILTER (WHERE k = 1 AND leaf_label = label) AS top1, count(DISTINCT vec_id) FILTER (WHERE k <= 3 AND leaf_label = label) AS top3, count(DISTINCT vec_id) FILTER (WHERE k <= 5 AND leaf_label = label) AS top5, count(DISTINCT vec_id) FILTER (WHERE leaf_label = label) AS top10 FROM bs"))
def top03(spark, sf):
    hit = ranked(spark, sf, 10).filter("leaf_label = label").groupBy("vec_id").agg(F.min("k").alias("k"))
    return hit.agg(*[F.count_if(F.col("k") <= n).alias(f"top{n}") for n in (1, 3, 5, 10)])


@register("win06_best_leaves", _lv(f", {_BEST} SELECT vec_id, max(CASE WHEN k = 1 THEN leaf END) AS best, max(CASE WHEN k = 2 THEN leaf END) AS second, max(CASE WHEN k = 3 THEN leaf END) AS third, round(max(CASE WHEN k = 1 THEN c END) - max(CASE WHEN k = 2 THEN c END), 6) AS margin FROM bs GROUP BY vec_id"))
def win06(spark, sf):
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return ranked(spark, sf, 3).groupBy("vec_id").agg(at(1, "leaf").alias("best"), at(2, "leaf").alias("second"), at(3, "leaf").alias("third"), r6(at(1, "c") - at(2, "c")).alias("margin"))


@register("win06_ambiguous_queries", _lv(f""", p AS (SELECT vec_id, leaf, 10 * c - ln(sum(exp(10 * c)) OVER (PARTITION BY vec_id)) AS lp, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, leaf) AS k FROM cosx),
 g AS (SELECT vec_id, max(leaf) FILTER (WHERE k = 1) AS best, max(leaf) FILTER (WHERE k = 2) AS second, max(leaf) FILTER (WHERE k = 3) AS third, exp(max(lp) FILTER (WHERE k = 1)) AS best_p, max(lp) FILTER (WHERE k = 1) - max(lp) FILTER (WHERE k = 2) AS margin, -sum(CASE WHEN exp(lp) > 1e-9 THEN exp(lp) * lp ELSE 0 END) AS h FROM p GROUP BY vec_id)
 SELECT vec_id, best, second, third, round(best_p, 6) AS best_p, round(h, 6) AS entropy, round(margin, 8) AS margin_nats, coalesce(round(margin, 9) <= {BAND}, false) AS within_band FROM g ORDER BY round(h, 9) DESC, vec_id LIMIT {AMBIGUOUS}"""))
def win06_ambiguous(spark, sf):
    """The queries whose posterior over leaves has the most entropy, with the three best leaves and whether the first two lie within the band.

    The margin has eight decimals: cosines have nine, so at six many margins would lie on the edge of rounding.
    """
    at = lambda i: F.get("t", F.lit(i))
    z = leaves_in_order(spark, sf).withColumn("lz", F.ln(F.aggregate("t", F.lit(0.0), lambda a, x: a + F.exp(-10 * x["k"]))))

    def term(a, x):
        lp = -10 * x["k"] - F.col("lz")
        return a - F.when(F.exp(lp) > 1e-9, F.exp(lp) * lp).otherwise(0.0)

    margin = 10 * (at(1)["k"] - at(0)["k"])
    g = z.select("vec_id", *[at(i)["leaf"].alias(n) for i, n in enumerate(("best", "second", "third"))], F.exp(-10 * at(0)["k"] - F.col("lz")).alias("p"), F.aggregate("t", F.lit(0.0), term).alias("h"), margin.alias("margin"))
    top = g.orderBy(F.desc(F.round("h", 9)), "vec_id").limit(AMBIGUOUS)
    return top.select("vec_id", "best", "second", "third", r6(F.col("p")).alias("best_p"), r6(F.col("h")).alias("entropy"), F.round("margin", 8).alias("margin_nats"), F.coalesce(F.round("margin", 9) <= BAND, F.lit(False)).alias("within_band"))


@register("win07_first_correct_rank", _lv(", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, leaf) AS k FROM cosx) SELECT vec_id, min(k) AS first_correct FROM r WHERE leaf_label = label GROUP BY vec_id"))
def win07(spark, sf):
    right = F.transform("t", lambda x: x["leaf_label"] == F.col("label"))
    return leaves_in_order(spark, sf).select("vec_id", F.array_position(right, F.lit(True)).alias("first_correct")).filter("first_correct > 0")


@register("top01_top_memberships", _lv(", w AS (SELECT vec_id, leaf, exp(10 * c) / sum(exp(10 * c)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, leaf) AS k FROM cosx) SELECT vec_id, leaf, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS weight FROM w WHERE k <= 3"))
def top01(spark, sf):
    w = W.partitionBy("vec_id")
    top = ranked(spark, sf, 3).withColumn("e", F.exp(10 * F.col("c")))
    return top.select("vec_id", "leaf", r6(F.col("e") / F.sum("e").over(w)).alias("weight"))


@register("agg22_leaf_profile", _lv(f", {_BEST}, h AS (SELECT leaf, label, count(*) AS n FROM bs WHERE k = 1 GROUP BY ALL) SELECT leaf, CAST(arg_min(label, -n * 1000 + label) AS INTEGER) AS dominant, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n)::DOUBLE, 6) AS purity FROM h GROUP BY leaf"))
def agg22(spark, sf):
    h = ranked(spark, sf, 1).groupBy("leaf", "label").agg(F.count("*").alias("n"))
    return h.groupBy("leaf").agg(F.min_by("label", F.struct((-F.col("n")).alias("a"), "label")).alias("dominant"), F.sum("n").alias("size"), r6(F.max("n") / F.sum("n")).alias("purity"))


@register("met09_weighted_leaf_purity", _lv(f", {_BEST}, h AS (SELECT leaf, label, count(*) AS n FROM bs WHERE k = 1 GROUP BY ALL) SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM h GROUP BY leaf)) / (SELECT sum(n) FROM h)::DOUBLE, 6) AS purity"))
def met09(spark, sf):
    h = ranked(spark, sf, 1).groupBy("leaf", "label").agg(F.count("*").alias("n"))
    return h.groupBy("leaf").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(r6(F.sum("m") / F.sum("n")).alias("purity"))


@register("clu08_separation", f"WITH {VEC}, cs AS (SELECT label, i, sum(x) AS s, count(*)::DOUBLE AS n FROM qx GROUP BY ALL), g AS (SELECT label, max(n) AS n, sum(s * s) AS ss FROM cs GROUP BY label), t AS (SELECT sum(n) AS n, sum(n * n - ss) AS ww, sum(n * (n - 1)) AS pairs FROM g), tt AS (SELECT sum(s * s) AS ss FROM (SELECT i, sum(s) AS s FROM cs GROUP BY i)) SELECT round(1 - ww / ((n * n - ss) * pairs / (n * (n - 1))), 6) AS separation FROM t, tt")
def clu08(spark, sf):
    s = sums(vectors(spark, sf), "label", "v")
    cell = s.select("n", (F.col("n") * F.col("n") - dot("total", "total")).alias("w"), "total")
    parts = cell.agg(F.sum("n").alias("n"), F.sum("w").alias("within"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    whole = cell.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("ss"))
    n = F.col("n")
    expected = (n * n - F.col("ss")) * F.col("pairs") / (n * (n - 1))
    return parts.join(whole).select(r6(F.when(expected > 1e-10, 1 - F.col("within") / expected).otherwise(0.0)).alias("separation"))


@register("clu23_renormalised_weights", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def clu23(spark, sf):
    w = W.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", r6(F.col("l_quantity") / F.sum("l_quantity").over(w)).alias("weight"))


@register("clu14_mass_conservation", _lv(", w AS (SELECT vec_id, exp(10 * c) / sum(exp(10 * c)) OVER (PARTITION BY vec_id) AS p FROM cosx) SELECT count(*) AS queries, count(*) FILTER (WHERE abs(m - 1) > 0.01) AS broken, round(sum(m), 4) AS mass FROM (SELECT vec_id, sum(p) AS m FROM w GROUP BY vec_id)"))
def clu14(spark, sf):
    w = leaf_scores(spark, sf).select("vec_id", (F.exp(10 * F.col("c")) / F.sum(F.exp(10 * F.col("c"))).over(W.partitionBy("vec_id"))).alias("p"))
    m = w.groupBy("vec_id").agg(F.sum("p").alias("m"))
    return m.agg(F.count("*").alias("queries"), F.count_if(F.abs(F.col("m") - 1) > 0.01).alias("broken"), F.round(F.sum("m"), 4).alias("mass"))


@register("agg26_centroid_shrinkage", _lv(", x AS (SELECT label, i, sum(n * m) / sum(n) AS s FROM (SELECT label, n, unnest(range(len(mu))) AS i, unnest(mu) AS m FROM lmu) GROUP BY ALL) SELECT CAST(label AS BIGINT) AS label, round(least(1.0::DOUBLE, sqrt(sum(s * s))), 6) AS shrinkage FROM x GROUP BY label"))
def agg26(spark, sf):
    mu = centroids(vectors(spark, sf), "leaf", "v").withColumn("label", F.expr("leaf div 2"))
    s = sums(mu, "label", "mu", F.col("n"))
    return s.select("label", r6(F.least(F.lit(1.0), F.sqrt(dot("total", "total")) / F.col("n"))).alias("shrinkage"))


def contingency(spark, sf):
    """label, leaf (the nearest), n."""
    return ranked(spark, sf, 1).groupBy("label", "leaf").agg(F.count("*").cast("double").alias("n"))


_CT = _BEST + ", h AS (SELECT label, leaf, count(*)::DOUBLE AS n FROM bs WHERE k = 1 GROUP BY ALL), ra AS (SELECT label, sum(n) AS n FROM h GROUP BY label), rb AS (SELECT leaf, sum(n) AS n FROM h GROUP BY leaf), tn AS (SELECT sum(n) AS t FROM h)"


@register("met06_nmi", _lv(f", {_CT} SELECT round((SELECT sum(h.n / t * ln(h.n * t / (ra.n * rb.n))) FROM h JOIN ra USING (label) JOIN rb USING (leaf), tn) / sqrt((SELECT -sum(n / t * ln(n / t)) FROM ra, tn) * (SELECT -sum(n / t * ln(n / t)) FROM rb, tn)), 6) AS nmi"))
def met06(spark, sf):
    h = contingency(spark, sf)
    a = h.groupBy("label").agg(F.sum("n").alias("a"))
    b = h.groupBy("leaf").agg(F.sum("n").alias("b"))
    t = h.agg(F.sum("n").alias("t"))
    plogp = lambda c: -F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))
    mi = h.join(a, "label").join(b, "leaf").join(F.broadcast(t)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    ha, hb = a.join(F.broadcast(t)).agg(plogp("a").alias("ha")), b.join(F.broadcast(t)).agg(plogp("b").alias("hb"))
    d = F.sqrt(F.col("ha") * F.col("hb"))
    return mi.join(ha).join(hb).select(r6(F.when(d > 0, F.col("mi") / d).otherwise(0.0)).alias("nmi"))


@register("met07_ari", _lv(f", {_CT}, c AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM h) AS s, (SELECT sum(n * (n - 1) / 2) FROM ra) AS a, (SELECT sum(n * (n - 1) / 2) FROM rb) AS b, (SELECT t * (t - 1) / 2 FROM tn) AS t) SELECT round((s - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM c"))
def met07(spark, sf):
    h = contingency(spark, sf)
    two = lambda c: F.sum(c * (c - 1) / 2)
    s = h.agg(two(F.col("n")).alias("s"), F.sum("n").alias("t"))
    a = h.groupBy("label").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("a"))
    b = h.groupBy("leaf").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("b"))
    e = F.col("a") * F.col("b") / (F.col("t") * (F.col("t") - 1) / 2)
    d = (F.col("a") + F.col("b")) / 2 - e
    return s.join(a).join(b).select(r6(F.when(d != 0, (F.col("s") - e) / d).otherwise(0.0)).alias("ari"))


@register("met13_spherical_silhouette", _lv(f", {_BEST} SELECT round(avg(CASE WHEN b = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (SELECT vec_id, acos(max(CASE WHEN k = 1 THEN c END)) AS a, acos(max(CASE WHEN k = 2 THEN c END)) AS b FROM bs GROUP BY vec_id)"))
def met13(spark, sf):
    at = lambda k: F.acos(F.max(F.when(F.col("k") == k, F.col("c"))))
    q = ranked(spark, sf, 2).groupBy("vec_id").agg(at(1).alias("a"), at(2).alias("b"))
    return q.agg(r6(F.avg(F.when(F.col("b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))).alias("silhouette"))


_CAL = "cal AS (SELECT doc_id, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS p, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def calibration(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("p")).join(l.filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y")), "doc_id")


@register("met17_calibration_error", f"WITH {_CAL}, b AS (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y::DOUBLE) AS acc FROM cal GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, count(*) AS bins FROM b")
def met17(spark, sf):
    c = calibration(spark, sf).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("y").cast("double")).alias("acc"))
    return c.agg(r6(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins"))


@register("met23_brier", f"WITH {_CAL} SELECT round(avg((p - y) * (p - y) + (1 - p - (1 - y)) * (1 - p - (1 - y))), 6) AS brier FROM cal")
def met23(spark, sf):
    e = F.col("p") - F.col("y")
    return calibration(spark, sf).agg(r6(F.avg(2 * e * e)).alias("brier"))


@register("met22_routing_report", _lv(f", {_BEST}, p AS (SELECT label, leaf_label AS pred FROM bs WHERE k = 1), d AS (SELECT DISTINCT label FROM q), m AS (SELECT d.label, count(*) FILTER (WHERE p.label = d.label AND pred = d.label)::DOUBLE AS tp, count(*) FILTER (WHERE pred = d.label)::DOUBLE AS np, count(*) FILTER (WHERE p.label = d.label)::DOUBLE AS nt FROM d, p GROUP BY d.label) SELECT CAST(label AS INTEGER) AS label, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 6) AS prec, round(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END, 6) AS recall, round(CASE WHEN np + nt > 0 THEN 2 * tp / (np + nt) ELSE 0 END, 6) AS f1 FROM m"))
def met22(spark, sf):
    p = ranked(spark, sf, 1).select("label", F.col("leaf_label").cast("int").alias("pred"))
    side = p.select(F.explode(F.array(F.struct(F.col("label").alias("k"), (F.col("label") == F.col("pred")).cast("int").alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("t")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    m = side.groupBy(F.col("k").alias("label")).agg(F.sum("tp").alias("tp"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    ratio = lambda a, b: r6(F.when(b > 0, a / b).otherwise(0.0))
    tp, np_, nt = F.col("tp"), F.col("np"), F.col("nt")
    return m.select("label", ratio(tp, np_).alias("prec"), ratio(tp, nt).alias("recall"), ratio(2 * tp, np_ + nt).alias("f1"))


@register("met01_topology", _dag("SELECT (SELECT count(*) FROM nd) AS nodes, count(*) AS leaves, max(depth) AS max_depth, round(avg(depth::DOUBLE), 6) AS mean_depth FROM dp WHERE node NOT IN (SELECT p FROM ed)"))
def met01(spark, sf):
    e = dag_edges(spark, sf)
    d = G.depths(e)
    leaves = d.join(e.select(F.col("p").alias("node")).distinct(), "node", "left_anti")
    return d.agg(F.count("*").alias("nodes")).join(leaves.agg(F.count("*").alias("leaves"), F.max("depth").alias("max_depth"), r6(F.avg(F.col("depth").cast("double"))).alias("mean_depth")))


@register("met12_leaf_entropy", "SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM part GROUP BY p_brand)")
def met12(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").cast("double").alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(t)).agg(r6(-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias("entropy"))


@register("met05_equilibrium", "WITH s AS (SELECT count(*)::DOUBLE AS n FROM part GROUP BY p_brand) SELECT round(1 - sum(abs(a.n - b.n)) / (2 * count(*) * avg(a.n)), 6) AS equilibrium FROM s a, s b")
def met05(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").cast("double").alias("n"))
    # the rank form of the pairwise sum: no pairs of leaves
    r = n.select("n", F.row_number().over(W.orderBy("n", "p_brand")).alias("k"))
    c = F.count("*")
    return r.agg(r6(1 - (2 * F.sum(F.col("k") * F.col("n")) / (c * F.sum("n")) - (c + 1) / c)).alias("equilibrium"))


@register("met02_median_assignments", "SELECT median(k)::DOUBLE AS median FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey)")
def met02(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k")).agg(F.median("k").cast("double").alias("median"))


@register("met15_hierarchical_f1", _dag(f", {_LCA_PAIRS}, s AS (SELECT count(*)::DOUBLE AS shared FROM pr JOIN cl a ON a.node = x JOIN cl b ON b.node = y AND a.anc = b.anc), n AS (SELECT (SELECT count(*) FROM pr JOIN cl ON cl.node = y)::DOUBLE AS p, (SELECT count(*) FROM pr JOIN cl ON cl.node = x)::DOUBLE AS t) SELECT round(shared / p, 6) AS prec, round(shared / t, 6) AS recall, round(2 * shared / (p + t), 6) AS f1 FROM s, n"))
def met15(spark, sf):
    reach = G.closure(dag_edges(spark, sf)).select("node", "anc")
    p = table(spark, sf, "part").select("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey").select(name(F.col("p_partkey")).alias("x"), name(F.col("p_partkey") + 1).alias("y"))
    ax = pairs.join(reach.withColumnRenamed("node", "x"), "x")
    both = ax.join(reach.withColumnRenamed("node", "y"), ["y", "anc"]).agg(F.count("*").cast("double").alias("s"))
    n = ax.agg(F.count("*").alias("t")).join(pairs.join(reach.withColumnRenamed("node", "y"), "y").agg(F.count("*").alias("p")))
    s = F.col("s")
    return both.join(n).select(r6(s / F.col("p")).alias("prec"), r6(s / F.col("t")).alias("recall"), r6(2 * s / (F.col("p") + F.col("t"))).alias("f1"))
