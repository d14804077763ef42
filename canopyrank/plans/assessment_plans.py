"""Assessment of a routed taxonomy: residuals, contamination, hierarchy, bridges, merges and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.functions.vectors import centroids, dot, sums
from canopyrank.operators import graph as G
from canopyrank.plans.base import LEAVES, dag_edges, r6, tree_edges, vectors
from canopyrank.plans.registry import register
from canopyrank.plans.taxonomy_plans import _BEST, _dag, _tree, leaf_scores, ranked

KEPT, MARGIN = 3, 0.1  # memberships of a query, and how far under the best cosine they may lie
FLOOR = 0.2  # a query whose best cosine is lower stays a residual
LEAST = 20  # mass under which a leaf starves
STARVED = 0.95  # the same as a share of the mean mass of leaves
REDUNDANT = 0.2  # cosine over which two leaves count as redundant, fitted to nothing: the given vectors are near random

_MEM = _BEST + f""", mem AS (SELECT vec_id, label, leaf, leaf_label, c, k, exp(10 * c) / sum(exp(10 * c)) OVER (PARTITION BY vec_id) AS w
  FROM (SELECT *, max(c) OVER (PARTITION BY vec_id) AS best FROM bs WHERE k <= {KEPT}) WHERE c >= best - {MARGIN}::DOUBLE)"""


def _lm(body: str) -> str:
    return f"WITH RECURSIVE {LEAVES}, {_MEM} {body}"


def memberships(spark, sf) -> DataFrame:
    """vec_id, label, leaf, leaf_label, c, k, w: at most three leaves a query, with shares that sum to one."""
    by = W.partitionBy("vec_id")
    top = ranked(spark, sf, KEPT).withColumn("best", F.max("c").over(by)).filter(F.col("c") >= F.col("best") - MARGIN)
    e = F.exp(10 * F.col("c"))
    return top.select("vec_id", "label", "leaf", "leaf_label", "c", "k", (e / F.sum(e).over(by)).alias("w"))


def _share(c: Column) -> Column:
    return r6(F.avg(c.cast("double")))


@register("met03_residuals", _lm(f"SELECT round(avg(CASE WHEN c < {FLOOR} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS residual_ratio, round((SELECT max(n) FROM (SELECT count(*) AS n FROM mem WHERE k = 1 AND c >= {FLOOR} GROUP BY leaf)) / count(*)::DOUBLE, 6) AS max_concentration FROM mem WHERE k = 1"))
def met03(spark, sf):
    # counts by leaf first, so that one row a leaf reaches the last step
    by = ranked(spark, sf, 1).groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(F.col("c") < FLOOR).alias("res"))
    return by.agg(r6(F.sum("res") / F.sum("n")).alias("residual_ratio"), r6(F.max(F.col("n") - F.col("res")) / F.sum("n")).alias("max_concentration"))


@register("met04_contamination", _lm("SELECT round(avg((label <> leaf_label)::INT::DOUBLE), 6) AS contamination FROM mem"))
def met04(spark, sf):
    return memberships(spark, sf).agg(_share(F.col("label") != F.col("leaf_label")).alias("contamination"))


@register("met11_ancestor_correct", _lm("SELECT round(avg(ok::DOUBLE), 6) AS rate FROM (SELECT max((label = leaf_label)::INT) AS ok FROM mem GROUP BY vec_id)"))
def met11(spark, sf):
    return memberships(spark, sf).groupBy("vec_id").agg(F.max((F.col("label") == F.col("leaf_label")).cast("int")).alias("ok")).agg(_share(F.col("ok")).alias("rate"))


@register("met10_edge_f1", _dag(f""", an AS (SELECT c.node, c.anc FROM cl c JOIN dp ON dp.node = c.anc AND depth = 1), ok AS (SELECT p, c, p = 'root' OR EXISTS (SELECT 1 FROM an x JOIN an y ON x.anc = y.anc WHERE x.node = p AND y.node = c) AS good FROM (SELECT DISTINCT p, c FROM ed)),
 mb AS (SELECT 'p' || l_partkey AS node, l_orderkey AS query, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), pl AS (SELECT query, node FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(w, 6) DESC, node) AS k FROM mb) WHERE k = 1),
 gt AS (SELECT l_orderkey AS query, min_by('b' || p_brand, l_linenumber * 1e12 + l_partkey) AS want FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
 pr AS (SELECT avg(good::INT::DOUBLE) AS p FROM ok), rc AS (SELECT avg(EXISTS (SELECT 1 FROM an WHERE an.node = pl.node AND anc = want)::INT::DOUBLE) AS r FROM pl JOIN gt USING (query))
 SELECT round(p, 6) AS prec, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr, rc"""))
def met10(spark, sf):
    """Edges that stay inside an anchor; and queries whose primary leaf has an anchor of their category.

    Orders are the queries, their parts the leaves, weighed by quantity; the brand of an order's first line is its category.
    """
    from canopyrank.session import table

    e = dag_edges(spark, sf)
    reach = G.closure(e)
    one = reach.filter("anc = 'root' AND d = 1").select(F.col("node").alias("anc"))
    an = reach.select("node", "anc").join(one, "anc", "left_semi")
    pc = e.select("p", "c").distinct()
    both = pc.join(an.select(F.col("node").alias("p"), "anc"), "p").join(an.select(F.col("node").alias("c"), "anc"), ["c", "anc"]).select("p", "c").distinct()
    good = pc.join(both.withColumn("hit", F.lit(True)), ["p", "c"], "left").agg(F.avg(((F.col("p") == "root") | F.col("hit").isNotNull()).cast("double")).alias("p"))
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    mass = li.groupBy(F.col("l_orderkey").alias("query"), name("l_partkey").alias("node")).agg(F.sum("l_quantity").alias("w"))
    primary = mass.groupBy("query").agg(F.min(F.struct((-F.round("w", 6)).alias("k"), "node")).alias("m")).select("query", "m.node")
    first = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("query")).agg(F.min_by(F.concat(F.lit("b"), "p_brand"), F.struct("l_linenumber", "l_partkey")).alias("want"))
    right = primary.join(first, "query").join(an.withColumnRenamed("anc", "want").withColumn("hit", F.lit(True)), ["node", "want"], "left")
    found = right.agg(F.avg(F.coalesce("hit", F.lit(False)).cast("int").cast("double")).alias("r"))
    p, r = F.col("p"), F.col("r")
    return good.join(found).select(r6(p).alias("prec"), r6(r).alias("recall"), r6(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"))


def _h(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN -({x}) / n * log2(({x}) / n) ELSE 0 END)"


# the four cells of two indicators; a pair whose crossed cells dominate tells nothing
_ENT = f"{_h('i')} + {_h('n - a - b + i')} AS same, {_h('a - i')} + {_h('b - i')} AS crossed, {_h('a')} + {_h('n - a')} AS hx, {_h('b')} + {_h('n - b')} AS hy"


@register("met08_overlapping_nmi", _lm(f""", x AS (SELECT leaf, count(*)::DOUBLE AS a FROM mem GROUP BY leaf), y AS (SELECT label, count(DISTINCT vec_id)::DOUBLE AS b FROM mem GROUP BY label),
 i AS (SELECT leaf, label, count(*)::DOUBLE AS i FROM mem GROUP BY ALL), t AS (SELECT count(DISTINCT vec_id)::DOUBLE AS n FROM mem),
 c AS (SELECT x.leaf, y.label, a, b, n, coalesce(i, 0) AS i FROM x CROSS JOIN y CROSS JOIN t LEFT JOIN i ON i.leaf = x.leaf AND i.label = y.label WHERE a < n AND b < n), e AS (SELECT leaf, label, {_ENT} FROM c),
 g AS (SELECT (SELECT avg(r) FROM (SELECT min(CASE WHEN same < crossed THEN hx ELSE greatest(same + crossed - hy, 0) END / hx) AS r FROM e GROUP BY leaf)) AS rx, (SELECT avg(r) FROM (SELECT min(CASE WHEN same < crossed THEN hy ELSE greatest(same + crossed - hx, 0) END / hy) AS r FROM e GROUP BY label)) AS ry)
 SELECT round(least(greatest(1 - 0.5 * (rx + ry), 0), 1), 6) AS onmi FROM g"""))
def met08(spark, sf):
    cell = memberships(spark, sf).groupBy("leaf", "label").agg(F.count("*").cast("double").alias("i"), F.sum((F.col("k") == 1).cast("double")).alias("first"))
    # a query has one label and one first leaf, so first leaves count the queries
    x = cell.groupBy("leaf").agg(F.sum("i").alias("a"))
    y = cell.groupBy("label").agg(F.sum("first").alias("b"))
    t = cell.agg(F.sum("first").alias("n"))
    # clusters against clusters: both sides are node tables
    c = x.join(F.broadcast(t)).join(F.broadcast(y)).join(cell.drop("first"), ["leaf", "label"], "left").fillna(0.0, ["i"]).filter("a < n AND b < n")
    e = c.select("leaf", "label", *[F.expr(p) for p in _ENT.split(", ")])
    rest = lambda own, other: F.when(F.col("same") < F.col("crossed"), F.col(own)).otherwise(F.greatest(F.col("same") + F.col("crossed") - F.col(other), F.lit(0.0))) / F.col(own)
    rx = e.groupBy("leaf").agg(F.min(rest("hx", "hy")).alias("r")).agg(F.avg("r").alias("rx"))
    ry = e.groupBy("label").agg(F.min(rest("hy", "hx")).alias("r")).agg(F.avg("r").alias("ry"))
    return rx.join(ry).select(r6(F.least(F.greatest(1 - 0.5 * (F.col("rx") + F.col("ry")), F.lit(0.0)), F.lit(1.0))).alias("onmi"))


@register("met14_dendrogram_purity", _lm(""", h AS (SELECT label, leaf, leaf_label, count(*)::DOUBLE AS n FROM mem WHERE k = 1 GROUP BY ALL),
 pr AS (SELECT a.label, CASE WHEN a.leaf = b.leaf THEN 'l' || a.leaf WHEN a.leaf_label = b.leaf_label THEN 'c' || a.leaf_label ELSE 'root' END AS lca, sum(CASE WHEN a.leaf = b.leaf THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END) AS pairs FROM h a JOIN h b ON a.label = b.label AND a.leaf <= b.leaf GROUP BY ALL),
 nd AS (SELECT label, 'l' || leaf AS node, n FROM h UNION ALL SELECT label, 'c' || leaf_label, n FROM h UNION ALL SELECT label, 'root', n FROM h), nl AS (SELECT label, node, sum(n) AS n FROM nd GROUP BY ALL), nt AS (SELECT node, sum(n) AS t FROM nd GROUP BY node)
 SELECT round(sum(pairs * nl.n / t) / sum(pairs), 6) AS purity FROM pr JOIN nl ON nl.label = pr.label AND nl.node = lca JOIN nt ON nt.node = lca"""))
def met14(spark, sf):
    """Mean purity at the lowest common node of all pairs with one label.

    The pairs that meet at a node are those within it less those within its children, so counts by
    (label, node) suffice: each node gives C(n, 2) times its purity less its parent's. No pair is formed.
    """
    h = ranked(spark, sf, 1).groupBy("label", "leaf", "leaf_label").agg(F.count("*").cast("double").alias("n"))
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    up = F.array(F.struct(name("l", "leaf").alias("node"), name("c", "leaf_label").alias("up")), F.struct(name("c", "leaf_label").alias("node"), F.lit("root").alias("up")), F.struct(F.lit("root").alias("node"), F.lit(None).cast("string").alias("up")))
    at = h.select("label", "n", F.explode(up).alias("x")).groupBy("label", "x.node", "x.up").agg(F.sum("n").alias("n"))
    size = at.groupBy("node").agg(F.sum("n").alias("t"))
    pure = at.join(F.broadcast(size), "node").select("label", "node", "up", "n", (F.col("n") / F.col("t")).alias("purity"))
    over = pure.select("label", F.col("node").alias("up"), F.col("purity").alias("above"))
    two = F.col("n") * (F.col("n") - 1) / 2
    got = pure.join(over, ["label", "up"], "left").agg(
        F.sum(two * (F.col("purity") - F.coalesce("above", F.lit(0.0)))).alias("s"), F.sum(F.when(F.col("up").isNull(), two)).alias("pairs"))
    return got.select(r6(F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs")).otherwise(0.0)).alias("purity"))


def _placed(spark, sf, n: int) -> DataFrame:
    """The n queries that come first by the MD5 of their id, with vector, first leaf and rank."""
    q = vectors(spark, sf).select("vec_id", "v").withColumn("key", F.md5(F.col("vec_id").cast("string"))).orderBy("key").limit(n)
    at = ranked(spark, sf, 1).select("vec_id", "leaf", "leaf_label")
    return F.broadcast(q).join(at, "vec_id").withColumn("r", F.row_number().over(W.orderBy("key")) - 1)


def _placed_sql(n: int) -> str:
    return f", sp AS (SELECT s.*, m.leaf, m.leaf_label, row_number() OVER (ORDER BY key) - 1 AS r FROM (SELECT vec_id, v, md5(vec_id::VARCHAR) AS key FROM q ORDER BY key LIMIT {n}) s JOIN mem m ON m.vec_id = s.vec_id AND m.k = 1)"


@register("met16_dasgupta_cost", _lm(_placed_sql(100) + """, lf AS (SELECT leaf, leaf_label, count(*)::DOUBLE AS n FROM mem WHERE k = 1 GROUP BY ALL), lb AS (SELECT leaf_label, sum(n) AS n FROM lf GROUP BY leaf_label), al AS (SELECT sum(n) AS n FROM lf)
 SELECT count(*) AS pairs, round(coalesce(avg(greatest(0, list_dot_product(a.v, b.v)) * CASE WHEN a.leaf = b.leaf THEN lf.n WHEN a.leaf_label = b.leaf_label THEN lb.n ELSE al.n END), 0), 6) AS mean_cost,
 round(coalesce(avg(greatest(0, list_dot_product(a.v, b.v)) * CASE WHEN a.leaf = b.leaf THEN lf.n WHEN a.leaf_label = b.leaf_label THEN lb.n ELSE al.n END) * max(al.n * (al.n - 1) / 2), 0), 3) AS total_cost
 FROM sp a JOIN sp b ON a.r < b.r JOIN lf ON lf.leaf = a.leaf JOIN lb ON lb.leaf_label = a.leaf_label CROSS JOIN al"""))
def met16(spark, sf):
    """Total cost over all pairs of queries: exact up to 100 queries, that is 4,950 pairs, else the mean of the pairs of 100 queries by hash times the number of all pairs, as the measure evaluates 5,000 pairs at most. Subtree sizes count all."""
    n = ranked(spark, sf, 1).groupBy("leaf", "leaf_label").agg(F.count("*").cast("double").alias("nl"))
    size = n.withColumns({"nb": F.sum("nl").over(W.partitionBy("leaf_label")), "na": F.sum("nl").over(W.partitionBy(F.lit(0)))}).drop("leaf_label")
    s = _placed(spark, sf, 100)
    a, b = s.join(F.broadcast(size), "leaf").alias("a"), F.broadcast(s).alias("b")
    sub = F.when(F.col("a.leaf") == F.col("b.leaf"), F.col("nl")).when(F.col("a.leaf_label") == F.col("b.leaf_label"), F.col("nb")).otherwise(F.col("na"))
    cost = F.greatest(F.lit(0.0), dot("a.v", "b.v")) * sub
    return a.join(b, F.col("a.r") < F.col("b.r")).agg(
        F.count("*").alias("pairs"), r6(F.coalesce(F.avg(cost), F.lit(0.0))).alias("mean_cost"), F.round(F.coalesce(F.avg(cost) * F.max(F.col("na") * (F.col("na") - 1) / 2), F.lit(0.0)), 3).alias("total_cost"))


@register("met18_triplet_accuracy", _lm(_placed_sql(3000) + """, t AS (SELECT list_dot_product(a.v, b.v) AS sb, list_dot_product(a.v, c.v) AS sc, CASE WHEN a.leaf = b.leaf THEN 2 WHEN a.leaf_label = b.leaf_label THEN 1 ELSE 0 END AS db, CASE WHEN a.leaf = c.leaf THEN 2 WHEN a.leaf_label = c.leaf_label THEN 1 ELSE 0 END AS dc
 FROM sp a JOIN sp b ON b.r = a.r + 1 JOIN sp c ON c.r = a.r + 2 WHERE a.r % 3 = 0)
 SELECT count(*) AS decisive, round(coalesce(avg(((sb > sc) = (db > dc))::INT::DOUBLE), 0), 6) AS accuracy FROM t WHERE sb <> sc AND db <> dc"""))
def met18(spark, sf):
    """Of at most 1000 triplets, how many the taxonomy orders as the vectors do; ties are not decisive."""
    at = lambda i: F.max(F.when(F.col("r") % 3 == i, F.struct("v", "leaf", "leaf_label"))).alias("abc"[i])
    t = _placed(spark, sf, 3000).groupBy(F.expr("r div 3").alias("t")).agg(at(0), at(1), at(2)).filter("b IS NOT NULL AND c IS NOT NULL")
    meet = lambda o: F.when(F.col("a.leaf") == F.col(f"{o}.leaf"), 2).when(F.col("a.leaf_label") == F.col(f"{o}.leaf_label"), 1).otherwise(0)
    t = t.select(dot("a.v", "b.v").alias("sb"), dot("a.v", "c.v").alias("sc"), meet("b").alias("db"), meet("c").alias("dc")).filter("sb <> sc AND db <> dc")
    return t.agg(F.count("*").alias("decisive"), r6(F.coalesce(F.avg(((F.col("sb") > F.col("sc")) == (F.col("db") > F.col("dc"))).cast("double")), F.lit(0.0))).alias("accuracy"))


@register("met19_sackin", _tree("SELECT round(avg(d::DOUBLE), 6) AS sackin FROM up WHERE anc = 'root' AND node NOT IN (SELECT p FROM ed)"))
def met19(spark, sf):
    e = tree_edges(spark, sf)
    return G.depths(e).join(e.select(F.col("p").alias("node")).distinct(), "node", "left_anti").agg(_share(F.col("depth")).alias("sackin"))


@register("met20_kappa_by_depth", _lm(""", nd AS (SELECT 2 AS depth, leaf AS node, i, s, n FROM lsum UNION ALL SELECT 1, CAST(leaf // 2 AS BIGINT), i, s, n FROM lsum UNION ALL SELECT 0, 0, i, s, n FROM lsum), g AS (SELECT depth, node, i, sum(s) AS s, sum(n) AS n FROM nd GROUP BY ALL),
 r AS (SELECT depth, node, sqrt(sum(s * s)) / max(n) AS r, count(*) AS d FROM g GROUP BY ALL) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS nodes, round(avg(r * (d - r * r) / (1 - r * r)), 4) AS kappa FROM r GROUP BY depth"""))
def met20(spark, sf):
    # leaf sums are rolled up: the vectors are read once
    leaf = sums(vectors(spark, sf), "leaf", "v")
    one = lambda d, node: F.struct(F.lit(d).alias("depth"), node.cast("long").alias("node"))
    up = leaf.select("n", "total", F.explode(F.array(one(2, F.col("leaf")), one(1, F.expr("leaf div 2")), one(0, F.lit(0)))).alias("x")).select("x.depth", "x.node", "n", F.posexplode("total").alias("i", "s"))
    g = up.groupBy("depth", "node", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    r = g.groupBy("depth", "node").agg((F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.max("n")).alias("r"), F.count("*").alias("d"))
    k = F.col("r") * (F.col("d") - F.col("r") * F.col("r")) / (1 - F.col("r") * F.col("r"))
    # a node whose vectors all agree has no finite concentration
    return r.filter("r < 1").groupBy("depth").agg(F.count("*").alias("nodes"), F.round(F.avg(k), 4).alias("kappa"))


@register("met21_domain_distribution", _lm("SELECT vec_id, CAST(leaf_label AS BIGINT) AS domain, round(sum(w), 6) AS share FROM mem GROUP BY vec_id, leaf_label"))
def met21(spark, sf):
    return memberships(spark, sf).groupBy("vec_id", F.col("leaf_label").cast("long").alias("domain")).agg(r6(F.sum("w")).alias("share"))


@register("met24_soft_rates", _lm(f""", s AS (SELECT vec_id, count(*) AS n, 1 / sum(w * w) AS ess, -sum(w * ln(w)) AS h FROM mem GROUP BY vec_id)
 SELECT round(avg((n = {KEPT})::INT::DOUBLE), 6) AS cap_rate, round(avg((n > 1)::INT::DOUBLE), 6) AS borderline_rate, round(coalesce(avg(CASE WHEN n > 1 THEN n::DOUBLE END), 0), 6) AS soft_degree, round(coalesce(avg(CASE WHEN n > 1 THEN (h / ln(n) > 0.98::DOUBLE)::INT::DOUBLE END), 0), 6) AS guard_rate, round(sum(ess), 4) AS soft_ess FROM s"""))
def met24(spark, sf):
    w = F.col("w")
    s = memberships(spark, sf).groupBy("vec_id").agg(F.count("*").alias("n"), (1 / F.sum(w * w)).alias("ess"), (-F.sum(w * F.ln(w))).alias("h"))
    many = lambda c: r6(F.coalesce(F.avg(F.when(F.col("n") > 1, c)), F.lit(0.0)))
    guard = (F.try_divide(F.col("h"), F.ln("n")) > 0.98).cast("double")
    return s.agg(_share(F.col("n") == KEPT).alias("cap_rate"), _share(F.col("n") > 1).alias("borderline_rate"), many(F.col("n").cast("double")).alias("soft_degree"), many(guard).alias("guard_rate"), F.round(F.sum("ess"), 4).alias("soft_ess"))


@register("met25_cross_anchor_migration", _lm(", h AS (SELECT leaf, label, count(*) AS n FROM mem WHERE k = 1 GROUP BY ALL), d AS (SELECT leaf, label AS dom FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, label) AS r FROM h) WHERE r = 1) SELECT round(sum(CASE WHEN label <> dom THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE, 6) AS migration FROM h JOIN d USING (leaf)"))
def met25(spark, sf):
    # on the histogram: what does not carry its leaf's dominant label has migrated
    h = ranked(spark, sf, 1).groupBy("leaf", "label").agg(F.count("*").alias("n"))
    return h.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("n").alias("m")).agg(r6(F.sum(F.col("n") - F.col("m")) / F.sum("n")).alias("migration"))


@register("met26_leaf_readiness", _lm(f", z AS (SELECT l.leaf, count(m.vec_id)::DOUBLE AS n FROM lmu l LEFT JOIN mem m ON m.leaf = l.leaf AND k = 1 GROUP BY l.leaf), o AS (SELECT n, row_number() OVER (ORDER BY n, leaf) - 1 AS r, count(*) OVER () AS c, sum(n) OVER () AS t FROM z) SELECT max(CASE WHEN r = least(floor(c * 0.1), c - 1) THEN n END) AS p10, round(avg((n < {LEAST})::INT::DOUBLE), 6) AS starved, round(avg((64 > 10 * n)::INT::DOUBLE), 6) AS small, round(sum(CASE WHEN n > 0 THEN -n / t * ln(n / t) ELSE 0 END), 6) AS balance FROM o"))
def met26(spark, sf):
    n = ranked(spark, sf, 1).groupBy("leaf").agg(F.count("*").cast("double").alias("n"))
    z = vectors(spark, sf).groupBy("leaf").agg(F.max(F.size("v")).alias("d")).join(n, "leaf", "left").fillna(0.0, ["n"])
    # one row a leaf
    all_ = W.partitionBy(F.lit(0))
    o = z.select("n", "d", (F.row_number().over(all_.orderBy("n", "leaf")) - 1).alias("r"), F.count("*").over(all_).alias("c"), F.sum("n").over(all_).alias("t"))
    p = F.col("n") / F.col("t")
    return o.agg(F.max(F.when(F.col("r") == F.least(F.floor(F.col("c") * 0.1), F.col("c") - 1), F.col("n"))).alias("p10"), _share(F.col("n") < LEAST).alias("starved"), _share(F.col("d") > 10 * F.col("n")).alias("small"), r6(F.sum(F.when(F.col("n") > 0, -p * F.ln(p)).otherwise(0.0))).alias("balance"))


@register("clu09_objective", _lm(""", x AS (SELECT m.leaf, i, sum(w * x) AS s, sum(w) AS n FROM mem m JOIN qx USING (vec_id) GROUP BY ALL), g AS (SELECT leaf, max(n) AS n, sum(s * s) AS ss FROM x GROUP BY leaf), t AS (SELECT sum(n) AS n, sum(n * n - ss) AS ww, sum(n * (n - 1)) AS pairs FROM g), tt AS (SELECT sum(s * s) AS ss FROM (SELECT i, sum(s) AS s FROM x GROUP BY i))
 SELECT round(1 - ww / ((n * n - ss) * pairs / (n * (n - 1))), 6) AS objective FROM t, tt"""))
def clu09(spark, sf):
    m = memberships(spark, sf).select("vec_id", "leaf", "w").join(vectors(spark, sf).select("vec_id", "v"), "vec_id")
    cell = sums(m, "leaf", "v", F.col("w")).select("n", (F.col("n") * F.col("n") - dot("total", "total")).alias("within"), "total")
    parts = cell.agg(F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    whole = cell.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("ss"))
    n = F.col("n")
    expected = (n * n - F.col("ss")) * F.col("pairs") / (n * (n - 1))
    return parts.join(whole).select(r6(F.when(expected > 1e-10, 1 - F.col("within") / expected).otherwise(0.0)).alias("objective"))


@register("clu15_site_share", _lm(", z AS (SELECT CAST(leaf_label AS BIGINT) AS site, leaf, count(*) AS n FROM mem WHERE k = 1 GROUP BY ALL), p AS (SELECT site, sum(n * (n - 1))::DOUBLE AS pairs FROM z GROUP BY site) SELECT site, pairs, round(pairs / (SELECT sum(pairs) FROM p), 6) AS share FROM p"))
def clu15(spark, sf):
    """A site's share of all within-leaf pairs, by which a proposal's threshold is scaled; a leaf counts once."""
    z = ranked(spark, sf, 1).groupBy(F.col("leaf_label").cast("long").alias("site"), "leaf").agg(F.count("*").alias("n"))
    p = z.groupBy("site").agg(F.sum(F.col("n") * (F.col("n") - 1)).cast("double").alias("pairs"))
    return p.join(F.broadcast(p.agg(F.sum("pairs").alias("t")))).select("site", "pairs", r6(F.try_divide("pairs", "t")).alias("share"))


@register("clu25_starved_leaves", _lm(f", z AS (SELECT leaf, sum(w) AS mass FROM mem GROUP BY leaf) SELECT l.leaf, round(coalesce(mass, 0), 6) AS mass, s.leaf AS sibling, round(list_dot_product(l.mu, s.mu), 6) AS cosine FROM lmu l LEFT JOIN z ON z.leaf = l.leaf LEFT JOIN lmu s ON s.label = l.label AND s.leaf <> l.leaf WHERE round(coalesce(mass, 0), 6) < (SELECT round({STARVED} * sum(mass) / (SELECT count(*) FROM lmu), 6) FROM z)"))
def clu25(spark, sf):
    """Leaves with clearly less than the mean mass, and the nearest sibling, into which they would be merged."""
    mu = centroids(vectors(spark, sf), "leaf", "v").select("leaf", F.expr("leaf div 2").alias("site"), "mu")
    mass = memberships(spark, sf).groupBy("leaf").agg(F.sum("w").alias("mass"))
    held = mu.join(mass, "leaf", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    # one row for each leaf
    bound = F.broadcast(held.agg(F.round(STARVED * F.sum("mass") / F.count("*"), 6).alias("bound")))
    low = held.withColumn("mass", r6(F.col("mass"))).join(bound, F.col("mass") < F.col("bound")).drop("bound")
    sib = mu.select(F.col("leaf").alias("sibling"), "site", F.col("mu").alias("m2"))
    near = low.join(sib, "site", "left").filter("sibling IS NULL OR sibling <> leaf").select("leaf", "mass", F.struct((-dot("mu", "m2")).alias("c"), "sibling").alias("s"))
    return near.groupBy("leaf", "mass").agg(F.min("s").alias("s")).select("leaf", "mass", "s.sibling", r6(-F.col("s.c")).alias("cosine"))


@register("clu27_sibling_separation", _lm(""", t AS (SELECT leaf, CAST(leaf // 2 AS BIGINT) AS site, max(n)::DOUBLE AS n, list(s ORDER BY i) AS s FROM lsum GROUP BY leaf), p AS (SELECT a.leaf AS x, b.leaf AS y, a.n AS na, b.n AS nb, list_dot_product(a.s, a.s) AS aa, list_dot_product(b.s, b.s) AS bb, list_dot_product(a.s, b.s) AS ab FROM t a JOIN t b ON a.site = b.site AND a.leaf < b.leaf)
 SELECT x, y, round(1 - (na * na - aa + nb * nb - bb) / (((na + nb) * (na + nb) - aa - bb - 2 * ab) * (na * (na - 1) + nb * (nb - 1)) / ((na + nb) * (na + nb - 1))), 6) AS separation FROM p"""))
def clu27(spark, sf):
    """Separation of every two siblings from their component sums: members are not read again."""
    s = sums(vectors(spark, sf), "leaf", "v").withColumn("site", F.expr("leaf div 2"))
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.leaf") < F.col("b.leaf"))).select(
        F.col("a.leaf").alias("x"), F.col("b.leaf").alias("y"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), dot("a.total", "a.total").alias("aa"), dot("b.total", "b.total").alias("bb"), dot("a.total", "b.total").alias("ab"))
    sep = "1 - try_divide(na * na - aa + nb * nb - bb, ((na + nb) * (na + nb) - aa - bb - 2 * ab) * (na * (na - 1) + nb * (nb - 1)) / ((na + nb) * (na + nb - 1)))"
    return j.select("x", "y", r6(F.coalesce(F.expr(sep), F.lit(0.0))).alias("separation"))


_RED = f", rp AS (SELECT a.leaf AS x, b.leaf AS y, list_dot_product(a.mu, b.mu) AS cosine FROM lmu a JOIN lmu b ON a.leaf < b.leaf WHERE list_dot_product(a.mu, b.mu) > {REDUNDANT})"


def redundant(spark, sf, above: float = 0.92) -> DataFrame:
    """Pairs of leaves whose directions are nearly one: x, y, cosine. Leaves are a node table, broadcast as elsewhere."""
    mu = centroids(vectors(spark, sf), "leaf", "v").select("leaf", "mu")
    a, b = mu.alias("a"), F.broadcast(mu).alias("b")
    return a.join(b, F.col("a.leaf") < F.col("b.leaf")).select(F.col("a.leaf").alias("x"), F.col("b.leaf").alias("y"), dot("a.mu", "b.mu").alias("cosine")).filter(F.col("cosine") > above)


@register("jn11_redundant_pairs", _lm(f"{_RED} SELECT x, y, round(cosine, 6) AS cosine FROM rp"))
def jn11(spark, sf):
    return redundant(spark, sf, REDUNDANT).select("x", "y", r6(F.col("cosine")).alias("cosine"))


@register("grf12_merge_groups", _lm(f"{_RED}, e AS (SELECT x, y FROM rp UNION SELECT y, x FROM rp), rc AS (SELECT x, y FROM e UNION SELECT rc.x, e.y FROM rc JOIN e ON rc.y = e.x) SELECT x AS leaf, least(x, min(y)) AS grp FROM rc GROUP BY x"))
def grf12(spark, sf):
    return G.merge_groups(redundant(spark, sf, REDUNDANT), "x", "y", "leaf", "grp")


def bridge_audit(spark, sf, mass: float = 5.0, band: tuple[float, float] = (0.3, 0.95), ess: float = 10.0, support: float = 50.0, part: float = 0.1) -> DataFrame:
    """Every two leaves with shared queries: x, y, shared, mass, cosine, reason (the first gate that fails, or none).

    Gates: A different anchors, B shared mass, C cosine in the band, D effective size of both, E support, absolute and relative.
    Shared queries come from a self join by query, which has three memberships at most. Leaves that share nothing fail A or B and are left out.
    """
    m = memberships(spark, sf).select("vec_id", "leaf", "w")
    size = m.groupBy("leaf").agg(F.sum("w").alias("m"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"))
    node = centroids(vectors(spark, sf), "leaf", "v").select("leaf", F.expr("leaf div 2").alias("site"), "mu").join(size, "leaf")
    shared = m.alias("a").join(m.alias("b"), (F.col("a.vec_id") == F.col("b.vec_id")) & (F.col("a.leaf") < F.col("b.leaf"))).groupBy(F.col("a.leaf").alias("x"), F.col("b.leaf").alias("y")).agg(F.count("*").alias("shared"), F.sum(F.least("a.w", "b.w")).alias("mass"))
    side = lambda k, n: node.select(F.col("leaf").alias(k), *[F.col(c).alias(c + n) for c in ("site", "mu", "m", "ess")])
    j = shared.join(F.broadcast(side("x", "1")), "x").join(F.broadcast(side("y", "2")), "y").withColumn("cosine", r6(dot("mu1", "mu2"))).withColumn("mass", r6(F.col("mass")))
    reason = (F.when(F.col("site1") == F.col("site2"), "A").when(F.col("mass") < mass, "B").when(~F.col("cosine").between(*band), "C")
              .when((F.col("ess1") < ess) | (F.col("ess2") < ess), "D").when((F.col("mass") < support) | (F.col("mass") < part * F.least("m1", "m2")), "E").otherwise("none"))
    return j.select("x", "y", "shared", "mass", "cosine", reason.alias("reason"))


_BRIDGE = """, sz AS (SELECT leaf, sum(w) AS m, sum(w) * sum(w) / sum(w * w) AS ess FROM mem GROUP BY leaf),
 sh AS (SELECT a.leaf AS x, b.leaf AS y, count(*) AS shared, round(sum(least(a.w, b.w)), 6) AS mass FROM mem a JOIN mem b ON a.vec_id = b.vec_id AND a.leaf < b.leaf GROUP BY ALL),
 br AS (SELECT x, y, shared, mass, cosine, CASE WHEN site1 = site2 THEN 'A' WHEN mass < 0.5 THEN 'B' WHEN NOT cosine BETWEEN 0.05 AND 0.95 THEN 'C' WHEN least(e1, e2) < 10 THEN 'D' WHEN mass < 1.0 OR mass < 0.1::DOUBLE * least(m1, m2) THEN 'E' ELSE 'none' END AS reason
  FROM (SELECT x, y, shared, mass, round(list_dot_product(p.mu, q.mu), 6) AS cosine, p.label AS site1, q.label AS site2, a.m AS m1, b.m AS m2, a.ess AS e1, b.ess AS e2 FROM sh JOIN lmu p ON p.leaf = x JOIN lmu q ON q.leaf = y JOIN sz a ON a.leaf = x JOIN sz b ON b.leaf = y))"""


def _bridges(spark, sf):
    # thresholds for the given tables, whose leaves hold a few dozen queries
    return bridge_audit(spark, sf, mass=0.5, band=(0.05, 0.95), support=1.0)


@register("clu36_bridge_audit", _lm(f"{_BRIDGE} SELECT * FROM br"))
def clu36(spark, sf):
    return _bridges(spark, sf)


@register("clu38_bridge_summary", _lm(f"{_BRIDGE} SELECT reason, count(*) AS pairs, round(sum(mass), 4) AS mass, round(avg(cosine), 6) AS cosine FROM br GROUP BY reason"))
def clu38(spark, sf):
    return _bridges(spark, sf).groupBy("reason").agg(F.count("*").alias("pairs"), F.round(F.sum("mass"), 4).alias("mass"), r6(F.avg("cosine")).alias("cosine"))


@register("clu37_residual_readiness", _lm(f""", p AS (SELECT vec_id, label, max(CASE WHEN k = 1 THEN CAST(leaf_label AS BIGINT) END) AS site, max(CASE WHEN k = 1 THEN c END) AS c1, max(CASE WHEN k = 2 THEN c END) AS c2, max(CASE WHEN k = 3 THEN c END) AS c3 FROM bs GROUP BY vec_id, label),
 h AS (SELECT site, label, count(*)::DOUBLE AS n FROM p GROUP BY ALL), e AS (SELECT site, -sum(n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS t FROM h) GROUP BY site)
 SELECT p.site, count(*) AS n, round(avg((c1 < {FLOOR})::INT::DOUBLE), 6) AS residual_rate, round(max(h), 6) AS domain_entropy, round(avg(c1), 6) AS first, round(avg(c2), 6) AS second, round(avg(c3), 6) AS third FROM p JOIN e ON e.site = p.site GROUP BY p.site"""))
def clu37(spark, sf):
    at = lambda k, c="c": F.max(F.when(F.col("k") == k, F.col(c)))
    p = ranked(spark, sf, 3).groupBy("vec_id", "label").agg(at(1, "leaf_label").cast("long").alias("site"), at(1).alias("c1"), at(2).alias("c2"), at(3).alias("c3"))
    # sums by (site, label) carry both the means and the histogram
    h = p.groupBy("site", "label").agg(F.count("*").alias("n"), F.count_if(F.col("c1") < FLOOR).alias("res"), *[F.sum(c).alias(c) for c in ("c1", "c2", "c3")])
    n = F.col("n").cast("double")
    t = F.sum(n)
    return h.groupBy("site").agg(F.sum("n").alias("n"), r6(F.sum("res") / t).alias("residual_rate"), r6(F.log2(t) - F.sum(n * F.log2(n)) / t).alias("domain_entropy"),
                                 *[r6(F.sum(c) / t).alias(name) for c, name in (("c1", "first"), ("c2", "second"), ("c3", "third"))])


@register("set07_canonical_adapted_jaccard", _lm(", h AS (SELECT leaf, label, count(*)::DOUBLE AS n FROM mem WHERE k = 1 GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY leaf) AS a, sum(n) OVER (PARTITION BY label) AS b FROM h) SELECT leaf, label AS dominant, round(n / (a + b - n), 6) AS jaccard FROM d WHERE r = 1"))
def set07(spark, sf):
    """Queries of a leaf's dominant label against the queries routed to it, from the histogram alone."""
    h = ranked(spark, sf, 1).groupBy("leaf", "label").agg(F.count("*").cast("double").alias("n"))
    d = h.withColumns({"a": F.sum("n").over(W.partitionBy("leaf")), "b": F.sum("n").over(W.partitionBy("label")), "r": F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("n"), "label"))})
    return d.filter("r = 1").select("leaf", F.col("label").alias("dominant"), r6(F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("jaccard"))


@register("clu35_random_null", _lm(", z AS (SELECT label, ('0x' || substr(md5('null' || vec_id), 1, 7))::BIGINT % 20 AS leaf FROM q), h AS (SELECT leaf, label, count(*)::DOUBLE AS n FROM z GROUP BY ALL) SELECT leaf, round(max(n) / sum(n), 6) AS purity FROM h GROUP BY leaf"))
def clu35_null(spark, sf):
    """Purity of leaves to which queries are dealt by a hash: what a taxonomy must beat."""
    leaf = F.conv(F.substring(F.md5(F.concat(F.lit("null"), F.col("vec_id").cast("string"))), 1, 7), 16, 10).cast("long") % 20
    h = vectors(spark, sf).groupBy(leaf.alias("leaf"), "label").agg(F.count("*").cast("double").alias("n"))
    return h.groupBy("leaf").agg(r6(F.max("n") / F.sum("n")).alias("purity"))


@register("clu35_kmeans_baseline")
def clu35_kmeans(spark, sf):
    """Flat spherical k-means with as many parts as there are leaves: purity and size of each part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors(spark, sf).select("label", array_to_vector("v").alias("features"))
    got = KMeans(k=20, seed=42, distanceMeasure="cosine", maxIter=20).fit(x).transform(x)
    h = got.groupBy(F.col("prediction").alias("part"), "label").agg(F.count("*").alias("n"))
    return h.groupBy("part").agg(F.sum("n").alias("size"), r6(F.max("n") / F.sum("n")).alias("purity"))


@register("rat21_soft_routing", _lm(", s AS (SELECT vec_id, leaf, k, w, -sum(w * ln(w)) OVER (PARTITION BY vec_id) AS h, count(*) OVER (PARTITION BY vec_id) AS n FROM mem) SELECT vec_id, leaf, round(CASE WHEN n > 1 AND h / ln(n) > 0.98::DOUBLE THEN 1 ELSE w END, 6) AS weight FROM s WHERE k = 1 OR n = 1 OR h / ln(n) <= 0.98::DOUBLE"))
def rat21(spark, sf):
    """Arena memberships: where the posterior is nearly flat only the first leaf stays, with all the weight."""
    by = W.partitionBy("vec_id")
    s = memberships(spark, sf).withColumns({"h": -F.sum(F.col("w") * F.ln("w")).over(by), "n": F.count("*").over(by)})
    flat = F.coalesce(F.try_divide(F.col("h"), F.ln("n")), F.lit(0.0)) > 0.98
    return s.withColumn("flat", flat).filter("k = 1 OR NOT flat").select("vec_id", "leaf", r6(F.when(F.col("flat"), 1.0).otherwise(F.col("w"))).alias("weight"))
