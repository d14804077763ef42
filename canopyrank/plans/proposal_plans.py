"""Routing through a tree of categories and leaves, and proposals to change it, each with its gain."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.operators import fitting as L
from canopyrank.operators import moments as M
from canopyrank.operators import proposals as P
from canopyrank.operators import routing as R
from canopyrank.operators import routing_report as O
from canopyrank.operators import taxonomy as T
from canopyrank.operators.topology import Node, Settings, Taxonomy
from canopyrank.plans.base import VEC, r6, vectors
from canopyrank.plans.registry import register

RULES = Settings()
#: Mass from which a node has a profile, as a share of the mean over all nodes that hold any.
PROFILED = 0.5

_K = "least(1, greatest(0, {k} / (31.5::DOUBLE + sqrt(32.5::DOUBLE * 32.5 + {k} * {k}))))"


def _kappa(source: str) -> str:
    """Corrected concentration of rows with r and n, by the same Newton steps as the fits."""
    q = f"SELECT *, r * (64 - r * r) / (1 - r * r) AS k FROM {source}"
    for _ in range(5):
        q = f"SELECT * EXCLUDE (k, a), greatest(1e-3::DOUBLE, k - (a - r) / greatest(1 - a * a - 63 / k * a, 1e-9::DOUBLE)) AS k FROM (SELECT *, {_K.format(k='k')} AS a FROM ({q}))"
    return f"SELECT * EXCLUDE (k), CASE WHEN n > 1 THEN least(1e4::DOUBLE, greatest(1e-3::DOUBLE, k * (n - 1) / (n + 62))) ELSE 1e-3 END AS kappa FROM ({q})"


NODES = VEC + f""",
 fx AS (SELECT 'c' || label AS node, 'root' AS parent, 1 AS depth, i, x FROM qx UNION ALL SELECT 'l' || leaf, 'c' || label, 2, i, x FROM qx),
 fs AS (SELECT node, parent, depth, i, sum(x) AS s, count(*) AS n FROM fx GROUP BY ALL),
 fn AS (SELECT node, parent, depth, n, list(s / nn ORDER BY i) AS mu, list(s ORDER BY i) AS total, any_value(nn) / n AS r FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY node)) AS nn FROM fs) GROUP BY node, parent, depth, n),
 nd AS MATERIALIZED ({_kappa("fn")}),
 kb AS (SELECT parent, greatest(avg(kappa), 1e-9) AS kbar FROM nd GROUP BY parent),
 sh AS (SELECT node, least(1, sqrt(sum(t * t))) AS shrink FROM (SELECT parent AS node, i, sum(n * m) / sum(n) AS t FROM (SELECT parent, n, unnest(range(64)) AS i, unnest(mu) AS m FROM nd WHERE depth = 2) GROUP BY ALL) GROUP BY node)"""

_STEP = """SELECT *, max(c) OVER (PARTITION BY vec_id, node) AS best FROM (
   SELECT w.vec_id, w.v, w.node, w.logp, k.node AS kid, kbar, round(list_dot_product(w.v, k.mu), 9) AS c, round(shrink * round(list_dot_product(w.v, p.mu), 9), 9) AS gate
   FROM w JOIN nd k ON k.parent = w.node JOIN kb ON kb.parent = w.node LEFT JOIN nd p ON p.node = w.node LEFT JOIN sh ON sh.node = w.node)"""

WALK = NODES + f""",
 w AS (SELECT vec_id, v, 'root' AS node, 0.0::DOUBLE AS logp FROM q UNION ALL
  SELECT * FROM (SELECT vec_id, v, kid AS node, logp + kbar * (c - best) - ln(sum(exp(kbar * (c - best))) OVER (PARTITION BY vec_id, node)) AS logp FROM ({_STEP})
   WHERE (gate IS NULL OR best >= gate) AND round(best - c, 9) <= {RULES.margin}::DOUBLE) WHERE logp >= ln({RULES.path_floor}::DOUBLE)),
 en AS (SELECT vec_id, node, exp(logp) / sum(exp(logp)) OVER (PARTITION BY vec_id) AS share FROM w
  WHERE NOT EXISTS (SELECT 1 FROM w x JOIN nd ON nd.node = x.node WHERE x.vec_id = w.vec_id AND nd.parent = w.node)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(share, 12) DESC, node) AS place FROM en),
 kp AS (SELECT * FROM rk WHERE share >= {RULES.share_floor}::DOUBLE OR place = 1)"""


def queries(spark, sf):
    return vectors(spark, sf).select("vec_id", "label", "leaf", "v")


def category_tree(q) -> Taxonomy:
    """A root, a node for each category and below it one for each of its leaves, fitted."""
    nodes = {"root": Node("root", None, 0)}
    parent = {f"l{r['leaf']}": f"c{r['label']}" for r in q.select("label", "leaf").distinct().collect()}
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    for depth, key in ((1, name("c", "label")), (2, name("l", "leaf"))):
        for node, (n, mu, kappa) in T.fit(q.withColumn("node", key)).items():
            nodes[node] = Node(node, parent.get(node, "root"), depth, tuple(mu), kappa, float(n) if depth == 2 else 0.0)
    return Taxonomy(nodes)


@register("clu11_beam_routing", f"WITH RECURSIVE {WALK} SELECT vec_id, node, round(share / sum(share) OVER (PARTITION BY vec_id), 6) AS weight FROM kp WHERE place <= {RULES.assignments}")
def clu11(spark, sf):
    """Routing as for inference, through the root, the categories and their leaves: every query has one to three nodes."""
    q = queries(spark, sf)
    return R.route(q, category_tree(q), RULES).select("vec_id", "node", r6(F.col("weight")).alias("weight"))


@register("clu12_training_memberships", f"WITH RECURSIVE {WALK} SELECT vec_id, node, round(share / sum(share) OVER (PARTITION BY vec_id), 6) AS weight FROM kp")
def clu12(spark, sf):
    """Routing as for training: no bound on the nodes of a query but the floor."""
    q = queries(spark, sf)
    return R.route(q, category_tree(q), RULES, training=True).select("vec_id", "node", r6(F.col("weight")).alias("weight"))


@register("clu13_residual_hits", f"WITH RECURSIVE {WALK} SELECT vec_id, node, round(1 / sum(exp(kbar * (c - best))), 6) AS confidence FROM ({_STEP}) WHERE best < gate GROUP BY vec_id, node")
def clu13(spark, sf):
    """Where the gate holds a query back, and the share of the child that fits best."""
    q = queries(spark, sf)
    return R.residual_hits(q, category_tree(q), RULES).select("vec_id", "node", r6(F.col("confidence")).alias("confidence"))


@register("clu13_reassigned_mass", f"WITH RECURSIVE {WALK} SELECT node, round(sum(weight), 6) AS mass, count(*) AS queries FROM (SELECT node, share / sum(share) OVER (PARTITION BY vec_id) AS weight FROM kp) GROUP BY node")
def clu13_mass(spark, sf):
    """What every node holds after all queries are assigned anew; masses add up to the number of queries."""
    q = queries(spark, sf)
    return R.route(q, category_tree(q), RULES, training=True).groupBy("node").agg(r6(F.sum("weight")).alias("mass"), F.count("*").alias("queries"))


@register("clu17_split_gates", f"""WITH RECURSIVE {WALK}, ms AS (SELECT node, sum(weight) AS mass, sum(weight) * sum(weight) / sum(weight * weight) AS ess FROM (SELECT node, share / sum(share) OVER (PARTITION BY vec_id) AS weight FROM kp) GROUP BY node)
 SELECT node, round(mass, 6) AS mass, round(ess, 6) AS ess, depth, round(kappa, 6) AS kappa, CASE WHEN mass < {2 * RULES.least} THEN 'mass' WHEN ess < {2 * RULES.least} THEN 'ess' WHEN depth >= {RULES.max_depth} THEN 'depth' WHEN kappa < {RULES.diffuse_kappa} AND mass < {RULES.diffuse_times * RULES.least} THEN 'diffuse' ELSE 'open' END AS gate
 FROM ms JOIN nd USING (node)""")
def clu17(spark, sf):
    """Which gate keeps a node from being split; its residuals are not asked here."""
    q = queries(spark, sf)
    tree = category_tree(q)
    g = P.gates(R.route(q, tree, RULES, training=True), tree, RULES)
    return g.select("node", *[r6(F.col(c)).alias(c) for c in ("mass", "ess")], "depth", r6(F.col("kappa")).alias("kappa"), "gate")


@register("clu10_second_moments", f"WITH {VEC} SELECT 'c' || a.label AS node, a.i, b.i AS j, round(sum(a.x * b.x), 6) AS moment FROM qx a JOIN qx b ON a.vec_id = b.vec_id GROUP BY ALL")
def clu10_moments(spark, sf):
    """The sums that leading directions are taken from, for each category."""
    m = M.second_moments(vectors(spark, sf).withColumn("node", F.concat(F.lit("c"), F.col("label").cast("string"))))
    row = m.select("node", F.posexplode("moment").alias("i", "row")).select("node", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "x"))
    return row.select("node", "i", F.col("j").cast("long").alias("j"), r6(F.col("x")).alias("moment"))


@register("clu10_projection")
def clu10(spark, sf):
    """Every query in the eight leading directions of its category: vec_id, node, y. A direction's sign is fixed; tested against a dense decomposition."""
    q = vectors(spark, sf).select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("node"), "v")
    return M.projected(q, M.directions(M.second_moments(q), 8)).select("vec_id", "node", F.transform("y", lambda x: r6(x)).alias("y"))


_J = "round(1 - sum(n * n - ss) / ((sum(n) * sum(n) - any_value(t)) * sum(n * (n - 1)) / (sum(n) * (sum(n) - 1))), 12)"
#: Objective of every state: cells (state, cell, i, x) with their masses (state, cell, n).
_STATE = f""" ob AS (SELECT state, {_J} AS j FROM (SELECT state, cell, any_value(n) AS n, sum(s * s) AS ss FROM cs JOIN cn USING (state, cell) GROUP BY state, cell)
  JOIN (SELECT state, sum(s * s) AS t FROM (SELECT state, i, sum(s) AS s FROM cs GROUP BY ALL) GROUP BY state) USING (state) GROUP BY state)"""
_SPLIT = NODES + f""",
 st AS (SELECT vec_id, v, 'c' || label AS site FROM q),
 sp AS (SELECT vec_id, site, node, exp(kbar * (c - best)) / sum(exp(kbar * (c - best))) OVER (PARTITION BY vec_id, site) AS share
  FROM (SELECT *, max(c) OVER (PARTITION BY vec_id, site) AS best FROM (SELECT vec_id, site, node, kbar, round(list_dot_product(v, mu), 9) AS c FROM st JOIN nd ON nd.parent = site JOIN kb ON kb.parent = site)) WHERE round(best - c, 9) <= {RULES.margin}::DOUBLE),
 mm AS (SELECT '' AS state, vec_id, site AS cell, 1.0::DOUBLE AS w FROM st UNION ALL SELECT x.site, st.vec_id, st.site, 1.0::DOUBLE FROM (SELECT DISTINCT site FROM st) x JOIN st ON st.site <> x.site UNION ALL SELECT site, vec_id, node, share FROM sp),
 cn AS (SELECT state, cell, sum(w) AS n FROM mm GROUP BY ALL), cs AS (SELECT state, cell, i, sum(w * x) AS s FROM mm JOIN qx USING (vec_id) GROUP BY ALL),{_STATE},
 pr AS (SELECT site, count(*)::DOUBLE AS n FROM st GROUP BY site), li AS (SELECT site, least(1, n * (n - 1) / (SELECT sum(n * (n - 1)) FROM pr)) AS share FROM pr)"""


@register("clu15_split_gains", f"WITH {_SPLIT} SELECT site, round(j - (SELECT j FROM ob WHERE state = ''), 6) + 0 AS gain, round({RULES.epsilon}::DOUBLE * share, 6) AS threshold, j - (SELECT j FROM ob WHERE state = '') > {RULES.epsilon}::DOUBLE * share AS accepted FROM ob JOIN li ON site = state")
def clu15(spark, sf):
    """Splitting each category into its leaves, proposed on its own: the gain in separation, and whether it passes the site's threshold.

    The SQL works out the objective of every proposal anew from all members; the query changes one row of the cells.
    """
    q = queries(spark, sf).withColumn("node", F.concat(F.lit("c"), F.col("label").cast("string"))).withColumn("weight", F.lit(1.0))
    tree = category_tree(q)
    cells = P.Cells.read(q)
    targets = {site: tree.children(site) for site in cells.of}
    got = P.outcomes(q, targets, RULES)
    rows = [P.settle(cells, tree, "split", site, {site: None, **got[site]}, RULES.epsilon)[1] for site in sorted(targets)]
    out = spark.createDataFrame([(r.site, r.gain, r.threshold, r.accepted) for r in rows], "site string, gain double, threshold double, accepted boolean")
    return out.select("site", r6(F.col("gain")).alias("gain"), r6(F.col("threshold")).alias("threshold"), "accepted")


_MERGE = NODES + f""",
 lf AS (SELECT vec_id, 'l' || leaf AS cell, 'c' || label AS parent FROM q),
 pa AS (SELECT a.node AS a, b.node AS b, a.parent FROM nd a JOIN nd b ON a.parent = b.parent AND a.node < b.node WHERE a.depth = 2),
 mm AS (SELECT '' AS state, vec_id, cell, 1.0::DOUBLE AS w FROM lf UNION ALL SELECT a || b, vec_id, CASE WHEN cell = b THEN a ELSE cell END, 1.0::DOUBLE FROM pa, lf),
 cn AS (SELECT state, cell, sum(w) AS n FROM mm GROUP BY ALL), cs AS (SELECT state, cell, i, sum(w * x) AS s FROM mm JOIN qx USING (vec_id) GROUP BY ALL),{_STATE}"""


@register("clu27_merge_gains", f"WITH {_MERGE} SELECT a, b, round(j - (SELECT j FROM ob WHERE state = ''), 6) + 0 AS gain FROM pa JOIN ob ON state = a || b")
def clu27(spark, sf):
    """What merging the leaves of each category would do to the objective; no member is read for it, as their cells add up."""
    q = queries(spark, sf).withColumn("node", F.concat(F.lit("l"), F.col("leaf").cast("string"))).withColumn("weight", F.lit(1.0))
    tree, cells = category_tree(q), P.Cells.read(q)
    kids = [sorted(k.name for k in tree.children(n.name)) for n in tree.nodes.values() if n.depth == 1]
    pairs = [(a, b) for k in kids for i, a in enumerate(k) for b in k[i + 1 :]]
    rows = [(a, b, cells.gain({a: (cells.of[a][0] + cells.of[b][0], cells.of[a][1] + cells.of[b][1]), b: None})) for a, b in pairs]
    return spark.createDataFrame(rows, "a string, b string, gain double").select("a", "b", r6(F.col("gain")).alias("gain"))


#: Training memberships give the profiles, inference routes are judged by them.
_REPORT = WALK + f""",
 tm AS (SELECT vec_id, node, share / sum(share) OVER (PARTITION BY vec_id) AS w FROM kp),
 rt AS (SELECT vec_id, node, share / sum(share) OVER (PARTITION BY vec_id) AS w FROM kp WHERE place <= {RULES.assignments}),
 pd AS (SELECT node, label, sum(w) AS w FROM tm JOIN q USING (vec_id) GROUP BY ALL),
 pn AS (SELECT *, sum(w) OVER (PARTITION BY node) AS mass, row_number() OVER (PARTITION BY node ORDER BY round(w, 9) DESC, label) AS k FROM pd),
 pf AS (SELECT node, label AS domain, w / mass AS purity, depth FROM pn JOIN (SELECT node, depth FROM nd UNION ALL SELECT 'root', 0) USING (node) WHERE k = 1 AND round(mass, 9) >= (SELECT round({PROFILED} * sum(w) / count(DISTINCT node), 9) FROM tm)),
 mt AS (SELECT vec_id, node, w, domain, purity, depth, row_number() OVER (PARTITION BY vec_id ORDER BY round(w, 12) DESC, node) AS k FROM rt JOIN pf USING (node)),
 bm AS (SELECT vec_id, count(*) AS n, sum(w) AS s, max(CASE WHEN k = 1 THEN domain END) AS domain, max(CASE WHEN k = 1 THEN purity END) AS purity, max(CASE WHEN k = 1 THEN depth END) AS depth, max(CASE WHEN k = 1 THEN w END) AS conf FROM mt GROUP BY vec_id),
 fd AS (SELECT q.vec_id, label, coalesce(n, 0) AS n, s, domain, purity, depth, conf, EXISTS (SELECT 1 FROM mt WHERE mt.vec_id = q.vec_id AND mt.domain = q.label) AS hit FROM q LEFT JOIN bm USING (vec_id)),
 df AS (SELECT d.label, count(*) FILTER (WHERE fd.label = d.label) AS support, count(*) FILTER (WHERE fd.label = d.label AND domain = d.label)::DOUBLE AS tp, count(*) FILTER (WHERE domain = d.label)::DOUBLE AS np FROM (SELECT DISTINCT label FROM q) d, fd GROUP BY d.label),
 dm AS (SELECT label, support, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS prec, tp / support AS recall, CASE WHEN np + support > 0 THEN 2 * tp / (np + support) ELSE 0 END AS f1 FROM df),
 cb AS (SELECT least(CAST(floor(round(conf, 9) * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(round(conf, 9)) AS conf, avg((label = domain)::INT::DOUBLE) AS acc FROM fd WHERE domain IS NOT NULL GROUP BY 1),
 ec AS (SELECT coalesce(sum(n * abs(conf - acc)) / sum(n), 0) AS ece, count(*) AS bins FROM cb)"""
_FIGURES = ("top1", "low", "high", "any_match", "no_match", "purity", "depth", "macro_f1", "ece", "mean_matches", "median_matches", "multi_leaf", "posterior", "depth_corr")


def judged(spark, sf):
    """Inference routes, profiles from training memberships, and the categories."""
    q = queries(spark, sf)
    tree = category_tree(q)
    training = R.route(q, tree, RULES, training=True)
    depth = F.broadcast(spark.createDataFrame([(n.name, n.depth) for n in tree.nodes.values()], "node string, depth int"))
    mean = training.agg(F.round(F.lit(PROFILED) * F.sum("weight") / F.countDistinct("node"), 9)).first()[0] or 0.0
    truth = q.select("vec_id", F.col("label").alias("category"))
    return R.route(q, tree, RULES), O.leaf_profiles(training, truth, depth, mean), truth


@register("met22_batch_report", f"""WITH RECURSIVE {_REPORT}, t AS (SELECT count(*) AS queries, avg(coalesce(label = domain, false)::INT::DOUBLE) AS p, avg(hit::INT::DOUBLE) AS any_match, avg((domain IS NULL)::INT::DOUBLE) AS no_match, avg(purity) AS purity, avg(depth::DOUBLE) AS depth,
 avg(n::DOUBLE) AS mean_matches, median(n)::DOUBLE AS median_matches, avg((n > 1)::INT::DOUBLE) AS multi_leaf, avg(s) AS posterior FROM fd)
 SELECT queries, round(p, 6) AS top1, round(greatest(0, (p + 3.8416::DOUBLE / (2 * queries) - 1.96::DOUBLE * sqrt(p * (1 - p) / queries + 3.8416::DOUBLE / (4 * queries * queries))) / (1 + 3.8416::DOUBLE / queries)), 6) AS low,
 round(least(1, (p + 3.8416::DOUBLE / (2 * queries) + 1.96::DOUBLE * sqrt(p * (1 - p) / queries + 3.8416::DOUBLE / (4 * queries * queries))) / (1 + 3.8416::DOUBLE / queries)), 6) AS high, round(any_match, 6) AS any_match, round(no_match, 6) AS no_match, round(purity, 6) AS purity, round(depth, 6) AS depth,
 (SELECT round(avg(f1), 6) FROM dm) AS macro_f1, (SELECT round(ece, 6) FROM ec) AS ece, round(mean_matches, 6) AS mean_matches, median_matches, round(multi_leaf, 6) AS multi_leaf, round(posterior, 6) AS posterior,
 (SELECT coalesce(nullif(round(corr(depth, w), 6), 'NaN'::DOUBLE), 0) FROM mt) AS depth_corr FROM t""")
def met22(spark, sf):
    """The whole report of a routing test: every query is routed as for inference and judged by what its nodes hold in training."""
    return O.report(*judged(spark, sf)).select("queries", *[r6(F.col(c)).alias(c) for c in _FIGURES])


@register("met22_domain_scores", f"WITH RECURSIVE {_REPORT} SELECT CAST(label AS INTEGER) AS domain, support, round(prec, 6) AS prec, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM dm")
def met22_domains(spark, sf):
    d = O.per_domain(O.matches(*judged(spark, sf)))
    return d.select("domain", "support", *[r6(F.col(c)).alias(c) for c in ("prec", "recall", "f1")])


@register("met17_routing_ece", f"WITH RECURSIVE {_REPORT} SELECT round(ece, 6) AS ece, bins FROM ec")
def met17(spark, sf):
    return O.calibration_error(O.matches(*judged(spark, sf))).select(r6(F.col("ece")).alias("ece"), "bins")


@register("met23_routing_brier", f"""WITH RECURSIVE {_REPORT}, pp AS (SELECT vec_id, domain, max(w) AS p FROM mt GROUP BY ALL), al AS (SELECT vec_id, q.label, d.label AS d FROM q, (SELECT DISTINCT label FROM q) d)
 SELECT round(avg(b), 6) AS brier FROM (SELECT al.vec_id, sum(pow(coalesce(p, 0) - (label = d)::INT, 2)) AS b FROM al LEFT JOIN pp ON pp.vec_id = al.vec_id AND pp.domain = d GROUP BY al.vec_id)""")
def met23(spark, sf):
    return O.brier(*judged(spark, sf)).select(r6(F.col("brier")).alias("brier"))


_STARVED = NODES + f""",
 lv AS (SELECT label, 'a' || label // 4 AS parent, 'c' || label AS node FROM (SELECT DISTINCT label FROM q)),
 ld AS (SELECT lv.*, nd.mu, nd.kappa, nd.n FROM lv JOIN nd USING (node)),
 lo AS (SELECT * FROM ld WHERE n < (SELECT avg(n) FROM ld)),
 sb AS (SELECT a.node AS site, b.node, b.mu, avg(b.kappa) OVER (PARTITION BY a.node) AS kbar, row_number() OVER (PARTITION BY a.node ORDER BY round(list_dot_product(a.mu, b.mu), 9) DESC, b.node DESC) AS near FROM lo a JOIN ld b ON a.parent = b.parent AND a.node <> b.node),
 hm AS (SELECT vec_id, v, 'c' || label AS node FROM q),
 sp AS (SELECT vec_id, site, node, exp(kbar * (c - best)) / sum(exp(kbar * (c - best))) OVER (PARTITION BY vec_id, site) AS share
  FROM (SELECT *, max(c) OVER (PARTITION BY vec_id, site) AS best FROM (SELECT hm.vec_id, site, sb.node, kbar, round(list_dot_product(v, mu), 9) AS c FROM hm JOIN sb ON sb.site = hm.node)) WHERE round(best - c, 9) <= {RULES.margin}::DOUBLE),
 mm AS (SELECT '' AS state, vec_id, node AS cell, 1.0::DOUBLE AS w FROM hm UNION ALL SELECT 'p' || lo.node, vec_id, hm.node, 1.0::DOUBLE FROM lo, hm WHERE hm.node <> lo.node UNION ALL SELECT 'p' || site, vec_id, node, share FROM sp
  UNION ALL SELECT 'm' || lo.node, vec_id, CASE WHEN hm.node = lo.node THEN (SELECT node FROM sb WHERE site = lo.node AND near = 1) ELSE hm.node END, 1.0::DOUBLE FROM lo, hm),
 cn AS (SELECT state, cell, sum(w) AS n FROM mm GROUP BY ALL), cs AS (SELECT state, cell, i, sum(w * x) AS s FROM mm JOIN qx USING (vec_id) GROUP BY ALL),{_STATE},
 gn AS (SELECT node, n, (SELECT j FROM ob WHERE state = 'p' || node) - (SELECT j FROM ob WHERE state = '') AS gp, (SELECT j FROM ob WHERE state = 'm' || node) - (SELECT j FROM ob WHERE state = '') AS gm FROM lo)"""


@register("clu24_starved_choice", f"WITH {_STARVED} SELECT node, (SELECT node FROM sb WHERE site = gn.node AND near = 1) AS nearest, round(gp, 6) + 0 AS prune_gain, round(gm, 6) + 0 AS merge_gain, CASE WHEN greatest(gp, gm) <= 0 THEN 'keep' WHEN gp >= gm THEN 'prune' ELSE 'merge' END AS choice FROM gn")
def clu24(spark, sf):
    """Categories that hold less than the mean, under parents of four: keep, let the siblings take the members by their shares, or all the nearest one."""
    q = vectors(spark, sf).select("vec_id", "label", F.concat(F.lit("c"), F.col("label").cast("string")).alias("node"), F.lit(1.0).alias("weight"), "v")
    cells = P.Cells.read(q)
    nodes = {"root": Node("root", None, 0)}
    for name, cell in cells.of.items():
        mu, kappa = T.fit_of(*cell)
        up = f"a{int(name[1:]) // 4}"
        nodes |= {up: Node(up, "root", 1), name: Node(name, up, 2, tuple(mu), kappa, cell[0])}
    tree = Taxonomy(nodes)
    mean = sum(n for n, _ in cells.of.values()) / len(cells.of)
    beside = {x: [k for k in tree.children(nodes[x].parent) if k.name != x] for x, (n, _) in cells.of.items() if n < mean}
    prune, merge = P.starved_changes(q, tree, cells, {x: k for x, k in beside.items() if k}, RULES)
    rows = []
    for x in sorted(prune):
        p, m = cells.gain(prune[x]), cells.gain(merge[x][1])
        rows.append((x, merge[x][0], p, m, "keep" if max(p, m) <= 0 else "prune" if p >= m else "merge"))
    out = spark.createDataFrame(rows, "node string, nearest string, prune_gain double, merge_gain double, choice string")
    return out.select("node", "nearest", r6(F.col("prune_gain")).alias("prune_gain"), r6(F.col("merge_gain")).alias("merge_gain"), "choice")


def _level_sql(depth: int) -> str:
    """The fit of one level, from rg (node, parent, depth, i, n, s, q) and the level above, f{depth - 1}."""
    prior = f"{L.DEFAULT_KAPPA}::DOUBLE AS prior, CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END AS m0" if depth == 0 else "greatest(1, u.kappa) AS prior, u.mu AS m0"
    join = "" if depth == 0 else f" JOIN f{depth - 1} u ON u.node = rg.parent AND u.i = rg.i"
    return f""" e{depth} AS (SELECT rg.node, rg.i, rg.n, s, q, sqrt(sum(s * s) OVER (PARTITION BY rg.node)) AS size, {prior} FROM rg{join} WHERE rg.depth = {depth}),
 x{depth} AS (SELECT node, any_value(n) AS n0, floor(round(any_value(n), 6)) AS n, any_value(size) / any_value(n) AS r, any_value(prior) AS prior FROM e{depth} GROUP BY node),
 k{depth} AS MATERIALIZED (SELECT node, prior, n0, CASE WHEN n0 < {L.SUPPORT} THEN 1 WHEN 64 / n0 <= 2 THEN 0 WHEN 64 / n0 >= 10 THEN 1 ELSE (64 / n0 - 2) / 8 END AS alpha, kappa AS raw FROM ({_kappa(f"x{depth}")})),
 f{depth} AS (SELECT e.node, {depth} AS depth, e.i, e.n, s / size AS mu, k.alpha, CASE WHEN e.n < {L.SUPPORT} THEN k.prior ELSE (1 - k.alpha) * raw + k.alpha * k.prior END AS kappa, (m0 + s) / (1 + e.n) AS m,
  1 / (k.prior * 64) + q - s * s / e.n + e.n / (1 + e.n) * (s / e.n - m0) * (s / e.n - m0) AS lam FROM e{depth} e JOIN k{depth} k USING (node))"""


_LEVELS = WALK + f""",
 tm AS (SELECT vec_id, node, share / sum(share) OVER (PARTITION BY vec_id) AS w FROM kp),
 tr AS (SELECT node, parent, depth FROM nd UNION ALL SELECT 'root', NULL, 0),
 cl AS (SELECT node, node AS anc FROM tr UNION ALL SELECT node, parent FROM nd UNION ALL SELECT node, 'root' FROM nd WHERE depth = 2),
 rg AS (SELECT anc AS node, t.parent, t.depth, i, sum(w) AS n, sum(w * x) AS s, sum(w * x * x) AS q FROM tm JOIN cl USING (node) JOIN tr t ON t.node = anc JOIN qx USING (vec_id) GROUP BY ALL),{_level_sql(0)},{_level_sql(1)},{_level_sql(2)}"""


@register("clu03_level_fit", f"""WITH RECURSIVE {_LEVELS} SELECT node, depth, round(any_value(n), 6) AS n, round(max(CASE WHEN i = 0 THEN mu END), 6) AS mu0, round(any_value(kappa), 5) AS kappa, round(any_value(alpha), 6) AS alpha, round(sum(m), 6) AS niw_m_sum,
 round(1 + any_value(n), 6) AS niw_kappa, round(66 + any_value(n), 6) AS niw_nu, round(sum(ln(greatest(lam, 1e-9))), 4) AS log_volume FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2) GROUP BY node, depth""")
def clu03(spark, sf):
    """Every node of the tree of categories and leaves, fitted to what it holds after routing: directions, concentrations and posteriors."""
    q = queries(spark, sf)
    tree = category_tree(q)
    members = R.route(q, tree, RULES, training=True).join(q.select("vec_id", "v"), "vec_id")
    nodes = spark.createDataFrame([(n.name, n.depth) for n in tree.nodes.values()], "node string, depth int")
    edges = spark.createDataFrame([(n.parent, n.name) for n in tree.nodes.values() if n.parent is not None], "p string, c string")
    f = L.fit_levels(members, nodes, edges, 64)
    whole = lambda c, one: F.aggregate(c, F.lit(0.0), lambda a, x: a + one(x))
    return f.select("node", "depth", r6(F.col("n")).alias("n"), r6(F.col("mu")[0]).alias("mu0"), F.round("kappa", 5).alias("kappa"), r6(F.col("alpha")).alias("alpha"), r6(whole("niw_m", lambda x: x)).alias("niw_m_sum"),
                    r6(F.col("niw_kappa")).alias("niw_kappa"), r6(F.col("niw_nu")).alias("niw_nu"), F.round(whole("niw_lambda", lambda x: F.ln(F.greatest(x, F.lit(1e-9)))), 4).alias("log_volume"))
