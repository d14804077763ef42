"""Leaderboards with intervals over the leaves of a subtree."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.operators import leaderboard as L
from canopyrank.operators import ratings as R
from canopyrank.plans.base import MATCH, matches, r6
from canopyrank.plans.evaluation import pair_stats
from canopyrank.plans.registry import register

#: Leaves of a domain, matches that a leaf needs here, and queries: so many matches in a row ask the same.
SPREAD, LEAST, RUN = 16, 20, 5

_W = " + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in L.poisson_bounds())
_HEX = " || ".join(f"md5('{L.SEED}:' || q || ':{k}')" for k in range(-(-L.REPLICATES * L.DIGITS // 32)))
_BOARD = MATCH + f""",
 lm AS (SELECT domain || '/' || (event_id % {SPREAD}) AS leaf, domain, event_id // {RUN} AS q, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a < b THEN wa ELSE wb END + tie AS pa, CASE WHEN a < b THEN wb ELSE wa END + tie AS pb,
  event_id % 3 = 0 AS checked, value > 20 + event_id % {SPREAD} * 3 AS agreed FROM mt WHERE event_id % {SPREAD} < 12 OR event_id < 3000),
 wt AS (SELECT q, r, {_W} AS w FROM (SELECT q, r, CAST('0x' || substr(h, r * {L.DIGITS} + 1, {L.DIGITS}) AS INTEGER) AS u FROM (SELECT q, {_HEX} AS h FROM (SELECT DISTINCT q FROM lm)), (SELECT unnest(range({L.REPLICATES})) AS r))),
 lp AS (SELECT leaf, domain, a, b, count(*) AS n, count(*) FILTER (WHERE checked) AS checks, count(*) FILTER (WHERE checked AND agreed) AS agreed FROM lm GROUP BY ALL),
 lf AS (SELECT leaf, domain, sum(n) AS n, max(CASE WHEN checks >= {LEAST} AND agreed / checks < 0.5 THEN 1 ELSE 0 END) AS torn FROM lp GROUP BY ALL),
 al AS (SELECT DISTINCT event_type || '/' || k AS leaf, event_type AS domain FROM events, (SELECT unnest(range({SPREAD})) AS k)),
 gl AS (SELECT 'root' AS grp, leaf FROM al UNION ALL SELECT domain, leaf FROM al),
 st AS (SELECT grp, count(*) AS leaves, count(*) FILTER (WHERE n >= {LEAST}) AS eligible, sum(CASE WHEN n >= {LEAST} THEN n ELSE 0 END) AS comparisons FROM gl LEFT JOIN lf USING (leaf) GROUP BY grp),
 md AS (SELECT DISTINCT grp, m FROM (SELECT grp, unnest([a, b]) AS m FROM gl JOIN lf USING (leaf) JOIN lp USING (leaf) WHERE lf.n >= {LEAST})),
 us AS (SELECT grp, q, a, b, pa, pb FROM gl JOIN lf USING (leaf) JOIN lm USING (leaf) WHERE lf.n >= {LEAST} AND torn = 0),
 rp AS (SELECT grp, -1 AS r, a, b, sum(pa) AS x, sum(pb) AS y FROM us GROUP BY ALL UNION ALL SELECT grp, r, a, b, sum(w * (pa + {L.PRIOR}::DOUBLE)), sum(w * (pb + {L.PRIOR}::DOUBLE)) FROM us JOIN wt USING (q) GROUP BY ALL),
 wm AS (SELECT grp, r, a AS i, b AS j, x AS w, x + y AS n FROM rp UNION ALL SELECT grp, r, b, a, y, x + y FROM rp),
 tw AS (SELECT grp, r, i, sum(w) AS w FROM wm GROUP BY ALL),
 bt AS (SELECT grp, m AS i, r, 0.0::DOUBLE AS s, 0 AS it FROM md, (SELECT unnest(range(-1, {L.REPLICATES})) AS r) UNION ALL
  SELECT grp, i, r, x - avg(x) OVER (PARTITION BY grp, r), it + 1 FROM (
   SELECT u.grp, u.i, u.r, u.it, CASE WHEN max(tw.w) > 0 AND sum(wm.n) > 0 THEN ln(max(tw.w) / sum(wm.n / (exp(u.s) + exp(v.s)))) ELSE max(u.s) END AS x
   FROM bt u LEFT JOIN wm ON wm.grp = u.grp AND wm.i = u.i AND wm.r = u.r LEFT JOIN bt v ON v.grp = wm.grp AND v.i = wm.j AND v.r = wm.r LEFT JOIN tw ON tw.grp = u.grp AND tw.i = u.i AND tw.r = u.r
   WHERE u.it < CASE WHEN u.r < 0 THEN {L.ROUNDS} ELSE {L.REPLICATE_ROUNDS} END GROUP BY u.grp, u.i, u.r, u.it)),
 sc AS (SELECT grp, i, s FROM bt WHERE r < 0 AND it = {L.ROUNDS}),
 se AS (SELECT grp, i, least({L.SE_BOUNDS[1]}, greatest({L.SE_BOUNDS[0]}, stddev_samp(s))) AS se FROM bt WHERE r >= 0 AND it = {L.REPLICATE_ROUNDS} GROUP BY grp, i)"""


def leaf_matches(spark, sf):
    """Matches spread over leaves of their domain, with a query and a check of the judge; the last leaves have few."""
    no = F.col("event_id") % SPREAD
    m = matches(spark, sf).filter((no < 12) | (F.col("event_id") < 3000))
    return m.select(F.concat("domain", F.lit("/"), no.cast("string")).alias("leaf"), F.expr(f"event_id div {RUN}").alias("query_id"), "a", "b", "wa", "wb", "tie", (F.col("event_id") % 3 == 0).alias("checked"), (F.col("value") > 20 + no * 3).alias("agreed"))


def subtree_leaves(spark, sf):
    """group, leaf: every leaf below the root and below its domain."""
    d = matches(spark, sf).select("domain").distinct()
    leaf = d.select("domain", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("k")).select("domain", F.concat("domain", F.lit("/"), F.col("k").cast("string")).alias("leaf"))
    return leaf.select(F.explode(F.array(F.lit("root"), F.col("domain"))).alias("group"), "leaf")


@register("rat08_pooled_leaderboard", f"""WITH RECURSIVE {_BOARD} SELECT grp AS "group", i AS model, round(s, 6) AS score, round(se, 6) AS se, round(s - 2 * se, 6) AS low, round(s + 2 * se, 6) AS high,
 row_number() OVER (PARTITION BY grp ORDER BY round(s, 9) DESC, i) AS rank, leaves, eligible, CAST(comparisons AS BIGINT) AS comparisons, eligible / leaves >= {L.RELIABLE} AS reliable FROM sc JOIN se USING (grp, i) JOIN st USING (grp)""")
def rat08(spark, sf):
    got = L.pooled_leaderboard(L.leaf_pairs(leaf_matches(spark, sf)), subtree_leaves(spark, sf), LEAST)
    return got.select("group", "model", *[r6(c).alias(c) for c in ("score", "se", "low", "high")], "rank", "leaves", "eligible", "comparisons", "reliable")


@register("hlp07_root_leaderboard", f"""WITH RECURSIVE {_BOARD} SELECT i AS model, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 9) DESC, i) AS rank FROM sc WHERE grp = 'root'""")
def hlp07(spark, sf):
    return rat08(spark, sf).filter(F.col("group") == "root").select("model", "score", "rank")


@register("rat08_replicate_weights", f"WITH {MATCH}, k AS (SELECT DISTINCT event_id // {RUN} AS q FROM mt) SELECT q AS query_id, r AS replicate, CAST({_W} AS INTEGER) AS weight FROM (SELECT q, r, CAST('0x' || substr(h, r * {L.DIGITS} + 1, {L.DIGITS}) AS INTEGER) AS u FROM (SELECT q, {_HEX} AS h FROM k), (SELECT unnest(range({L.REPLICATES})) AS r))")
def rat08_weights(spark, sf):
    q = matches(spark, sf).select(F.expr(f"event_id div {RUN}").alias("query_id")).distinct()
    return q.select("query_id", F.posexplode(L.replicate_weights(F.col("query_id"))).alias("replicate", "weight")).withColumn("replicate", F.col("replicate").cast("long"))


#: Matches that a pair may use in a leaf, and queries that a leaf needs to be compared in.
PAIR_BUDGET, LEAST_QUERIES = 40, 5


@register("top05_target_nodes")
def top05(spark, sf):
    """The leaves to compare in next: a report of 100 at most. Tested against a plain sort."""
    m = leaf_matches(spark, sf)
    stats = pair_stats(m.withColumnRenamed("leaf", "domain")).withColumnRenamed("domain", "leaf")
    asked = m.groupBy("leaf").agg(F.countDistinct("query_id").alias("queries"))
    return R.target_nodes(stats, asked, "leaf", PAIR_BUDGET, LEAST_QUERIES).withColumn("mean_se", r6(F.col("mean_se")))
