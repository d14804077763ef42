"""The utility scheduler over pair statistics by domain and block of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.operators import scheduling as T
from canopyrank.plans.base import MATCH, matches, r6
from canopyrank.plans.evaluation import pair_stats
from canopyrank.plans.registry import register

LEAVES = 200  # blocks of events in a domain, each a leaf with statistics of its own
BUDGET = 150  # comparisons a pair may use in a leaf
BATCH, SHARE, CAP = 200, 3, 20

_UTILITY = f"""{MATCH}, lp AS (SELECT domain || '-' || event_id % {LEAVES} AS leaf, least(a, b) AS a, greatest(a, b) AS b, sum(CASE WHEN a < b THEN wa ELSE wb END) AS wins_a, sum(CASE WHEN a < b THEN wb ELSE wa END) AS wins_b, sum(tie) AS ties, count(*) AS n FROM mt GROUP BY ALL),
 md AS (SELECT leaf, m, sum(w) + 1 AS w, sum(l) + 1 AS l FROM (SELECT leaf, a AS m, wins_a + ties / 2 AS w, wins_b + ties / 2 AS l FROM lp UNION ALL SELECT leaf, b, wins_b + ties / 2, wins_a + ties / 2 FROM lp) GROUP BY ALL),
 st AS (SELECT leaf, m, ln(w / l) AS s, sqrt(1 / w + 1 / l) AS se FROM md), ro AS (SELECT DISTINCT m FROM st),
 nd AS (SELECT leaf, count(*) AS k, avg(se) AS mse, greatest(1.06::DOUBLE * greatest(stddev_pop(s), 1e-6::DOUBLE) * pow(count(*)::DOUBLE, -0.2::DOUBLE), 1e-4::DOUBLE) AS h, list_sort(list(s))[count(*) // 2 + 1] AS gm FROM st GROUP BY leaf),
 rs AS (SELECT x.leaf, count(*) AS r FROM st x JOIN st y ON y.leaf = x.leaf AND y.m > x.m WHERE abs(x.s - y.s) >= 3 * (x.se + y.se) GROUP BY x.leaf),
 dn AS (SELECT leaf, max(d) AS top FROM (SELECT x.leaf, x.m, sum(exp(-0.5::DOUBLE * pow((y.s - x.s) / h, 2))) AS d FROM st x JOIN st y ON y.leaf = x.leaf JOIN nd ON nd.leaf = x.leaf GROUP BY ALL) GROUP BY leaf),
 pr AS (SELECT nd.leaf, x.m AS a, y.m AS b, (SELECT count(*) * (count(*) - 1) / 2 FROM ro) AS pairs FROM nd, ro x, ro y WHERE y.m > x.m),
 sn AS (SELECT DISTINCT a, b FROM lp),
 c AS (SELECT pr.*, coalesce(lp.n, 0) AS n, sn.a IS NULL AS fresh, coalesce(ties, 0) AS ties, coalesce(wins_a + wins_b + ties, 0) AS tot, i.s AS si, j.s AS sj, i.se AS ei, j.se AS ej FROM pr LEFT JOIN lp ON lp.leaf = pr.leaf AND lp.a = pr.a AND lp.b = pr.b
  LEFT JOIN sn ON sn.a = pr.a AND sn.b = pr.b LEFT JOIN st i ON i.leaf = pr.leaf AND i.m = pr.a LEFT JOIN st j ON j.leaf = pr.leaf AND j.m = pr.b),
 kb AS (SELECT c.leaf, c.a, c.b, sum(exp(-0.5::DOUBLE * pow((z.s - (si + sj) / 2) / h, 2))) AS d, count(*) FILTER (WHERE z.s BETWEEN least(si, sj) AND greatest(si, sj)) AS br FROM c JOIN st z ON z.leaf = c.leaf JOIN nd ON nd.leaf = c.leaf WHERE si IS NOT NULL AND sj IS NOT NULL GROUP BY ALL),
 v AS (SELECT c.leaf, c.a, c.b, n, fresh, si IS NULL OR sj IS NULL AS new, ties, tot, 0.2::DOUBLE + 0.8::DOUBLE * exp(-2.5::DOUBLE * (0.35::DOUBLE * greatest(0, 1 - mse / 10) + 0.65::DOUBLE * coalesce(r, 0) / pairs)) AS alpha,
  CASE WHEN k < 3 THEN 1 ELSE 0.6::DOUBLE * br / k + 0.4::DOUBLE * exp(-0.5::DOUBLE * pow(((si + sj) / 2 - gm) / (ei + ej), 2)) END AS structure,
  CASE WHEN abs(si - sj) >= 4 * (ei + ej) THEN 0 WHEN abs(si - sj) < 0.15::DOUBLE * (ei + ej) THEN abs(si - sj) / (0.15::DOUBLE * (ei + ej)) WHEN k < 3 THEN 1 ELSE greatest(0.1::DOUBLE, 1 - d / top) END AS weight,
  1 / (1 + exp(sj - si)) AS p, ei * ei + ej * ej AS spread FROM c JOIN nd ON nd.leaf = c.leaf JOIN dn ON dn.leaf = c.leaf LEFT JOIN rs ON rs.leaf = c.leaf LEFT JOIN kb ON kb.leaf = c.leaf AND kb.a = c.a AND kb.b = c.b WHERE n < {BUDGET}),
 u AS (SELECT leaf, a, b, n, fresh, round(CASE WHEN new THEN ln(2::DOUBLE) + 1 + (10 - least(n, 10)) * 0.1::DOUBLE
  ELSE (alpha * structure + (1 - alpha) * -(p * ln(p) + (1 - p) * ln(1 - p)) * spread * weight) * (1 - 0.3::DOUBLE * n / {BUDGET}) * CASE WHEN tot > 0 AND ties >= 0.55::DOUBLE * tot THEN 0 ELSE 1 END END, 9) AS utility FROM v)"""


def candidates(spark, sf):
    leaf = F.concat(F.col("domain"), F.lit("-"), (F.col("event_id") % LEAVES).cast("string"))
    stats = pair_stats(matches(spark, sf).withColumn("domain", leaf)).withColumnRenamed("domain", "leaf")
    return T.pair_utilities(stats, T.counted_states(stats, "leaf"), "leaf", BUDGET)


@register("rat12_pair_utility", f"WITH {_UTILITY} SELECT leaf, a, b, n, fresh, round(utility, 6) AS utility FROM u")
def rat12(spark, sf):
    """What each pair with budget left is worth in each leaf, scores taken from counts."""
    return candidates(spark, sf).withColumns({"n": F.col("n").cast("long"), "utility": r6(F.col("utility"))})


@register("rat12_utility_batch", f"""WITH {_UTILITY}, t AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY utility DESC, leaf) - 1 AS turn FROM u),
 sd AS (SELECT leaf, a, b, row_number() OVER (PARTITION BY leaf, m ORDER BY utility DESC, a, b) - 1 AS here, row_number() OVER (PARTITION BY m ORDER BY utility DESC, leaf, a, b) - 1 AS al FROM (SELECT *, unnest([a, b]) AS m FROM u)),
 lo AS (SELECT leaf, a, b, max(here) AS here, max(al) AS al FROM sd GROUP BY ALL),
 lp2 AS (SELECT t.leaf, t.a, t.b, fresh, utility, CAST(greatest(here, turn // {SHARE}, al // {CAP}) AS BIGINT) AS lap FROM t JOIN lo ON lo.leaf = t.leaf AND lo.a = t.a AND lo.b = t.b),
 pl AS (SELECT *, row_number() OVER (ORDER BY fresh DESC, lap, utility DESC, leaf, a, b) AS place FROM lp2)
 SELECT leaf, a, b, round(utility, 6) AS utility, lap, place FROM pl WHERE place <= {BATCH}""")
def rat12_batch(spark, sf):
    """The next comparisons under fair shares."""
    return T.allot(candidates(spark, sf), "leaf", BATCH, SHARE, CAP).withColumn("utility", r6(F.col("utility")))
