"""Scheduling of comparisons, budgets and the grouped leaderboard, over pair statistics by domain."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.operators import graph as G
from canopyrank.operators import ratings as R
from canopyrank.plans.base import MATCH, matches, r6
from canopyrank.plans.evaluation import pair_stats
from canopyrank.plans.rating_plans import _BT, _DOM, dominance, rat13, two_scores
from canopyrank.plans.registry import register

BUDGET = 150  # comparisons a pair may use
STABLE = 0.55  # win probability from which a pair needs no more; the default of the rule is 0.88, which no pair of the given tables reaches
TIED = 0.55


@register("rat07_grouped_leaderboard", f"""WITH RECURSIVE {_DOM}, v AS (SELECT p AS m FROM dom UNION SELECT c FROM dom),
 sc AS (SELECT m, least(m, coalesce(min(r.y), m)) AS scc FROM v LEFT JOIN (SELECT a.x, a.y FROM rc a JOIN rc b ON a.x = b.y AND a.y = b.x) r ON r.x = m GROUP BY m),
 ah AS (SELECT s.scc, count(DISTINCT CASE WHEN t.scc <> s.scc THEN rc.x END) AS ahead, count(DISTINCT s.m) AS size FROM sc s LEFT JOIN rc ON rc.y = s.m LEFT JOIN sc t ON t.m = rc.x GROUP BY s.scc),
 rk AS (SELECT scc, 1 + coalesce(sum(size) OVER (ORDER BY ahead, scc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rank FROM ah) SELECT m AS model, scc, CAST(rank AS BIGINT) AS rank FROM sc JOIN rk USING (scc)""")
def rat07(spark, sf):
    """Models that beat each other in a circle share a rank; groups follow in topological order, the rank grows by the group's size.

    A group that beats another is beaten by fewer models, so the number of models ahead orders the groups.
    """
    e = dominance(spark, sf)
    scc = G.strongly_connected(e)
    above = G.closure(e).filter("d > 0").join(scc, "node").join(scc.select(F.col("node").alias("anc"), F.col("scc").alias("other")), "anc")
    ahead = above.filter("other <> scc").groupBy("scc").agg(F.countDistinct("anc").alias("ahead"))
    size = scc.groupBy("scc").agg(F.count("*").alias("size")).join(ahead, "scc", "left").fillna(0, ["ahead"])
    # one row a group of models
    before = F.sum("size").over(W.partitionBy(F.lit(0)).orderBy("ahead", "scc").rowsBetween(W.unboundedPreceding, -1))
    rank = size.select("scc", (1 + F.coalesce(before, F.lit(0))).cast("long").alias("rank"))
    return scc.join(F.broadcast(rank), "scc").select(F.col("node").alias("model"), "scc", "rank")


@register("grf14_component_order", f"""WITH RECURSIVE {_DOM}, v AS (SELECT p AS m FROM dom UNION SELECT c FROM dom),
 sc AS (SELECT m, least(m, coalesce(min(r.y), m)) AS scc FROM v LEFT JOIN (SELECT a.x, a.y FROM rc a JOIN rc b ON a.x = b.y AND a.y = b.x) r ON r.x = m GROUP BY m),
 ce AS (SELECT DISTINCT s.scc AS p, t.scc AS c FROM dom JOIN sc s ON s.m = dom.p JOIN sc t ON t.m = dom.c WHERE s.scc <> t.scc),
 lv AS (SELECT DISTINCT scc, 0 AS level FROM sc UNION SELECT ce.c, level + 1 FROM lv JOIN ce ON ce.p = lv.scc),
 top AS (SELECT scc, max(level) AS level FROM lv GROUP BY scc)
 SELECT m AS model, scc, CAST(level AS BIGINT) AS level, dense_rank() OVER (ORDER BY level, scc) AS place FROM sc JOIN top USING (scc)""")
def grf14(spark, sf):
    """Groups of models that beat each other in a circle, winners first; of groups on one level the smallest name first."""
    order = G.component_order(dominance(spark, sf))
    # one row a model
    place = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("level", "scc")).cast("long")
    return order.select(F.col("node").alias("model"), "scc", "level", place.alias("place"))


@register("rat15_convergence_debt")
def rat15(spark, sf):
    """Pairs of each domain that still need matches."""
    return R.convergence_debt(pair_stats(matches(spark, sf)), "domain", BUDGET)


@register("rat10_racing", f"""WITH {MATCH}, sc AS (SELECT domain, m, sum(p) AS s FROM (SELECT domain, a AS m, (wins_a + ties / 2) / n AS p FROM ps UNION ALL SELECT domain, b, 1 - (wins_a + ties / 2) / n FROM ps) GROUP BY ALL),
 rk AS (SELECT domain, m, row_number() OVER (PARTITION BY domain ORDER BY round(s, 9) DESC, m) AS r, count(*) OVER (PARTITION BY domain) AS k FROM sc),
 aj AS (SELECT x.domain, x.m AS hi, y.m AS lo, coalesce(p.n, 0) AS n, abs((wins_a + ties / 2) / p.n - 0.5) AS gap, sqrt(ln(2 * (x.k * (x.k - 1) / 2) * {BUDGET} / 0.05::DOUBLE) / (2 * p.n)) AS eps FROM rk x JOIN rk y ON y.domain = x.domain AND y.r = x.r + 1 LEFT JOIN ps p ON p.domain = x.domain AND p.a = least(x.m, y.m) AND p.b = greatest(x.m, y.m))
 SELECT domain, hi, lo, n, coalesce(round(eps - gap, 6), 1.0::DOUBLE) AS overlap, coalesce(n >= 5 AND gap > eps, false) OR n >= {BUDGET} AS terminal, row_number() OVER (PARTITION BY domain ORDER BY coalesce(round(eps - gap, 6), 1.0::DOUBLE) DESC, hi) AS turn FROM aj""")
def rat10(spark, sf):
    """Neighbours by empirical score, the pair whose confidence bounds overlap most first; an unseen pair overlaps wholly."""
    p = pair_stats(matches(spark, sf)).withColumn("ph", (F.col("wins_a") + F.col("ties") / 2) / F.col("n"))
    s = p.select("domain", F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("ph").alias("p")), F.struct(F.col("b").alias("m"), (1 - F.col("ph")).alias("p")))).alias("x")).groupBy("domain", "x.m").agg(F.sum("x.p").alias("s"))
    by = W.partitionBy("domain")
    order = by.orderBy(F.desc(F.round("s", 9)), "m")
    aj = s.select("domain", F.col("m").alias("hi"), F.lead("m").over(order).alias("lo"), F.count("*").over(by).alias("k")).filter("lo IS NOT NULL").withColumns({"a": F.least("hi", "lo"), "b": F.greatest("hi", "lo")})
    k, n = F.col("k"), F.coalesce("n", F.lit(0))
    eps, gap = F.sqrt(F.ln(2 * (k * (k - 1) / 2) * BUDGET / 0.05) / (2 * F.col("n"))), F.abs(F.col("ph") - 0.5)
    j = aj.join(p.select("domain", "a", "b", "n", "ph"), ["domain", "a", "b"], "left").select(
        "domain", "hi", "lo", n.alias("n"), F.coalesce(r6(eps - gap), F.lit(1.0)).alias("overlap"), (F.coalesce((n >= 5) & (gap > eps), F.lit(False)) | (n >= BUDGET)).alias("terminal"))
    return j.withColumn("turn", F.row_number().over(by.orderBy(F.desc("overlap"), "hi")).cast("long"))


@register("rat11_random_pair", f"WITH {MATCH}, h AS (SELECT domain, a, b, md5('42' || domain || a || b) AS h FROM ps) SELECT domain, arg_min(a, h) AS a, arg_min(b, h) AS b FROM h GROUP BY domain")
def rat11(spark, sf):
    h = F.struct(F.md5(F.concat(F.lit("42"), "domain", "a", "b")).alias("h"), "a", "b")
    return pair_stats(matches(spark, sf)).groupBy("domain").agg(F.min(h).alias("m")).select("domain", "m.a", "m.b")


@register("rat14_budget_release", f"""WITH RECURSIVE {_BT}, z AS MATERIALIZED (SELECT domain, i, round(s, 6) AS s FROM bt WHERE it = 30), c AS (SELECT p.domain, p.a, p.b, p.n, ties, greatest(1 / (1 + exp(y.s - x.s)), 1 - 1 / (1 + exp(y.s - x.s))) AS conf FROM ps p JOIN z x ON x.domain = p.domain AND x.i = p.a JOIN z y ON y.domain = p.domain AND y.i = p.b),
 st AS (SELECT *, CASE WHEN conf >= {STABLE}::DOUBLE THEN 'stable' WHEN ties / n >= {TIED}::DOUBLE THEN 'irresolvable' ELSE 'open' END AS status FROM c),
 pl AS (SELECT *, sum(CASE WHEN status <> 'open' THEN greatest(0, {BUDGET} - n) ELSE 0 END) OVER (PARTITION BY domain) AS pool, ties = max(CASE WHEN status = 'open' THEN ties END) OVER (PARTITION BY domain) AND status = 'open' AS best FROM st),
 sh AS (SELECT *, count(*) FILTER (WHERE best) OVER (PARTITION BY domain) AS m, row_number() OVER (PARTITION BY domain, best ORDER BY a, b) - 1 AS i FROM pl)
 SELECT domain, a, b, status, CAST(CASE WHEN status <> 'open' THEN n WHEN best THEN {BUDGET} + pool // m + CASE WHEN i < pool % m THEN 1 ELSE 0 END ELSE {BUDGET} END AS BIGINT) AS budget FROM sh""")
def rat14(spark, sf):
    """Settled pairs give back what they have not used, and the open pairs that are hardest to tell apart (here: most ties) share it, remainders in order."""
    p = pair_stats(matches(spark, sf))
    z = R.fit_pairs(p, "domain", rounds=30).select("domain", "model", r6(F.col("score")).alias("s"))
    side = lambda k, n: z.select("domain", F.col("model").alias(k), F.col("s").alias(n))
    c = p.join(side("a", "sa"), ["domain", "a"]).join(side("b", "sb"), ["domain", "b"])
    w = 1 / (1 + F.exp(F.col("sb") - F.col("sa")))
    status = F.when(F.greatest(w, 1 - w) >= STABLE, "stable").when(F.col("ties") / F.col("n") >= TIED, "irresolvable").otherwise("open")
    by, free = W.partitionBy("domain"), F.col("status") == "open"
    st = c.withColumn("status", status)
    st = st.withColumn("pool", F.sum(F.when(~free, F.greatest(F.lit(0), BUDGET - F.col("n"))).otherwise(0)).over(by)).withColumn("best", F.coalesce(free & (F.col("ties") == F.max(F.when(free, F.col("ties"))).over(by)), F.lit(False)))
    st = st.withColumn("m", F.sum(F.col("best").cast("int")).over(by)).withColumn("i", F.row_number().over(W.partitionBy("domain", "best").orderBy("a", "b")) - 1)
    extra = F.expr("pool div m + CASE WHEN i < pool % m THEN 1 ELSE 0 END")
    return st.select("domain", "a", "b", "status", F.when(~free, F.col("n")).when(F.col("best"), BUDGET + extra).otherwise(F.lit(BUDGET)).cast("long").alias("budget"))


@register("rat16_priority_queue", f"WITH {MATCH}, u AS (SELECT domain, a, b, round(-(p * ln(p) + (1 - p) * ln(1 - p)) * p * (1 - p), 6) AS utility, ties / n >= 0.55 AS masked FROM (SELECT *, (wins_a + 1) / (wins_a + wins_b + 2) AS p FROM ps)) SELECT domain, a, b, row_number() OVER (PARTITION BY domain ORDER BY utility DESC, a, b) AS place FROM u WHERE NOT masked")
def rat16(spark, sf):
    return rat13(spark, sf).filter("NOT masked").select("domain", "a", "b", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("utility"), "a", "b")).cast("long").alias("place"))


@register("sta07_permutation_test")
def sta07(spark, sf):
    """Brands of parts: does the price follow the size better than the key does?"""
    t = two_scores(spark, sf).withColumn("z", (F.col("id") % 7).cast("double"))
    return R.permutation_test(t, "k", "x", "y", "z")
