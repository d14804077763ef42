"""Leaderboards, rank correlation, tests and tuning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.functions import scalars as S
from canopyrank.operators import graph as G
from canopyrank.operators import ratings as R
from canopyrank.plans.base import EVAL, MATCH, evals, matches, r6
from canopyrank.plans.evaluation import pair_stats
from canopyrank.plans.registry import register
from canopyrank.session import table

_BT = MATCH + """,
 wm AS (SELECT domain, a AS i, b AS j, wins_a + ties / 2 AS w, n::DOUBLE AS n FROM ps UNION ALL SELECT domain, b, a, wins_b + ties / 2, n::DOUBLE FROM ps),
 tw AS (SELECT domain, i, sum(w) AS w FROM wm GROUP BY ALL),
 bt AS (SELECT domain, i, 0.0::DOUBLE AS s, 0 AS it FROM tw UNION ALL
  SELECT domain, i, x - avg(x) OVER (PARTITION BY domain), it + 1 FROM (
   SELECT u.domain, u.i, u.it, CASE WHEN max(tw.w) > 0 THEN ln(max(tw.w) / sum(wm.n / (exp(u.s) + exp(v.s)))) ELSE max(u.s) END AS x
   FROM bt u JOIN wm ON wm.domain = u.domain AND wm.i = u.i JOIN bt v ON v.domain = wm.domain AND v.i = wm.j JOIN tw ON tw.domain = u.domain AND tw.i = u.i WHERE u.it < 30 GROUP BY u.domain, u.i, u.it))"""


@register("rat01_bradley_terry", f"WITH RECURSIVE {_BT} SELECT domain, i AS model, round(s, 6) AS score FROM bt WHERE it = 30")
def rat01(spark, sf):
    return R.fit_pairs(pair_stats(matches(spark, sf)), "domain", rounds=30).select("domain", "model", r6(F.col("score")).alias("score"))


@register("rat02_standard_errors")
def rat02(spark, sf):
    return R.fit_pairs(pair_stats(matches(spark, sf)), "domain").select("domain", "model", r6(F.col("se")).alias("se"))


@register("rat04_online_ratings")
def rat04(spark, sf):
    m = matches(spark, sf).withColumn("conf", F.round(0.5 + F.pmod("event_id", F.lit(50)) / 100.0, 6))
    return R.ratings(m).select("domain", "agent", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"), r6(F.col("ordinal")).alias("ordinal"))


@register("rat06_ratings_with_default", "SELECT c_custkey, CASE WHEN o.k > 0 THEN 20 + o.k ELSE 25.0::DOUBLE END AS mu, round(CASE WHEN o.k > 0 THEN 8.0::DOUBLE / o.k ELSE 25.0::DOUBLE / 3 END, 6) AS sigma FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def rat06(spark, sf):
    """Who has a rating (here: made from the number of orders) keeps it, everyone else starts from the default."""
    k = F.count("*")
    known = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((20 + k).cast("double").alias("m"), (F.lit(8.0) / k).alias("s"))
    return table(spark, sf, "customer").join(known, "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(R.MU)).alias("mu"), r6(F.coalesce("s", F.lit(R.SIGMA))).alias("sigma"))


_DOM = MATCH + """, pool AS (SELECT a, b, sum(wins_a) AS wa, sum(wins_b) AS wb FROM ps GROUP BY a, b),
 dom AS (SELECT CASE WHEN wa > wb THEN a ELSE b END AS p, CASE WHEN wa > wb THEN b ELSE a END AS c FROM pool WHERE wa <> wb),
 rc AS (SELECT p AS x, c AS y FROM dom UNION SELECT rc.x, dom.c FROM rc JOIN dom ON rc.y = dom.p)"""


def dominance(spark, sf):
    """Edges winner to loser over pooled pairs: p, c."""
    pool = pair_stats(matches(spark, sf)).groupBy("a", "b").agg(F.sum("wins_a").alias("x"), F.sum("wins_b").alias("y")).filter("x <> y")
    first = F.col("x") > F.col("y")
    e = pool.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("c"))
    # an edge for two models at most: kept as values, so that the closure's levels do not read the matches again
    return spark.createDataFrame(e.collect(), e.schema).coalesce(1)


@register("grf15_dominance_graph", f"WITH RECURSIVE {_DOM} SELECT p AS winner, c AS loser FROM dom")
def grf15(spark, sf):
    return dominance(spark, sf).select(F.col("p").alias("winner"), F.col("c").alias("loser"))


@register("grf13_strong_components", f"WITH RECURSIVE {_DOM}, v AS (SELECT p AS m FROM dom UNION SELECT c FROM dom) SELECT m AS node, least(m, coalesce(min(r.y), m)) AS scc FROM v LEFT JOIN (SELECT a.x, a.y FROM rc a JOIN rc b ON a.x = b.y AND a.y = b.x) r ON r.x = m GROUP BY m")
def grf13(spark, sf):
    e = dominance(spark, sf)
    return G.strongly_connected(e)


@register("rat18_resolved_pairs", f"WITH RECURSIVE {_BT}, z AS (SELECT domain, i, s FROM bt WHERE it = 30) SELECT x.domain, x.i AS a, y.i AS b, round(abs(x.s - y.s), 6) AS gap FROM z x JOIN z y ON x.domain = y.domain AND x.i < y.i WHERE round(abs(x.s - y.s), 6) > 0.1")
def rat18(spark, sf):
    z = R.fit_pairs(pair_stats(matches(spark, sf)), "domain", rounds=30)
    x, y = z.alias("x"), z.alias("y")
    j = x.join(y, (F.col("x.domain") == F.col("y.domain")) & (F.col("x.model") < F.col("y.model")))
    return j.select("x.domain", F.col("x.model").alias("a"), F.col("y.model").alias("b"), r6(F.abs(F.col("x.score") - F.col("y.score"))).alias("gap")).filter("gap > 0.1")


@register("rat09_node_leaderboard", f"WITH RECURSIVE {_BT} SELECT domain, i AS model, row_number() OVER (PARTITION BY domain ORDER BY round(s, 6) DESC, i) AS rank FROM bt WHERE it = 30")
def rat09(spark, sf):
    z = R.fit_pairs(pair_stats(matches(spark, sf)), "domain", rounds=30).withColumn("s", r6(F.col("score")))
    return z.select("domain", "model", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("s"), "model")).cast("long").alias("rank"))


# rank correlation between two score columns by group


_TWO = "xy AS (SELECT p_brand AS k, p_partkey AS id, p_size::DOUBLE AS x, round(p_retailprice / 50)::DOUBLE AS y FROM part)"


def pearson(x, y):
    """Correlation over a group, 0 where a side is constant (corr itself fails there in ANSI mode)."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))), F.lit(0.0))


def two_scores(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.round(F.col("p_retailprice") / 50).alias("y"))


@register("sta01_spearman", f"WITH {_TWO}, r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE AS ry FROM xy) SELECT k, round(coalesce(nullif(corr(rx, ry), 'NaN'::DOUBLE), 0), 6) AS rho FROM r GROUP BY k")
def sta01(spark, sf):
    def mean_rank(c):
        return F.rank().over(W.partitionBy("k").orderBy(c)) + (F.count("*").over(W.partitionBy("k", c)) - 1) / F.lit(2.0)

    r = two_scores(spark, sf).select("k", mean_rank("x").alias("rx"), mean_rank("y").alias("ry"))
    return r.groupBy("k").agg(r6(pearson("rx", "ry")).alias("rho"))


def pair_counts(scores):
    """Pairs within a group, counted without forming them: k, n (all), nx and ny (a side differs), both (neither does), up and down (concordant and discordant).

    Equal (k, x, y) are counted first; what lies below and beside a cell is summed over the grid of the group's values.
    """
    cells = scores.groupBy("k", "x", "y").agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy("k", c).agg(F.sum("n").alias(c + "n"))
    grid = side("x").join(side("y"), "k").join(cells, ["k", "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = lambda c, by: W.partitionBy("k", by).orderBy(c).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("k", "x").orderBy("y").rowsBetween(1, W.unboundedFollowing)
    left = grid.withColumn("left", F.coalesce(F.sum("n").over(before("x", "y")), F.lit(0)))
    near = left.select("k", "n", F.coalesce(F.sum("left").over(before("y", "x")), F.lit(0)).alias("under"), F.coalesce(F.sum("left").over(after), F.lit(0)).alias("over"))
    pairs = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) div 2"))
    same = lambda c: side(c).groupBy("k").agg(pairs(c + "n").alias("t" + c))
    total = scores.groupBy("k").agg(F.count("*").alias("m")).select("k", F.expr("m * (m - 1) div 2").alias("n")).filter("n > 0")
    c = near.groupBy("k").agg(F.sum(F.col("n") * F.col("under")).alias("up"), F.sum(F.col("n") * F.col("over")).alias("down"))
    both = cells.groupBy("k").agg(pairs("n").alias("both"))
    return total.join(same("x"), "k").join(same("y"), "k").join(both, "k").join(c, "k").select("k", "n", (F.col("n") - F.col("tx")).alias("nx"), (F.col("n") - F.col("ty")).alias("ny"), "both", "up", "down")


_PR = "pr AS (SELECT a.k, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM xy a JOIN xy b ON a.k = b.k AND a.id < b.id)"


@register("sta02_kendall_tau_b", f"WITH {_TWO}, {_PR}, c AS (SELECT k, sum(sx * sy)::DOUBLE AS s, count(*) FILTER (WHERE NOT (sx = 0 AND sy <> 0))::DOUBLE AS nx, count(*) FILTER (WHERE NOT (sy = 0 AND sx <> 0))::DOUBLE AS ny FROM pr GROUP BY k) SELECT k, round(CASE WHEN nx * ny > 0 THEN s / sqrt(nx * ny) ELSE 0 END, 6) AS tau FROM c")
def sta02(spark, sf):
    """Pairs that are tied on both sides stay in the denominator."""
    d = F.sqrt((F.col("nx") + F.col("both")).cast("double") * (F.col("ny") + F.col("both")))
    return pair_counts(two_scores(spark, sf)).select("k", r6(F.when(d > 0, (F.col("up") - F.col("down")) / d).otherwise(0.0)).alias("tau"))


@register("sta03_kendall_tau_a", f"WITH {_TWO}, {_PR} SELECT k, round(sum(sx * sy) / count(*)::DOUBLE, 6) AS tau FROM pr GROUP BY k")
def sta03(spark, sf):
    return pair_counts(two_scores(spark, sf)).select("k", r6((F.col("up") - F.col("down")) / F.col("n")).alias("tau"))


@register("sta04_pairwise_accuracy", f"WITH {_TWO}, {_PR}, c AS (SELECT k, count(*) FILTER (WHERE sx <> 0) AS n, count(*) FILTER (WHERE sx <> 0 AND sx = sy) AS m FROM pr GROUP BY k) SELECT k, round(CASE WHEN coalesce(n, 0) > 0 THEN m / n::DOUBLE ELSE 1 END, 6) AS accuracy FROM (SELECT DISTINCT k FROM xy) LEFT JOIN c USING (k)")
def sta04(spark, sf):
    """A group without a decisive pair has accuracy 1."""
    s = two_scores(spark, sf)
    c = s.select("k").distinct().join(pair_counts(s), "k", "left")
    return c.select("k", r6(F.when(F.col("nx") > 0, F.col("up") / F.col("nx")).otherwise(1.0)).alias("accuracy"))


@register("top04_top_k_jaccard", f"WITH {_TWO}, r AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY x DESC, id) <= 5 AS a, row_number() OVER (PARTITION BY k ORDER BY y DESC, id) <= 5 AS b FROM xy) SELECT k, round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b)::DOUBLE, 6) AS jaccard FROM r GROUP BY k")
def top04(spark, sf):
    top = lambda c: F.row_number().over(W.partitionBy("k").orderBy(F.desc(c), "id")) <= 5
    r = two_scores(spark, sf).select("k", top("x").alias("a"), top("y").alias("b"))
    return r.groupBy("k").agg(r6(F.count_if(F.col("a") & F.col("b")) / F.count_if(F.col("a") | F.col("b"))).alias("jaccard"))


def _tail_sql(x: str) -> str:
    """Two-sided p of a non-negative x by the tail formula of normal_cdf_tail."""
    t = f"(1 / (1 + {S.CDF_P}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for c in reversed(S.CDF):
        poly = f"(({poly} + ({c!r}::DOUBLE)) * {t})"
    return f"(2 * exp(-0.5::DOUBLE * {x} * {x}) / sqrt(2 * pi()) * {poly})"


@register("sta08_wilcoxon", f"WITH {_TWO}, d AS (SELECT k, x - y AS d FROM xy WHERE x <> y), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d), s AS (SELECT k, count(*)::DOUBLE AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY k), z AS (SELECT k, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s) SELECT k, coalesce(n, 0) AS n, coalesce(w, 0) AS w, round(CASE WHEN coalesce(n, 0) < 3 THEN 1 ELSE {_tail_sql('abs(z)')} END, 6) AS p FROM (SELECT DISTINCT k FROM xy) LEFT JOIN z USING (k)")
def sta08(spark, sf):
    """The smaller rank sum and its two-sided p; fewer than three differences have p 1."""
    s = two_scores(spark, sf)
    d = s.filter("x <> y").select("k", (F.col("x") - F.col("y")).alias("d"), F.abs(F.col("x") - F.col("y")).alias("m"))
    r = d.select("k", "d", (F.rank().over(W.partitionBy("k").orderBy("m")) + (F.count("*").over(W.partitionBy("k", "m")) - 1) / F.lit(2.0)).alias("r"))
    side = lambda c: F.sum(F.when(c, F.col("r")).otherwise(0.0))
    g = r.groupBy("k").agg(F.count("*").cast("double").alias("n"), F.least(side(F.col("d") > 0), side(F.col("d") < 0)).alias("w"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    p = F.when(n >= 3, 2 * (1 - S.normal_cdf_tail(F.abs(z)))).otherwise(1.0)
    return s.select("k").distinct().join(g, "k", "left").select("k", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), r6(p).alias("p"))


@register("sta09_mcnemar", f"WITH {EVAL}, t AS (SELECT x.is_correct AS a, y.is_correct AS b FROM er x JOIN er y USING (question_id) WHERE x.model_name = 'M1' AND y.model_name = 'M4'), c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE b AND NOT a) AS c FROM t), x AS (SELECT b, c, CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c)::DOUBLE END AS chi2 FROM c) SELECT b, c, round(chi2, 6) AS chi2, round(CASE WHEN chi2 <= 0 THEN 1 ELSE {_tail_sql('sqrt(chi2)')} END, 6) AS p FROM x")
def sta09(spark, sf):
    """With continuity correction; models that never disagree have p 1."""
    e = evals(spark, sf)
    pick = lambda m, n: e.filter(F.col("model_name") == m).select("question_id", F.col("is_correct").alias(n))
    t = pick("M1", "x").join(pick("M4", "y"), "question_id")
    c = t.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(F.col("y") & ~F.col("x")).alias("c"))
    k = F.abs(F.col("b") - F.col("c")) - 1
    chi = c.select("b", "c", F.when(F.col("b") + F.col("c") > 0, F.try_divide(k * k, F.col("b") + F.col("c"))).otherwise(0.0).alias("x"))
    return chi.select("b", "c", r6(F.col("x")).alias("chi2"), r6(F.when(F.col("x") > 0, S.chi_square_p(F.col("x"))).otherwise(1.0)).alias("p"))


@register("sta11_pearson", f"WITH {_TWO} SELECT k, round(coalesce(nullif(corr(x, y), 'NaN'::DOUBLE), 0), 6) AS r FROM xy GROUP BY k")
def sta11(spark, sf):
    return two_scores(spark, sf).groupBy("k").agg(r6(pearson("x", "y")).alias("r"))


@register("tun01_orthogonal_array", "SELECT r AS run, r // 3 AS a, r % 3 AS b, (r // 3 + r % 3) % 3 AS c, (r // 3 + 2 * (r % 3)) % 3 AS d FROM range(9) t(r)")
def tun01(spark, sf):
    a, b = F.expr("id div 3"), F.col("id") % 3
    return spark.range(9).select(F.col("id").alias("run"), a.alias("a"), b.alias("b"), ((a + b) % 3).alias("c"), ((a + 2 * b) % 3).alias("d"))


@register("tun02_hard_gates", "SELECT s_suppkey, s_acctbal >= 0 AND s_nationkey <> 3 AS passes, concat_ws(';', CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey = 3 THEN 'nation' END) AS reasons FROM supplier")
def tun02(spark, sf):
    bad = [F.when(F.col("s_acctbal") < 0, "balance"), F.when(F.col("s_nationkey") == 3, "nation")]
    reasons = F.concat_ws(";", *bad)
    return table(spark, sf, "supplier").select("s_suppkey", (reasons == "").alias("passes"), reasons.alias("reasons"))


@register("tun04_pareto_front", "WITH c AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part) SELECT p_brand, p_partkey FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.p_brand = x.p_brand AND y.p_size >= x.p_size AND y.p_retailprice <= x.p_retailprice AND (y.p_size > x.p_size OR y.p_retailprice < x.p_retailprice))")
def tun04(spark, sf):
    c = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    # two objectives: after sorting by the first, the front is what beats the best second so far
    by = c.groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("best"))
    ahead = F.min("best").over(W.partitionBy("p_brand").orderBy(F.desc("p_size")).rowsBetween(W.unboundedPreceding, -1))
    front = by.withColumn("ahead", ahead).filter(F.col("ahead").isNull() | (F.col("best") < F.col("ahead")))
    return c.join(front.select("p_brand", "p_size", F.col("best").alias("p_retailprice")), ["p_brand", "p_size", "p_retailprice"], "left_semi").select("p_brand", "p_partkey")


@register("rat13_pair_utility", f"WITH {MATCH} SELECT domain, a, b, round(-(p * ln(p) + (1 - p) * ln(1 - p)) * p * (1 - p), 6) AS utility, round(ties / n, 6) AS tie_rate, ties / n >= 0.55 AS masked FROM (SELECT *, (wins_a + 1) / (wins_a + wins_b + 2) AS p FROM ps)")
def rat13(spark, sf):
    p = (F.col("wins_a") + 1) / (F.col("wins_a") + F.col("wins_b") + 2)
    t = F.col("ties") / F.col("n")
    return pair_stats(matches(spark, sf)).select("domain", "a", "b", r6(S.entropy(F.array(p, 1 - p)) * p * (1 - p)).alias("utility"), r6(t).alias("tie_rate"), (t >= 0.55).alias("masked"))
