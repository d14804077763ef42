"""The utility scheduler: what a comparison of two models in a leaf is worth, and a batch under fair shares.

All models of the roster and all scores of a leaf are bounded by the number of models, so they travel in the row of
a pair; nothing is compared across leaves but the order of the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.functions import scalars as S

#: Rules of the score: the bonus of a model not seen yet, the share of ties that masks a pair, the least valley weight.
LN2, MASK, LEAST_VALLEY = 0.6931471805599453, 0.55, 0.1


def counted_states(stats: DataFrame, key: str) -> DataFrame:
    """Scores from counts alone: key, model, score (log-odds of points with one added on each side), se."""
    side = lambda m, w, l: F.struct(F.col(m).alias("model"), (F.col(w) + F.col("ties") / 2).alias("w"), (F.col(l) + F.col("ties") / 2).alias("l"))
    each = stats.select(key, F.explode(F.array(side("a", "wins_a", "wins_b"), side("b", "wins_b", "wins_a"))).alias("x"))
    g = each.groupBy(key, "x.model").agg((F.sum("x.w") + 1).alias("w"), (F.sum("x.l") + 1).alias("l"))
    return g.select(key, "model", F.ln(F.col("w") / F.col("l")).alias("score"), F.sqrt(1 / F.col("w") + 1 / F.col("l")).alias("se"))


def _kernel(scores: Column, at: Column, h: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(-0.5 * F.pow((x - at) / h, F.lit(2.0))))


def leaf_states(states: DataFrame, key: str) -> DataFrame:
    """One row a leaf: by (model to score and se), scores, mean_se, settled (pairs three errors apart), h, densest."""
    x = F.struct(F.col("score").alias("s"), F.col("se").alias("e"))
    g = states.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("model", x))).alias("by"), F.array_sort(F.collect_list("score")).alias("scores"),
        F.avg("se").alias("mean_se"), F.stddev_pop("score").alias("sd"))
    # Silverman's width
    h = F.greatest(1.06 * F.greatest("sd", F.lit(1e-6)) * F.pow(F.size("scores").cast("double"), F.lit(-0.2)), F.lit(1e-4))
    all_ = F.map_values("by")
    far = F.aggregate(all_, F.lit(0), lambda acc, p: acc + F.size(F.filter(all_, lambda q: F.abs(p["s"] - q["s"]) >= 3 * (p["e"] + q["e"]))))
    g = g.withColumn("h", h).withColumn("settled", far / 2)
    return g.withColumn("densest", F.array_max(F.transform("scores", lambda s: _kernel(F.col("scores"), s, F.col("h")))))


def pair_utilities(stats: DataFrame, states: DataFrame, key: str, budget: int) -> DataFrame:
    """Candidates with budget left: key, a, b, n, fresh (no leaf has compared the pair), utility to nine places.

    stats: key, a < b, wins_a, wins_b, ties, n, one row a pair; states: key, model, score, se. Every leaf of states is
    paired with the whole roster of stats. A pair with a model that its leaf has not seen gets the bootstrap bonus.
    """
    roster = stats.select(F.explode(F.array("a", "b")).alias("m")).agg(F.array_sort(F.collect_set("m")).alias("roster"))
    two = F.flatten(F.transform("roster", lambda x: F.transform(F.filter("roster", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    roster = roster.select(two.alias("two"))  # one row
    c = leaf_states(states, key).join(F.broadcast(roster)).withColumn("pairs", F.size("two")).withColumn("p", F.explode("two")).withColumns({"a": F.col("p.a"), "b": F.col("p.b")})
    c = c.drop("two", "p").join(stats.select(key, "a", "b", "wins_a", "wins_b", "ties", "n"), [key, "a", "b"], "left").fillna(0, ["wins_a", "wins_b", "ties", "n"])
    seen = stats.groupBy("a", "b").agg(F.sum("n").alias("seen")).filter("seen > 0").select("a", "b", F.lit(False).alias("fresh"))
    c = c.filter(F.col("n") < budget).join(F.broadcast(seen), ["a", "b"], "left").fillna(True, ["fresh"])  # a row for each pair of the roster
    c = c.withColumns({"si": F.col("by")[F.col("a")]["s"], "sj": F.col("by")[F.col("b")]["s"], "ei": F.col("by")[F.col("a")]["e"], "ej": F.col("by")[F.col("b")]["e"]})
    k, mid, gap, errors = F.size("scores"), (F.col("si") + F.col("sj")) / 2, F.abs(F.col("si") - F.col("sj")), F.col("ei") + F.col("ej")
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    ripe = clip(0.35 * clip(1 - F.col("mean_se") / 10) + 0.65 * clip(F.col("settled") / F.col("pairs")))
    alpha = 0.2 + 0.8 * F.exp(-2.5 * ripe)
    inside = F.size(F.filter("scores", lambda x: x.between(F.least("si", "sj"), F.greatest("si", "sj"))))
    middle = F.get("scores", F.expr("size(scores) div 2").cast("int"))
    structure = F.when(k < 3, 1.0).otherwise(0.6 * inside / k + 0.4 * F.exp(-0.5 * F.pow((mid - middle) / F.greatest(errors, F.lit(1e-6)), F.lit(2.0))))
    valley = F.greatest(F.lit(LEAST_VALLEY), clip(1 - _kernel(F.col("scores"), mid, F.col("h")) / F.col("densest")))
    weight = F.when(gap >= 4 * errors, 0.0).when(gap < 0.15 * errors, gap / (0.15 * errors)).when(k < 3, 1.0).otherwise(valley)
    p = 1 / (1 + F.exp(F.col("sj") - F.col("si")))
    resolve = S.entropy(F.array(p, 1 - p)) * (F.col("ei") * F.col("ei") + F.col("ej") * F.col("ej")) * weight
    total = F.col("wins_a") + F.col("wins_b") + F.col("ties")
    open_ = F.when((total > 0) & (F.col("ties") >= MASK * total), 0.0).otherwise(1.0)
    worth = (alpha * structure + (1 - alpha) * resolve) * (1 - 0.3 * F.least(F.col("n") / budget, F.lit(1.0))) * open_
    new = LN2 + 1 + (10 - F.least("n", F.lit(10))) * 0.1
    return c.select(key, "a", "b", "n", "fresh", F.round(F.when(F.col("si").isNull() | F.col("sj").isNull(), new).otherwise(worth), 9).alias("utility"))


def allot(candidates: DataFrame, key: str, batch: int, share: int, cap: int) -> DataFrame:
    """The next comparisons, up to `batch`: key, a, b, utility, lap, place.

    Pairs that no leaf has compared come first, then lap by lap the highest utility. In lap 0 a model meets once in a
    leaf and `cap` times in all, a pair comes up `share` times; each further lap allows as much again, so that a batch
    is filled where the caps would leave it short. The windows by model hold the candidates of the leaves to compare
    in, which target_nodes() bounds.
    """
    best = lambda *more: [F.desc("utility"), *more]
    c = candidates.withColumn("turn", F.row_number().over(W.partitionBy("a", "b").orderBy(*best(key))) - 1)
    side = c.select(key, "a", "b", "utility", F.explode(F.array("a", "b")).alias("m"))
    side = side.withColumn("here", F.row_number().over(W.partitionBy(key, "m").orderBy(*best("a", "b"))) - 1)
    side = side.withColumn("all", F.row_number().over(W.partitionBy("m").orderBy(*best(key, "a", "b"))) - 1)
    load = side.groupBy(key, "a", "b").agg(F.max("here").alias("here"), F.max("all").alias("all"))
    lap = F.greatest("here", F.floor(F.col("turn") / share), F.floor(F.col("all") / cap)).cast("long")
    order = [F.desc("fresh"), "lap", *best(key, "a", "b")]
    first = c.join(load, [key, "a", "b"]).withColumn("lap", lap).orderBy(*order).limit(batch)
    # as many rows as the batch has
    return first.select(key, "a", "b", "utility", "lap", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))
