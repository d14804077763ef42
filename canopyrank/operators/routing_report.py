"""How well routing finds a query's category, from memberships, leaf profiles and the true categories.

Figures come from one row for each query, made of its own few matches; nothing is sorted over all queries but the
number of matches, of which there are few different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96
BINS = 10


def leaf_profiles(members: DataFrame, categories: DataFrame, depths: DataFrame, least: float) -> DataFrame:
    """node, domain, purity, depth of every node with at least so much mass: its commonest category (the first at a tie) and that one's share.

    members: vec_id, node, weight; categories: vec_id, category; depths: node, depth.
    """
    by = members.join(categories, "vec_id").groupBy("node", "category").agg(F.sum("weight").alias("w"))
    top = by.groupBy("node").agg(F.sum("w").alias("mass"), F.min(F.struct((-F.round("w", 9)).alias("k"), "category", "w")).alias("top"))
    return top.filter(F.round("mass", 9) >= least).join(depths, "node").select("node", F.col("top.category").alias("domain"), (F.col("top.w") / F.col("mass")).alias("purity"), "depth")


def matches(routes: DataFrame, profiles: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each query with a category: vec_id, category, n, sum, any and its best match (null without one): domain, purity, depth, conf.

    A query's confidence in a domain is the best of its nodes there; the best node decides, the first name at a tie.
    """
    m = routes.join(profiles, "node")
    best = F.min(F.struct((-F.round("weight", 12)).alias("k"), "node", "domain", "purity", "depth", "weight")).alias("best")
    per = m.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("weight").alias("sum"), best, F.collect_set("domain").alias("domains"))
    j = truth.join(per, "vec_id", "left")
    return j.select(
        "vec_id", "category", F.coalesce("n", F.lit(0)).alias("n"), "sum", F.coalesce(F.array_contains("domains", F.col("category")), F.lit(False)).alias("any"),
        F.col("best.domain").alias("domain"), F.col("best.purity").alias("purity"), F.col("best.depth").alias("depth"), F.col("best.weight").alias("conf"))


def per_domain(found: DataFrame) -> DataFrame:
    """domain, support, prec, recall, f1 for every category that queries have; who has no match is missed by its own."""
    hit = F.col("category") == F.col("domain")
    one = lambda k, tp, fp, fn, n: F.struct(k.alias("domain"), tp.cast("int").alias("tp"), F.lit(fp).alias("fp"), fn.cast("int").alias("fn"), F.lit(n).alias("n"))
    ok = F.coalesce(hit, F.lit(False))
    sides = F.array(one(F.col("category"), ok, 0, ~ok, 1), one(F.when(F.col("domain").isNotNull() & ~ok, F.col("domain")), F.lit(False), 1, F.lit(False), 0))
    t = found.select(F.explode(sides).alias("x")).filter("x.domain IS NOT NULL").groupBy("x.domain").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn", "n")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.filter("n > 0").select("domain", F.col("n").alias("support"), ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def calibration_error(found: DataFrame, bins: int = BINS) -> DataFrame:
    """ece over the queries with a match: confidences of the best match in bins of equal width against how often it is right; and the number of bins in use."""
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round("conf", 9)))
    b = found.filter("domain IS NOT NULL").groupBy(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"))
    t = b.agg(F.count("*").alias("n"), F.avg(conf).alias("conf"), F.avg((F.col("category") == F.col("domain")).cast("double")).alias("acc"))
    return t.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), F.lit(0.0)).alias("ece"), F.count("*").alias("bins"))


def brier(routes: DataFrame, profiles: DataFrame, truth: DataFrame) -> DataFrame:
    """brier: the mean over queries of the squared differences, summed over domains, of confidence and truth; without a match it is one."""
    conf = routes.join(profiles, "node").groupBy("vec_id", "domain").agg(F.max("weight").alias("p"))
    j = truth.join(conf, "vec_id", "left")
    hit = F.col("category") == F.col("domain")
    p = F.col("p")
    # one for the true domain, unless one of the rows is it
    per = j.groupBy("vec_id").agg((F.sum(F.when(p.isNull(), 0.0).when(hit, (p - 1) * (p - 1) - 1).otherwise(p * p)) + 1).alias("b"))
    return per.agg(F.coalesce(F.avg("b"), F.lit(0.0)).alias("brier"))


def wilson(p: Column, n: Column, sign: int) -> Column:
    mid, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mid + sign * half) / (1 + Z * Z / n)))


def report(routes: DataFrame, profiles: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, top1 with its Wilson interval, any_match, no_match, purity, depth, macro_f1, ece, mean and median matches, multi_leaf, posterior, depth_corr. Zeros without queries."""
    found = matches(routes, profiles, truth)
    hit, has = (F.col("category") == F.col("domain")), F.col("domain").isNotNull()
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    a = found.agg(
        F.count("*").alias("queries"), mean(F.coalesce(hit, F.lit(False)).cast("int")).alias("top1"), mean(F.col("any").cast("int")).alias("any_match"), mean((~has).cast("int")).alias("no_match"),
        mean(F.col("purity")).alias("purity"), mean(F.col("depth")).alias("depth"), mean(F.col("n")).alias("mean_matches"), mean((F.col("n") > 1).cast("int")).alias("multi_leaf"), mean(F.col("sum")).alias("posterior"))
    f1 = per_domain(found).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    # the median from how many queries have so many matches: a row for each number of matches
    counts = found.groupBy("n").agg(F.count("*").alias("c")).agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("x"), F.sum("c").alias("t"))
    upto = F.transform("x", lambda e, i: F.struct(e["n"].alias("n"), F.aggregate(F.slice("x", 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("c")))
    at = lambda k: F.filter("y", lambda e: e["c"] > k)[0]["n"]
    mid = counts.withColumn("y", upto).select(F.when(F.col("t") > 0, (at(F.floor((F.col("t") - 1) / 2)) + at(F.floor(F.col("t") / 2))) / 2).otherwise(F.lit(0.0)).alias("median_matches"))
    pairs = routes.join(profiles, "node").join(truth.select("vec_id"), "vec_id", "left_semi")
    corr = pairs.agg(F.coalesce(F.try_divide(F.covar_pop("depth", "weight"), F.sqrt(F.var_pop("depth") * F.var_pop("weight"))), F.lit(0.0)).alias("depth_corr"))
    whole = a.join(f1).join(calibration_error(found).select("ece")).join(mid).join(corr)
    some = F.col("queries") > 0
    edge = lambda sign: F.when(some, wilson(F.col("top1"), F.col("queries"), sign)).otherwise(F.lit(0.0))
    return whole.withColumns({"low": edge(-1), "high": edge(1)})
