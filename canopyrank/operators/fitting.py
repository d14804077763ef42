"""The fit of all nodes, level by level: sums roll up from below, then each level's posterior is the next one's prior.

Members are read once, for their component sums by node. A node's region is what
it and all below it hold, each node once however many ways lead there, so its
sums are those of its own and its descendants' rows. Everything after that has a
row for each node and component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.functions import scalars as S
from canopyrank.functions.vectors import as_double, dot, norm, sums, unit
from canopyrank.operators.graph import closure
from canopyrank.storage import materialise

DEFAULT_KAPPA, SUPPORT = 10.0, 2.0
#: Mass under which a region is empty; cosine from which a direction stays as it was.
EMPTY, SAME = 1e-4, 0.9975


def region_sums(members: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n, total, squares: mass, component sums and sums of squared components of every node's region (of nodes with none, no row)."""
    rows = members.select("node", F.col("weight").cast("double").alias("w"), F.posexplode(as_double("v")).alias("i", "x"))
    own = rows.groupBy("node", "i").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"))
    up = own.join(closure(edges).select("node", "anc"), "node").groupBy(F.col("anc").alias("node"), "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    t = F.array_sort(F.collect_list(F.struct("i", "s", "q")))
    return up.groupBy("node").agg(F.max("n").alias("n"), F.transform(t, lambda x: x["s"]).alias("total"), F.transform(t, lambda x: x["q"]).alias("squares"))


def fit_levels(members: DataFrame, nodes: DataFrame, edges: DataFrame, dims: int, previous: DataFrame | None = None, default_kappa: float = DEFAULT_KAPPA, support: float = SUPPORT) -> DataFrame:
    """A row for each node: node, depth, n, mu, kappa, alpha, niw_m, niw_kappa, niw_nu, niw_lambda.

    members: node, vec_id, weight, v (dims components); nodes: node, depth; edges: p, c.
    The prior concentration is the mean of the parents' (the default at the root), and 1 at least; few members for
    their dimensions lean on it (alpha), and fewer than `support` take it whole. The prior mean is the parents' mean
    direction, the first axis at the root. A region without mass has the first axis and next to no concentration.
    previous (node, mu): a direction within SAME of the former one stays.
    """
    base = nodes.join(region_sums(members, edges), "node", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    base = materialise(base if previous is None else base.join(previous.select("node", F.col("mu").alias("old")), "node", "left"), "regions")
    zeros, d = F.array_repeat(F.lit(0.0), dims), F.lit(float(dims))
    axis = F.array(F.lit(1.0), *[F.lit(0.0)] * (dims - 1))
    done = None
    # a number for each level of the topology
    for depth in [r["depth"] for r in base.select("depth").distinct().orderBy("depth").collect()]:
        level = base.filter(F.col("depth") == depth)
        if done is None:
            level = level.withColumns({"prior": F.lit(default_kappa), "m0": axis})
        else:
            above = edges.select("p", "c").distinct().join(done.select(F.col("node").alias("p"), "mu", "kappa"), "p")
            k = above.groupBy("c").agg(F.avg(F.when(F.col("kappa") > 0, F.col("kappa"))).alias("prior"))
            m = sums(above, "c", "mu").select("c", F.col("total").alias("m0"))
            level = level.join(k.join(m, "c").withColumnRenamed("c", "node"), "node", "left").withColumns({"prior": F.coalesce("prior", F.lit(default_kappa)), "m0": F.when(norm("m0") > 0, unit("m0")).otherwise(axis)})
        n, some = F.greatest("n", F.lit(EMPTY)), F.col("n") > EMPTY
        level = level.withColumns({"prior": F.greatest("prior", F.lit(1.0)), "total": F.coalesce("total", zeros), "squares": F.coalesce("squares", zeros)})
        level = level.withColumn("size", norm("total"))
        mu = F.when(F.col("size") > 0, unit("total")).otherwise(axis)
        if previous is not None:
            mu = F.when(F.col("old").isNotNull() & (F.size("old") == dims) & (dot("old", mu) >= SAME), F.col("old")).otherwise(mu)
        alpha = F.when(n < support, F.lit(1.0)).otherwise(S.prior_blend(n, d))
        level = level.withColumns({"mu": F.when(some, mu).otherwise(axis), "alpha": F.when(some, alpha).otherwise(F.lit(1.0)), "mean": F.transform("total", lambda x: x / n)})
        raw = S.corrected_kappa(F.col("size") / n, F.floor(F.round(n, 6)), d)
        kappa = F.when(~some, F.lit(1e-3)).when(n < support, F.col("prior")).otherwise((1 - F.col("alpha")) * raw + F.col("alpha") * F.col("prior"))
        # one prior observation; the scale of its spread is that of the prior concentration
        scale = 1 / (F.col("prior") * d)
        spread = F.zip_with("squares", "mean", lambda q, m: q - n * m * m)
        off = F.zip_with("mean", "m0", lambda m, z: n / (1 + n) * (m - z) * (m - z))
        lam = F.when(some, F.zip_with(spread, off, lambda a, b: scale + a + b)).otherwise(F.array_repeat(1 / d, dims))
        niw_m = F.when(some, F.zip_with("m0", "mean", lambda z, m: (z + n * m) / (1 + n))).otherwise(axis)
        none = lambda x, z: F.when(some, x).otherwise(z)
        fit = level.select("node", "depth", F.col("n"), "mu", kappa.alias("kappa"), "alpha", niw_m.alias("niw_m"), none(1 + n, F.lit(1.0)).alias("niw_kappa"), none(d + 2 + n, d + 2).alias("niw_nu"), lam.alias("niw_lambda"))
        fit = materialise(fit, "level_fit")
        done = fit if done is None else done.unionByName(fit)
    return done
