"""Construction of the taxonomy over the embedded queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.functions.vectors import dot, sums
from canopyrank.operators import taxonomy as T
from canopyrank.plans.base import VEC, r6, vectors
from canopyrank.plans.registry import register
from canopyrank.session import table


def _queries(spark, sf):
    return vectors(spark, sf).select("vec_id", F.col("label").alias("category"), "v")


@register("clu01_bootstrap_weights", "SELECT vec_id, 'c' || label AS node, 1.0::DOUBLE AS weight FROM embeddings")
def clu01(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("node"), F.lit(1.0).alias("weight"))


@register("clu04_directional_fit", f"WITH {VEC}, s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM qx GROUP BY ALL), r AS (SELECT label, max(n) AS n, sqrt(sum(s * s)) / max(n) AS r FROM s GROUP BY label) SELECT label, n, round(r, 6) AS resultant, round(r * (64 - r * r) / (1 - r * r), 4) AS kappa FROM r")
def clu04(spark, sf):
    s = sums(vectors(spark, sf), "label", "v").select("label", F.col("n").cast("long").alias("n"), (F.sqrt(dot("total", "total")) / F.col("n")).alias("r"))
    r = F.col("r")
    return s.select("label", "n", r6(r).alias("resultant"), F.round(r * (64 - r * r) / (1 - r * r), 4).alias("kappa"))


@register("hlp10_sufficient_statistics", f"WITH {VEC} SELECT leaf, i, round(sum(x), 6) AS total, count(*) AS n FROM qx GROUP BY ALL")
def hlp10(spark, sf):
    x = vectors(spark, sf).select("leaf", F.posexplode("v").alias("p", "x"))
    return x.groupBy("leaf", F.col("p").cast("long").alias("i")).agg(r6(F.sum("x")).alias("total"), F.count("*").alias("n"))


@register("clu33_evolution")
def clu33(spark, sf):
    """The taxonomy grown from the categories: every query's memberships. Tested by its proposals, its mass and clusters that are known."""
    _, members, _ = T.evolve(_queries(spark, sf), T.Settings(epsilon=0.005, least=10))
    return members.select("vec_id", "node", r6(F.col("weight")).alias("weight"))
