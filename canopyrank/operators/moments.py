"""Leading directions of every node's members, from second moments that are summed as the members are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.functions.vectors import dot, norm
from canopyrank.operators.mixtures import leading

#: Tasks that the members of one node are dealt to, so that a task meets few nodes and no node is one task's work.
DEALT = 16


def second_moments(members: DataFrame) -> DataFrame:
    """node, n, total, moment (rows of sums of products) from members (vec_id, node, v, perhaps weight).

    A task sums a node's members batch by batch and gives its sums once; these are added component by component.
    """
    weight = F.col("weight") if "weight" in members.columns else F.lit(1.0)
    rows = members.select("node", "v", weight.cast("double").alias("w"), F.pmod(F.xxhash64("vec_id"), F.lit(DEALT)).alias("deal"))
    rows = rows.repartition("node", "deal").sortWithinPartitions("node").select("node", "v", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([list(got)], pa.list_(pa.float64()))], ["node", "r"])

        for b in batches:
            node = np.array(b.column("node").to_pylist(), dtype=object)
            x = np.asarray(b.column("v").flatten(), dtype=float).reshape(len(b), -1)
            w = b.column("w").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1), len(node)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                y = x[lo:hi] * w[lo:hi, None]
                new = np.concatenate([[w[lo:hi].sum()], y.sum(axis=0), (y.T @ x[lo:hi]).ravel()])
                if node[lo] != at:
                    if at is not None:
                        yield row()
                    at, got = node[lo], new
                else:
                    got = got + new
        if at is not None:
            yield row()

    each = rows.mapInArrow(run, "node string, r array<double>").select("node", F.posexplode("r").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("r"))
    d = ((F.sqrt(4 * F.size("r") - 3) - 1) / 2).cast("int")
    cut = whole.withColumn("d", d).select("node", F.col("r")[0].alias("n"), F.slice("r", 2, F.col("d")).alias("total"), "r", "d")
    return cut.select("node", "n", "total", F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: F.slice("r", k * F.col("d") + F.col("d") + 2, F.col("d"))).alias("moment"))


def directions(moments: DataFrame, k: int) -> DataFrame:
    """node, mean, directions: the k leading ones of every node, at most as many as there are components. A row for each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [leading(n, np.asarray(t, dtype=float), np.stack([np.asarray(r, dtype=float) for r in m]), k) for n, t, m in zip(pdf["n"], pdf["total"], pdf["moment"])]
            yield pd.DataFrame({"node": pdf["node"], "mean": [list(m) for m, _ in got], "directions": [[list(r) for r in d] for _, d in got]})

    return moments.mapInPandas(run, "node string, mean array<double>, directions array<array<double>>")


def projected(members: DataFrame, basis: DataFrame) -> DataFrame:
    """Members with y: their components along their node's directions, scaled to length one; zero where nothing is left."""
    m = members.join(basis, "node").withColumn("__c", F.zip_with("v", "mean", lambda a, b: a - b))
    m = m.withColumn("__y", F.transform("directions", lambda r: dot(F.col("__c"), r)))
    size = norm("__y")
    return m.withColumn("__s", size).withColumn("y", F.when(F.col("__s") > 1e-10, F.transform("__y", lambda x: x / F.col("__s"))).otherwise(F.col("__y"))).drop("__c", "__y", "__s", "mean", "directions")
