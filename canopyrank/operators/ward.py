"""Ward's agglomeration of cells from their masses and sums, in rounds.

In a round every cell's nearest one is found, by all tasks side by side, and all
pairs that are nearest to each other merge. As a merge never brings cells nearer
than the two it came from were, this makes the same merges as taking the nearest
pair of all one at a time, in far fewer rounds. Members are read once, for the
sums; the cells are a table of the taxonomy's size, which the driver and each
task hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyrank.functions.vectors import sums

#: Cells at most; more are refused. At 64 dimensions so many take 10 MB.
MOST = 20_000
#: Cells of which a task holds the distances to all others at once.
BLOCK = 256


def distances(n: np.ndarray, mean: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By how much the sum of squares within cells grows if the cells `at` merge with each other one; infinite with themselves."""
    square = (mean * mean).sum(axis=1)
    d = square[at][:, None] + square - 2 * mean[at] @ mean.T
    d = np.round(np.maximum(d, 0) * (n[at][:, None] * n) / (n[at][:, None] + n), 12)
    d[np.arange(len(at)), at] = np.inf
    return d


def nearest(spark: SparkSession, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each, the first at a tie, and its distance."""
    mean = total / n[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for lo in range(0, len(ids), BLOCK):
                at = ids[lo : lo + BLOCK]
                d = distances(n, mean, at)
                to = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(to, pa.int64()), pa.array(d[np.arange(len(at)), to])], ["id", "to", "d"])

    got = spark.range(0, len(n), numPartitions=max(1, min(len(n) // BLOCK, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "id long, to long, d double").toArrow().to_pandas().sort_values("id")
    return got["to"].to_numpy(), got["d"].to_numpy()


def merges(spark: SparkSession, n: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (x, y, distance), x < y the smallest members of both sides, nearest first."""
    n, total, name = n.astype(float).copy(), total.astype(float).copy(), np.arange(len(n))
    out: list[tuple[int, int, float]] = []
    while len(n) > 1:
        to, d = nearest(spark, n, total)
        one = np.flatnonzero((to[to] == np.arange(len(n))) & (np.arange(len(n)) < to))
        if not len(one):  # a ring of equal distances: its first pair
            k = int(d.argmin())
            one, to[to[k]] = np.array([min(k, to[k])]), k
            to[one] = max(k, to[k])
        two = to[one]
        out += [(int(min(name[x], name[y])), int(max(name[x], name[y])), float(d[x])) for x, y in zip(one, two)]
        n[one] += n[two]
        total[one] += total[two]
        name[one] = np.minimum(name[one], name[two])
        rest = np.ones(len(n), dtype=bool)
        rest[two] = False
        n, total, name = n[rest], total[rest], name[rest]
    return sorted(out, key=lambda m: (m[2], m[0], m[1]))


def ward(members: DataFrame, key: str, clusters: int) -> DataFrame:
    """key, cluster: the cells of members (key, v) agglomerated until so many clusters are left, each named by the first key in it.

    A null key is no cell. With no more cells than clusters each is one of its own.
    """
    spark, kind = members.sparkSession, dict(members.dtypes)[key]
    rows = sums(members.filter(F.col(key).isNotNull()), key, "v").orderBy(key).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} cells")
    keys, up = [r[key] for r in rows], list(range(len(rows)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    if rows:
        for x, y, _ in merges(spark, np.array([r["n"] for r in rows]), np.array([r["total"] for r in rows]))[: max(0, len(rows) - clusters)]:
            a, b = sorted((find(x), find(y)))
            up[b] = a
    return spark.createDataFrame([(k, keys[find(i)]) for i, k in enumerate(keys)], f"{key} {kind}, cluster {kind}")
