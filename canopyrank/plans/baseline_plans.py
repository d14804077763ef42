"""Baselines that a grown taxonomy is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.operators import ward as A
from canopyrank.plans.base import vectors
from canopyrank.plans.registry import register

#: Cells that every leaf is cut into, and clusters that are left.
CELLS, CLUSTERS = 10, 20


@register("clu35_ward_baseline")
def clu35_ward(spark, sf):
    """Every query's cluster after Ward's agglomeration of the leaves' parts (by id) down to as many clusters as there are leaves.

    Tested against one merge at a time, on single vectors and on cells.
    """
    q = vectors(spark, sf).select("vec_id", (F.col("leaf") * CELLS + F.floor(F.col("vec_id") / 2) % CELLS).cast("long").alias("cell"), "v")
    # a row for each cell
    return q.select("vec_id", "cell").join(F.broadcast(A.ward(q, "cell", CLUSTERS)), "cell").select("vec_id", "cell", "cluster")
