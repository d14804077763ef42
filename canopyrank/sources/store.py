"""Keyed tables as Parquet in the shared folder: upsert, snapshots, clear."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyrank.storage import exists, move, remove


def _settled(spark: SparkSession, root: str) -> bool:
    """Whether there is a table; one that a broken-off upsert has put aside is put back."""
    if not exists(spark, root) and exists(spark, f"{root}.old"):
        move(spark, f"{root}.old", root)
    return exists(spark, root)


def read(spark: SparkSession, root: str) -> DataFrame:
    _settled(spark, root)
    return spark.read.option("mergeSchema", "true").parquet(root)


def upsert(rows: DataFrame, root: str, keys: list[str]) -> None:
    """Rows take the place of those with the same keys; keys must not repeat within rows.

    The new table is written beside the old one, which is then put aside under the name .old for as long as the new
    one is moved: wherever a run breaks off, the next reader or writer finds the old table or the new one.
    """
    spark = rows.sparkSession
    if not _settled(spark, root):
        beside = f"{root}-{uuid.uuid4().hex}"
        rows.write.parquet(beside)
        move(spark, beside, root)
        return
    same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    left = read(spark, root).alias("old").join(rows.select(*keys).alias("new"), same, "left_anti")
    beside = f"{root}-{uuid.uuid4().hex}"
    left.unionByName(rows, allowMissingColumns=True).write.parquet(beside)
    remove(spark, f"{root}.old")
    move(spark, root, f"{root}.old")
    move(spark, beside, root)
    remove(spark, f"{root}.old")


def write_snapshots(rows: DataFrame, root: str) -> None:
    """Rows by their column snapshot_id, a folder each; other snapshots stay."""
    rows.write.mode("append").partitionBy("snapshot_id").parquet(root)


def clear(spark: SparkSession, root: str, snapshot_id: str) -> None:
    remove(spark, f"{root}/snapshot_id={snapshot_id}")
