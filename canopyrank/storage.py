"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session on one machine that names none is given a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='canopyrank-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _file_system(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them back.

    The copy survives lost executors and is stable: an id made by monotonically_increasing_id before the write is
    the same for every reader. It is removed when the driver ends, or before by discard().
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/canopyrank/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    fs, path = _file_system(spark, at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


#: Rows that one task of a wide step is to hold.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys over as many partitions as keep about TASK_ROWS of its rows in each, or as the session has, if these are more."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1), *keys)


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own under the shared folder, for what is to go when the driver ends."""
    at = f"{shared_dir(spark)}/canopyrank/{tag}-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, at)
    fs.deleteOnExit(path)
    return at


def discard(df: DataFrame) -> None:
    """Remove a table that materialise() wrote and nothing reads any more."""
    fs, path = _file_system(df.sparkSession, df.stored_at)
    fs.delete(path, True)


def exists(spark: SparkSession, at: str) -> bool:
    fs, path = _file_system(spark, at)
    return fs.exists(path)


def remove(spark: SparkSession, at: str) -> None:
    fs, path = _file_system(spark, at)
    fs.delete(path, True)


def move(spark: SparkSession, one: str, two: str) -> None:
    fs, path = _file_system(spark, one)
    if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(two)):
        raise OSError(f"{one} could not be moved to {two}")


def files(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    fs, path = _file_system(spark, at)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def write_text(spark: SparkSession, at: str, text: str) -> None:
    """A small file, new."""
    fs, path = _file_system(spark, at)
    out = fs.create(path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, at: str) -> str:
    """A small file, whole."""
    fs, path = _file_system(spark, at)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def drop_materialised(spark: SparkSession) -> None:
    """Remove everything materialise() has written under the session's shared folder."""
    fs, path = _file_system(spark, f"{shared_dir(spark)}/canopyrank")
    fs.delete(path, True)
