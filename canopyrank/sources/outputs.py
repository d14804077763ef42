"""Stored model outputs: zip archives, JSON files and directories, read through Spark's readers.

A broken file gives no rows; a row without a question is dropped. Where a
question id is missing the row's id takes its place.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyrank.functions.scalars import model_of_file

ITEM = "array<struct<question_id:int,id:int,question:string,options:array<string>,answer:string,answer_index:int,category:string,pred:string,model_outputs:string,cot_content:string>>"


def _documents(files: DataFrame) -> DataFrame:
    """One row for each JSON text within the files: path, body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                raw = bytes(content)
                if not path.endswith(".zip"):
                    out.append((path, raw.decode("utf-8", "replace")))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        out += [(path, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith(".json")]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["path", "body"])

    return files.select("path", "content").mapInPandas(run, "path string, body string")


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """model_name, question_id, question, options, gt_answer, pred, category, trace, is_correct of a zip, a JSON file or a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(r"\.(zip|json)$"))
    rows = _documents(files).select(model_of_file(F.element_at(F.split("path", "/"), -1)).alias("model_name"), F.explode(F.from_json("body", ITEM)).alias("x"))
    number = F.coalesce("x.question_id", "x.id", F.lit(-1))
    blank = F.coalesce(F.trim("x.question"), F.lit("")) == ""
    return rows.filter(~blank).select(
        "model_name", number.alias("question_id"), F.col("x.question").alias("question"), F.col("x.options").alias("options"), F.coalesce("x.answer", F.lit("?")).alias("gt_answer"), F.col("x.pred").alias("pred"),
        F.coalesce("x.category", F.lit("unknown")).alias("category"), F.coalesce("x.model_outputs", "x.cot_content").alias("trace"), F.coalesce(F.col("x.pred") == F.col("x.answer"), F.lit(False)).alias("is_correct"),
    )


def catalogue(spark: SparkSession, path: str, ingested: DataFrame | None = None) -> DataFrame:
    """One entry for each model found: model_name, path, bytes, ingested. The first path of a model counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    found = files.filter(F.col("path").rlike(r"\.(zip|json)$")).withColumn("model_name", model_of_file(F.element_at(F.split("path", "/"), -1)))
    one = found.groupBy("model_name").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("bytes"))
    if ingested is None:
        return one.withColumn("ingested", F.lit(False))
    have = ingested.select("model_name").distinct().withColumn("have", F.lit(True))
    return one.join(have, "model_name", "left").select("model_name", "path", "bytes", F.coalesce("have", F.lit(False)).alias("ingested"))


def insert_or_ignore(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that the store does not hold yet, once for each key."""
    return new.dropDuplicates(keys).join(store.select(*keys), keys, "left_anti")


def decode_vectors(df: DataFrame, blob: str = "blob") -> DataFrame:
    """Vectors kept as big-endian 32-bit floats: the blob column becomes an array of floats."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(bytes(b), dtype=">f4").astype("float32"))

    return df.withColumn(blob, decode(F.col(blob)))


def split_reserved(text: str) -> list[int]:
    """Ids of a reserved pool: {category: [ids]}; texts in it are left to the caller."""
    return sorted({x for v in json.loads(text).values() for x in v if isinstance(x, int)})
