"""The corpus pipeline: five stages over documents, each written and read again.

language_id    documents without a language go: null, empty or letterless texts, and those of which no language
               labels half the letters; a null lang is filled with the language found
near_dedup     one document of each SimHash class stays, the smallest doc_id; classes are joined by sketches, so
               that texts whose five-word shingles are 0.8 alike meet
decontaminate  documents that overlap the benchmark by the contamination rule go
secrets        base findings and owner-specific tokens are masked; every document stays
packing        what is left is packed into token windows

Defined cases. Rows that repeat a doc_id are documents of their own until near_dedup, which leaves one of each
class; a null doc_id is an id like any other. Columns beyond those of documents pass through all stages but the
last. Without documents every stage gives no rows. Each stage's own docstring has the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopyrank.llm import decontaminate, langid, packing, secrets_scan, simhash
from canopyrank.llm.common import materialise

#: Least score of a language: the share of letters it labels, times how sure its evidence is.
LEAST_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs, langid.train(docs), lang_col="lang", least_score=LEAST_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("secrets", secrets),
    ("packing", pack),
]

# fingerprints, a trained model and a tokenizer have no SQL form; tests/llm/test_pipeline.py has the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = materialise(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
