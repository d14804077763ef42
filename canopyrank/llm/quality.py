"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. One pass counts every bucket
over the raw corpus and over the trusted target; the smoothed logarithm of the
ratio of the two multinomials is a bucket's weight. A document's score is the
mean weight of its n-grams, so length does not count, and a document is kept
where it reaches the threshold. Counting aggregates before its shuffle;
scoring needs none.

Defined cases. A null or empty text has no words and fails the base rules. An
n-gram that no trusted document holds weighs as little as smoothing allows. If
there are no trusted documents all weights are zero and the base rules decide.
Rows that repeat are judged each; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import SPACE_GAP, between, text_of

#: Buckets; so many numbers reach the driver, and go back into the plan as one constant array.
BUCKETS = 1 << 14
#: Trusted ids up to which they are broadcast, some 50 MB; beyond it the documents are dealt by id. All count either way.
BROADCAST = 1 << 20
SMOOTH = 1.0
#: Mean log-likelihood ratio in nats from which a document is kept.
THRESHOLD = -0.04
REPEAT = 8


def _pick(array: Column, index: Column) -> Column:
    return F.get(array, index.cast("int"))


def bucket(*hashes: Column) -> Column:
    return F.pmod(F.xxhash64(*hashes), F.lit(BUCKETS))


def word_hashes(text: Column) -> Column:
    return F.transform(between(text, SPACE_GAP), lambda w: F.xxhash64(w))


def ngram_buckets(h: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), bucket(a, b)))
    return F.concat(F.transform(h, lambda a: bucket(a)), F.filter(pairs, lambda x: x.isNotNull()))


def weights(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST) -> list[float]:
    """The log ratio of every bucket. trusted: a column of ids; the corpus and the trusted documents are counted whole. most: ids that are broadcast."""
    ids = trusted.select(F.col(id_col).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    few = ids.limit(most + 1).count() <= most
    ids = ids.withColumn("__in", F.lit(1))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "__id", "left")
    grams = rows.select(F.coalesce("__in", F.lit(0)).alias("own"), word_hashes(text_of("__t")).alias("h")).select("own", F.explode(ngram_buckets(F.col("h"))).alias("b"))
    raw, own = [0] * BUCKETS, [0] * BUCKETS
    for r in grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("own").alias("m")).collect():
        raw[r["b"]], own[r["b"]] = r["n"], r["m"]
    return log_ratios(raw, own)


def log_ratios(raw: list[int], own: list[int]) -> list[float]:
    import math

    n, m = sum(raw), sum(own)
    if not m:
        return [0.0] * len(raw)
    a, b = m + SMOOTH * len(own), n + SMOOTH * len(raw)
    # smoothing is in proportion to the raw corpus, so a bucket without evidence weighs next to nothing
    k = SMOOTH * len(raw)
    return [math.log((y + k * (x + SMOOTH) / b) / (m + k)) - math.log((x + SMOOTH) / b) for x, y in zip(raw, own)] if a else []


def likelihood(h: Column, weight: list[float]) -> Column:
    """The mean weight of a document's n-grams, 0 without any. h: its word hashes."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weight)), ",").cast("array<double>")
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        pair = F.coalesce(F.when(acc["last"].isNotNull(), _pick(table, bucket(acc["last"], x))), F.lit(0.0))
        return F.struct(x.alias("last"), (acc["sum"] + _pick(table, bucket(x)) + pair).alias("sum"))

    total = F.aggregate(h, zero, step, lambda acc: acc["sum"])
    return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(F.lit(0.0))


def base_columns(docs: DataFrame, text: Column, *extra: Column) -> DataFrame:
    """The extra columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the word hashes h."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        *extra,
        word_hashes(text).alias("h"),
        F.length(F.regexp_replace(text, SPACE_GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    count = F.size("h")
    window = F.when(count >= REPEAT, F.transform(F.sequence(F.lit(1), F.greatest(count - (REPEAT - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("h", i, REPEAT)))).otherwise(F.array().cast("array<long>"))
    own = [c for c in one.columns if c not in ("h", "word_chars", "n_symbols", "lines")]
    two = one.select(*own, "h", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window.alias("win"))
    # few texts repeat a window: only these sort theirs
    places = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    three = two.select(*own, "h", "word_chars", "n_symbols", "n_dup_lines", places.alias("s"))

    def again(x, j):
        return (_pick(F.col("s"), j + 1)["x"] == x["x"]) | F.when(j > 0, _pick(F.col("s"), F.greatest(j - 1, F.lit(0)))["x"] == x["x"])

    starts = F.array_sort(F.filter(F.transform("s", lambda x, j: F.when(F.coalesce(again(x, j), F.lit(False)), x["i"])), lambda i: i.isNotNull()))
    four = three.select(*own, "h", "word_chars", "n_symbols", "n_dup_lines", starts.alias("at"))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(REPEAT)), F.lit(REPEAT)))
    repeat = F.when(F.col("at").isNotNull(), F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))
    return four.select(*own, F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.cast("long").alias("n_repeat_words"), "h")


def judge(docs: DataFrame, weight: list[float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, the base counts, base_failed, kept, score."""
    base = base_columns(docs, text_of(text_col), F.col(id_col).alias("doc_id"))
    scored = base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", likelihood(F.col("h"), weight).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def op8(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return judge(docs, weights(docs, good))
