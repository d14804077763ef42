"""What each filter of a set removes, for every order in which they could run.

Every document gets a mask, a bit for each filter that it fails. Counts by part
and mask are all that the audit needs: a sum over subsets (the zeta transform)
turns them into the survivors of each of the 32 filter sets, a step of an order
is the difference between two neighbouring sets, and labels go the same way.
The corpus is read once; beyond the masks, work depends on parts, not rows.

Defined cases. A null text is empty, and equal to other empty ones. A null
source is the part of the empty string. Documents that repeat a doc_id count
each; of equal texts those with the smallest doc_id are not copies. A null
doc_id has no label, is never a copy and makes none. A doc_id with several
labels is good or toxic if one of them says so. Without documents there are no
parts and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import UPPER, map_texts, materialise, nothing_kept

#: The filters' letters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"
COPY = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
#: Bytes of a text split into words at once.
PIECE = 4 << 20
#: Parts that rows without a doc_id are dealt to.
SALTS = 64


def word_counts(text: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words and distinct words; a long text is split piece by piece, so that only its distinct words are held."""
    if len(text) <= piece:
        words = text.split()
        return len(words), len(set(words))
    n, seen, rest = 0, set(), b""
    for at in range(0, len(text), piece):
        block = rest + text[at : at + piece]
        words = block.split()
        rest = words.pop() if words and not block[-1:].isspace() else b""
        n += len(words)
        seen.update(words)
    return (n + 1, len(seen | {rest})) if rest else (n, len(seen))


def mask_of(text: bytes, length: int) -> int:
    """The bits of A to D that a text of so many code points fails."""
    n, distinct = word_counts(text)
    upper = len(text) - len(text.translate(None, UPPER.encode()))
    fails = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * upper > UPPER_PERCENT * length, len(text.translate(None, SYMBOLS.encode())) < len(text))
    return sum(1 << k for k, bad in enumerate(fails) if bad)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, part, mask (A to D), key (SHA-256 of the text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for b in batches:
            text, long = b.column("text"), pc.utf8_length(b.column("text")).to_pylist()
            mask, key = [], []
            for t, n in zip(text, long):
                raw = t.as_buffer().to_pybytes()
                mask.append(mask_of(raw, n))
                key.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(mask, pa.int32()), pa.array(key, pa.binary())], ["doc_id", "part", "mask", "key"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, mask int, key binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (A to E), n, good, toxic: documents by what they fail.

    Equal texts fail the same of A to D, so E is decided on counts by text: of a text's documents all but those of
    its smallest doc_id are copies. A text that many documents share is summed on the map side.
    """
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0)).alias("salt")
    rows = masks(docs, id_col, text_col, part_col).groupBy("doc_id", salt, "part", "mask", "key").agg(F.count("*").alias("n"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("t")).filter("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max(F.col("q") == 1).alias("good"), F.max(F.col("t") == 1).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    flagged = rows.join(known, ["doc_id", "salt"], "left").select("doc_id", F.col("doc_id").isNull().alias("none"), "part", "mask", "key", "n", is_("good"), is_("toxic"))
    by_text = materialise(flagged.groupBy("key", "mask", "part", "good", "toxic", "none").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")), "texts")
    first = by_text.groupBy("key").agg(F.min("least").alias("first"))
    fresh = F.when(F.col("none"), F.col("n")).when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    both = by_text.join(first, "key").withColumn("fresh", fresh)
    one = both.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("x"))
    some = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(F.lit(0)))
    return one.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def subset_sums(counts: Column) -> Column:
    """The zeta transform of an array by mask: at each mask the sum over all masks within it, one bit after the other."""
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    step = lambda sums, bit: F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.get(sums, m - bit)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, counts, step)


def survivors(counts: DataFrame) -> DataFrame:
    """One row for each part: n, good, toxic as arrays, at each filter set (its mask) the documents that none of its filters removes."""
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic").alias("x"))))
    whole = F.sequence(F.lit(0), F.lit(ALL))
    part = counts.groupBy("part").agg(by_mask.alias("at"))
    array = lambda c: F.transform(whole, lambda m: F.coalesce(F.col("at")[m][c], F.lit(0).cast("long")))
    part = part.select("part", *[array(c).alias(c) for c in ("n", "good", "toxic")])
    # who passes a set fails others only: the sum at its complement, which stands as far from the array's end
    return part.select("part", *[F.reverse(subset_sums(F.col(c))).alias(c) for c in ("n", "good", "toxic")])


def audit(kept_by: DataFrame) -> DataFrame:
    """Every order of the filters step by step, from survivors(): part, filter_order, step and its counts."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = kept_by.select("part", "n", "good", "toxic", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda inside: sum((F.when(F.instr(inside, f) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0))
    order = F.col("filter_order")
    rows = rows.withColumns({"before": bit_of(F.substring(order, F.lit(1), F.col("step") - 1)), "bit": bit_of(F.substring(order, F.col("step"), F.lit(1)))})
    at = lambda c, s: F.get(F.col(c), s)
    before, bit = F.col("before"), F.col("bit")
    removed = lambda c, s: at(c, s) - at(c, s + bit)
    # a filter set of k others comes first in k! (4 - k)! of the orders
    k = len(FILTERS) - 1
    ways = F.array(*[F.lit(factorial(i) * factorial(k - i)).cast("long") for i in range(k + 1)])
    without = F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda s: s.bitwiseAND(bit) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda a, s: a + F.get(ways, F.bit_count(s)) * removed("n", s))
    return rows.select(
        "part", "filter_order", "step", at("n", before + bit).alias("kept"), removed("n", before).alias("removed"), (removed("n", F.lit(0)) - removed("n", before)).alias("redundant"),
        removed("n", F.lit(ALL) - bit).alias("unique_fails"), removed("good", before).alias("good_lost"), removed("toxic", before).alias("toxic_lost"), shapley.alias("shapley"))


def op11(spark, sf_dir) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(survivors(mask_counts(table("documents"), table("labels"))))
