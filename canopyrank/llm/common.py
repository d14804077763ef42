"""Helpers the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopyrank.storage import discard, drop_materialised, materialise  # noqa: F401  the operators import them from here

#: The contracts' word patterns.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between such words, A-Z taken as a-z
ALNUM_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def between(c: Column, gap: str) -> Column:
    """The non-empty stretches between gaps. Splitting costs a tenth of regexp_extract_all, which copies the text for each match."""
    return F.array_remove(F.split(c, gap, -1), "")


def kept_by_worker(kind: str, key, make):
    """What make() gives, kept for the next tasks of this Python worker, one thing at a time: another kind or key takes its place.

    Functions reach workers by value, so a module's own globals would start anew with every task.
    """
    home = sys.modules.setdefault("_canopyrank_worker", types.ModuleType("_canopyrank_worker"))
    if (getattr(home, "kept", None) or (None,))[0] != (kind, key):
        home.kept = None
        give_back()
        home.kept = ((kind, key), make())
    return home.kept[1]


def nothing_kept() -> None:
    """Let go of what an operator before has left with this Python worker."""
    sys.modules.pop("_canopyrank_worker", None)
    give_back()


def give_back() -> None:
    """Hand memory that is no longer used back to the system: a worker outlives its tasks, and Arrow and the C library keep what was freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


#: Bytes of an Arrow batch of texts: what a worker and its executor hold of them at once, but for a single longer text.
BATCH_BYTES = 1 << 20


def map_texts(rows: DataFrame, run, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded size; the bound is left with the session, as the plan reads it when it runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows.sparkSession.conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def text_of(c: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def running(values: Column, zero: Column, step, block: int = 256) -> Column:
    """For each value of an array, what step gives over those before it; zero for the first.

    Appending within aggregate copies what is there, so blocks are worked out on their own and then joined: an array
    of n values takes n * (block + n / block ** 2) copies. step must be associative. values should be a column of
    its own, as it is read for every block.
    """

    def before(x: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array_remove(F.array(zero), zero).alias("out"))
        return F.aggregate(x, start, lambda a, v: F.struct(step(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    count = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(values, k * block + 1, block))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
    joined = F.flatten(F.zip_with(blocks, before(totals), lambda b, t: F.transform(before(b), lambda x: step(t, x))))
    return F.when(F.size(values) <= block, before(values)).otherwise(joined)
