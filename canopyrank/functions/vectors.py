"""Vector arithmetic on array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Inner product over the shorter length."""
    a, b = as_double(a), as_double(b)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v, dims: int | None = None) -> Column:
    """The first dims components, scaled to length one; a zero vector stays."""
    v = as_double(v)
    if dims is not None:
        v = F.slice(v, 1, dims)
    size = norm(v)
    # an expression within a lambda is worked out for every component; as an outer lambda's variable it is once for the vector
    return F.when(size > 0, F.transform(F.array(size), lambda n: F.transform(v, lambda x: x / n))[0]).otherwise(v)


def cosine(a, b) -> Column:
    """Cosine similarity, 0 where either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def sums(df: DataFrame, key: str | list[str], v: str, weight: Column | None = None) -> DataFrame:
    """One row for each key: n and the component sums as an array, pre-aggregated on the map side."""
    keys = [key] if isinstance(key, str) else key
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*keys, w.alias("w"), F.posexplode(as_double(v)).alias("i", "x"))
    part = rows.groupBy(*keys, "i").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"])
    return part.groupBy(*keys).agg(F.max("n").alias("n"), vec.alias("total"))


def centroids(df: DataFrame, key: str | list[str], v: str, weight: Column | None = None) -> DataFrame:
    """Mean directions: key, n, mu (unit length)."""
    keys = [key] if isinstance(key, str) else key
    s = sums(df, key, v, weight)
    return s.select(*keys, "n", unit(F.col("total")).alias("mu"))
