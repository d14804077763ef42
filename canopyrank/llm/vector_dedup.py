"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, each with a codebook of its own; the two
codes of a vector name its cell in the product grid. A vector visits the cells
in order of the distance that both halves are farther from than its own cell,
as the multi-sequence traversal meets them, until the bound is reached at which
TARGET of trial partners with a cosine of just LEAST were met. All pairs met are
verified in double precision, so no link is wrong; about one in fifty of the
links right at LEAST may be missed, hardly any above.

Equal vectors are met first and count as one with copies. A block is a part of
a cell's vectors against a part of its visitors: it gives the number of links
of each and a spanning forest of them, never the pairs, and a crowded cell is
cut into as many blocks as it needs.

Defined cases. A null or zero vector, or one with a null or non-finite
component, links with nothing and is a class of its own. A shorter vector
counts as filled up with zeros. Rows that repeat a vec_id are vectors of their
own; a null vec_id is never a class's name unless all its members lack one.
Without vectors there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import map_texts, materialise, nothing_kept
from canopyrank.llm.simhash import components

LEAST = 0.9
#: Share of trial partners at a cosine of LEAST that the traversal is to meet.
TARGET = 0.98
#: Vectors that the codebooks are fitted on (about so many are drawn by hash; every vector is indexed), and trials.
SAMPLE, TRIALS = 20_000, 4_096
#: Codes of a half: a quarter of the root of the number of vectors, as a power of two, within these bounds. Cells, whose sizes are broadcast, are at most the square.
CODES = (1, 1024)
STEPS = 12
#: Vectors and visitors of a block.
BLOCK = 1024


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of doubles, filled up with zeros."""
    flat, at = np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.offsets) - column.offsets[0].as_py()
    long = np.diff(at)
    if len(long) and (long == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(long), dims))
    for k, (a, b) in enumerate(zip(at, at[1:])):
        out[k, : b - a] = flat[a:b]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; neither very large nor very small components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0  # no negative zero


def keyed(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id, key, v: a digest of the direction, null for what links with nothing."""
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for b in batches:
            v = b.column("v")
            keys: list[bytes | None] = [None] * len(v)
            whole = [k for k, x in enumerate(v) if x.is_valid and not x.values.null_count]
            x = _rows(v.take(pa.array(whole, pa.int64())), dims) if whole else np.zeros((0, dims))
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            for k, u in zip(np.array(whole, dtype=int)[ok], unit(x[ok])):
                keys[k] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), v], ["vec_id", "key", "v"])

    return map_texts(rows, run, f"vec_id {kind['vec_id']}, key binary, v {kind['v']}")


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; a code that loses all its vectors stays where it was."""
    codes = x[rng.choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        near = _distances(x, codes).argmin(axis=1)
        order, n = np.argsort(near, kind="stable"), np.bincount(near, minlength=k)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        used = np.flatnonzero(n)
        codes = codes.copy()
        codes[used] = np.add.reduceat(x[order], start[used], axis=0) / n[used, None]
    return codes


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (codes * codes).sum(axis=1) - 2 * x @ codes.T, 0)


def _excess(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much farther each code is than the nearest one, and the nearest."""
    d = _distances(x, codes)
    near = d.argmin(axis=1)
    return d - d[np.arange(len(d)), near][:, None], near


def grid(sample: np.ndarray, codes: int, least: float = LEAST, target: float = TARGET, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Two codebooks, and the excess at which the traversal ends: where the target share of trial partners is met from either side.

    A trial partner has a cosine of just `least` with a sampled vector; a random share of what tells them apart lies in the first half.
    """
    rng, h = np.random.default_rng(seed), sample.shape[1] // 2
    books = [codebook(sample[:, :h], codes, rng), codebook(sample[:, h:], codes, rng)]
    x = sample[rng.permutation(len(sample))[:TRIALS]]
    noise, share = rng.normal(size=x.shape), rng.random(len(x))
    for part, s in ((slice(None, h), share), (slice(h, None), 1 - share)):
        noise[:, part] *= (np.sqrt(s) / np.maximum(np.linalg.norm(noise[:, part], axis=1), 1e-12))[:, None]
    noise -= (noise * x).sum(axis=1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    y = least * x + np.sqrt(1 - least * least) * noise
    at = np.arange(len(x))
    there, back = np.zeros(len(x)), np.zeros(len(x))
    for part, book in zip((slice(None, h), slice(h, None)), books):
        (ex, nx), (ey, ny) = _excess(x[:, part], book), _excess(y[:, part], book)
        there += ex[at, ny]
        back += ey[at, nx]
    return books[0], books[1], float(np.quantile(np.minimum(there, back), target))


def visited(one: np.ndarray, two: np.ndarray, bound: float) -> np.ndarray:
    """Cells (first code * codes + second) within the bound, nearest first: the multi-sequence traversal's, up to where it ends."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    a = a[: max(1, np.searchsorted(one[a], bound, side="right"))]
    ends = np.searchsorted(two[b], bound - one[a], side="right")
    ends[0] = max(1, ends[0])
    i = np.repeat(a, ends)
    j = b[np.concatenate([np.arange(n) for n in ends])]
    return (i * len(two) + j)[np.argsort(one[i] + two[j], kind="stable")]


def place(classes: DataFrame, dims: int, index: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """cid, n, v with the cell that each vector lies in and those it visits."""
    one, two, bound = index
    kind = dict(classes.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for b in batches:
            if not len(b):
                continue
            x = unit(_rows(b.column("v"), dims))
            (e1, n1), (e2, n2) = _excess(x[:, : dims // 2], one), _excess(x[:, dims // 2 :], two)
            cells = [visited(p, q, bound) for p, q in zip(e1, e2)]
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), b.column("v"), pa.array(n1 * len(two) + n2, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["cid", "n", "v", "home", "cells"])

    return map_texts(classes.select("cid", "n", "v"), run, f"cid long, n long, v {kind}, home int, cells array<int>")


def block_links(h: tuple, p: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between a cell's vectors h and visitors p, each (ids, copies, unit rows, homes, and of h the cells visited).

    Who visits counts the link. Where the other does not visit back, it is counted for it here as well: so every link
    counts once for either side, whichever block meets it. Gives the links of p, those of h and the smallest id that
    links of this block lead to, for p and then h.
    """
    (hi, hn, hx, hc, visits), (pi, pn, px, pc_, _) = h, p
    link = px @ hx.T >= least
    link &= pi[:, None] != hi[None, :]
    back = np.zeros(link.shape, dtype=bool)
    homes, which = np.unique(pc_, return_inverse=True)
    seen = np.stack([np.isin(homes, v) for v in visits]) if len(visits) else np.zeros((0, len(homes)), dtype=bool)
    back = seen[:, which].T
    for_p = link @ hn
    for_h = pn @ (link & ~back)
    low_p, low_h = pi.copy(), hi.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_p = np.minimum(low_p, np.where(link, low_h[None, :], top).min(axis=1, initial=top))
        new_h = np.minimum(low_h, np.where(link, new_p[:, None], top).min(axis=0, initial=top))
        if (new_p == low_p).all() and (new_h == low_h).all():
            return for_p, for_h, np.concatenate([low_p, low_h])
        low_p, low_h = new_p, new_h


def class_links(placed: DataFrame, dims: int, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Rows u, v, n from all blocks: n links of u to other classes' vectors, and v a smaller class that u is joined to, if any."""
    kind = dict(placed.dtypes)["v"]
    parts = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    sizes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("h"))
    guests = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("p"))
    # a row for each cell in use, at most the square of CODES
    cut = F.broadcast(materialise(sizes.join(guests, "cell").select("cell", parts("h").alias("hs"), parts("p").alias("ps")), "cells"))
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    none = F.lit(None).cast("array<int>")
    own = placed.withColumn("cell", F.col("home")).join(cut, "cell").select("cell", deal("hs").alias("hp"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("pp"), F.lit(0).alias("side"), "cid", "n", "v", "home", "cells")
    guest = placed.withColumn("cell", F.explode("cells")).join(cut, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("hp"), deal("ps").alias("pp"), F.lit(1).alias("side"), "cid", "n", "v", "home", none.alias("cells"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sides = []
        for k in (0, 1):
            s = t.filter(pc.equal(t.column("side"), k))
            v = s.column("v").combine_chunks()
            x = unit(_rows(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, dims)) if len(s) else np.zeros((0, dims))
            sides.append((s.column("cid").to_numpy(), s.column("n").to_numpy(), x, s.column("home").to_numpy(), [np.array(c, dtype=np.int64) for c in s.column("cells").to_pylist()] if k == 0 else None))
        h, p = sides
        for_p, for_h, low = block_links(h, p, least)
        u, n = np.concatenate([p[0], h[0]]), np.concatenate([for_p, for_h])
        some = (n > 0) | (low != u)
        u, n, low = u[some], n[some], low[some]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(low, pa.int64(), mask=low == u), "n": pa.array(n, pa.int64())})

    return own.unionByName(guest).select("cell", "hp", "pp", "side", "cid", "n", F.col("v").cast(kind).alias("v"), "home", "cells").groupBy("cell", "hp", "pp").applyInArrow(run, "u long, v long, n long")


def code_count(n: int) -> int:
    """A quarter of the root of n, as a power of two within CODES, and no more than there are vectors."""
    root = max(1, int(np.sqrt(n) / 4))
    return max(CODES[0], min(CODES[1], 1 << (root - 1).bit_length(), n))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    # both halves have components
    dims = max(2, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    dims += dims % 2
    rows = materialise(keyed(rows, dims), "vectors")
    found = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = materialise(found.withColumn("cid", F.monotonically_increasing_id()), "directions")
    total = classes.count()
    if total:
        drawn = classes.filter(F.pmod(F.xxhash64("key"), F.lit(total // SAMPLE + 1)) == 0) if total > SAMPLE else classes
        some = drawn.orderBy("key").select("v").toArrow().column("v").combine_chunks()
        sample = unit(_rows(some.chunk(0) if isinstance(some, pa.ChunkedArray) else some, dims))
        placed = materialise(place(classes, dims, grid(sample, min(code_count(total), len(sample)), least, target)), "placed")
        links = materialise(class_links(placed, dims, least, block), "links")
    else:
        links = rows.sparkSession.createDataFrame([], "u long, v long, n long")
    label = components(links.filter("v IS NOT NULL").select("u", "v").distinct())
    count = links.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n_links"))
    named = classes.select("key", "cid", "n", "least").join(count, "cid", "left").join(label.withColumnRenamed("fp", "cid"), "cid", "left")
    named = materialise(named.select("key", "least", F.coalesce("root", "cid").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = materialise(named.join(first, "root").select("key", "n_links", "component_id"), "classes")
    # a direction that many vectors share is split by the adaptive join: both sides are plain scans
    whole = rows.filter("key IS NOT NULL").select("vec_id", "key").join(by_key, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12(spark, sf_dir) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
