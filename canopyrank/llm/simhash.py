"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A pair of trie nodes is followed downwards together; the bits in which their
prefixes differ add up, and a pair over the error budget is dropped with all
that hangs below it. The top of the trie is cut where nodes become small: a
histogram of short prefixes, whose size is fixed, tells where. Pairs of cut
nodes within the budget are the tasks; each holds only its nodes'
fingerprints. Equal fingerprints are met first, so copies cost nothing, and a
task returns a spanning forest of its links rather than all of them.

Two bits of 64 are few: texts whose five-word shingles are 0.8 alike differ in
seven. deduplicate() therefore takes a second pass over one text of each class:
a sketch of 512 such bits, drawn from the same shingle hashes, is compared
where texts agree in the leading bits of one of its words, and links up to WIDE
bits join classes.

Defined cases. A null text is empty; a text without words has fingerprint zero
and is linked like any other. Fewer than three words make one shingle. Rows
that repeat are documents of their own with the same class. A null doc_id is
never a class's name unless all its members lack one; then the class is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyrank.llm.common import discard, map_texts, materialise, nothing_kept

SHINGLE = 3
SEED = 42
BUDGET = 2
#: Bits of the histogram that places the cut; it has at most 2 ** 14 rows, and these alone reach the driver.
CUT_BITS = 14
#: Fingerprints below which a node is not cut further, and nodes aimed at where there are many.
LEAST_NODE, NODES = 1024, 1024
#: Fingerprints that one partition of tasks is to hold.
TASK_ROWS = 500_000
#: Node pairs held at once while a task descends.
FRONTIER = 1 << 20
#: Bits by which a node that is still too heavy is cut deeper, with a histogram of its own.
DEEPER = 6
#: Words of a sketch, and its bits that may differ: 64 of 512 where five-word shingles are about 0.8 alike.
SKETCH, WIDE = 8, 64
#: Where in a word of the sketch a key begins, and its bits: the same for every input, so that what links two texts does not depend on others.
OFFSETS, KEY_BITS = (0, 16, 32, 48), 16
#: Rows of a bucket up to which all its pairs are compared, many buckets at a time.
SMALL_BUCKET = 32
#: Links that a forest may have for each node that has a lesser one, and the part of them that a further step may leave.
SPARE, GAIN = 1.1, 0.95
#: Links that are joined at once, and pieces that they may come in.
LINKS, PIECES = 1 << 20, 1 << 13
#: Rows of a block of a bucket of sketches, and crowded buckets (24 bytes each) that one broadcast may name.
BUCKET_ROWS, LEAST_HEAVY = 1 << 15, 100_000


def _hashes(text: str | None) -> np.ndarray:
    """A hash for each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64 majority bits of a text's shingle hashes."""
    return int(_majority(_hashes(text)[:, None])[0])


def _majority(h: np.ndarray) -> np.ndarray:
    """The majority bits of each column of hashes."""
    votes = np.zeros(64 * h.shape[1], dtype=np.int64)
    for at in range(0, len(h), 255):  # so many fit the sum's type
        votes += np.unpackbits(h[at : at + 255].astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(h)).view(">u8").astype(np.uint64)


#: Odd multipliers that draw a sketch's words from a hash.
_DRAW = np.array([xxhash.xxh64_intdigest(b"sketch%d" % k) | 1 for k in range(SKETCH)], dtype=np.uint64)


def _drawn(h: np.ndarray) -> np.ndarray:
    """The hashes, and beside them as many further ones as a sketch has words."""
    x = h[:, None] * _DRAW
    return np.column_stack([h, x ^ (x >> np.uint64(32))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: bool = False) -> DataFrame:
    """One row for each input row: doc_id, text_key, fp (the bits as a signed long), and with a sketch its words s0, s1, ..."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    names = ["fp", *(f"s{k}" for k in range(SKETCH if sketch else 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for b in batches:
            found = [_hashes(t.as_py()) for t in b.column("text")]
            bits = np.array([_majority(_drawn(h) if sketch else h[:, None]) for h in found], dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(c, pa.int64()) for c in bits.T)], ["doc_id", "text_key", *names])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_key long, " + ", ".join(f"{n} long" for n in names))


def cut_nodes(histogram: dict[int, int], limit: int, bits: int = CUT_BITS) -> list[tuple[int, int, int]]:
    """(depth, prefix, size) of the nodes where the trie is cut; together they hold every fingerprint once.

    histogram: sizes of prefixes of so many bits; none is cut deeper.
    """
    counts, out = {bits: dict(histogram)}, []
    for d in range(bits - 1, -1, -1):
        up: dict[int, int] = {}
        for p, n in counts[d + 1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        counts[d] = up
    todo = [(0, 0)]
    while todo:
        d, p = todo.pop()
        n = counts[d].get(p, 0)
        if not n:
            continue
        if d == bits or n <= limit:
            out.append((d, p, n))
        else:
            todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    return sorted(out)


def _prefix(bits: int) -> "F.Column":
    """The leading bits of fp as a long; one sign bit more than needed is kept off."""
    return F.shiftrightunsigned("fp", 64 - bits)


def heavy_cut(distinct: DataFrame) -> tuple[list[tuple[int, int]], dict[int, int], DataFrame]:
    """The nodes of the trie, their sizes, and the fingerprints with the number of their node (fp, node).

    Nodes that are heavier than the limit at the histogram's depth are cut deeper, a few bits at a time, until none
    is: there are at most NODES of them at any depth, so each histogram that reaches the driver is small.
    """
    spark = distinct.sparkSession
    depth, histogram = CUT_BITS, {r["p"]: r["n"] for r in distinct.groupBy(_prefix(CUT_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    limit = max(LEAST_NODE, total // NODES)
    found, levels = cut_nodes(histogram, limit), [CUT_BITS]
    while heavy := [(d, p) for d, p, n in found if d == depth and n > limit and d < 64]:
        deep = min(64, depth + DEEPER)
        inside = spark.createDataFrame([(p,) for _, p in heavy], "p long")
        below = distinct.select("fp", _prefix(depth).alias("p")).join(F.broadcast(inside), "p").groupBy(_prefix(deep).alias("q")).agg(F.count("*").alias("n")).collect()
        of: dict[int, dict[int, int]] = {p: {} for _, p in heavy}
        for r in below:
            p = (r["q"] % (1 << 64)) >> (deep - depth)
            of[p][(r["q"] % (1 << 64)) - (p << (deep - depth))] = r["n"]
        found = [x for x in found if (x[0], x[1]) not in set(heavy)]
        for p, h in of.items():
            found += [(depth + d, (p << d) + q, n) for d, q, n in cut_nodes(h, limit, deep - depth)]
        found, depth, levels = sorted(found), deep, [*levels, deep]
    nodes = [(d, p) for d, p, _ in found]
    # which node a fingerprint falls in: the prefixes below each node at the depth of the histogram it came from
    at: dict[int, list[tuple[int, int]]] = {level: [] for level in levels}
    for k, (d, p) in enumerate(nodes):
        level = min(x for x in levels if x >= d)
        some = [q for q in range(p << (level - d), (p + 1) << (level - d)) if level > CUT_BITS or q in histogram]
        at[level] += [(q - (1 << 64) if q >> 63 else q, k) for q in some]
    rows, parts = distinct.select("fp"), []
    for level in levels:
        names = spark.createDataFrame(at[level] or [(0, -1)], f"q{level} long, n{level} int")
        rows = rows.withColumn(f"q{level}", _prefix(level)).join(F.broadcast(names), f"q{level}", "left")
        parts.append(F.col(f"n{level}"))
    return nodes, {k: n for k, (_, _, n) in enumerate(found)}, rows.select("fp", F.coalesce(*parts).alias("node"))


def node_pairs(nodes: list[tuple[int, int]], budget: int = BUDGET) -> list[tuple[int, int]]:
    """Index pairs of cut nodes that may hold linked fingerprints, found by descending from the root in pairs."""
    index = {n: k for k, n in enumerate(nodes)}
    inner = {(e, p >> (d - e)) for d, p in nodes for e in range(d)}
    out, todo = [], [((0, 0), (0, 0), 0)]

    def below(n):
        return [n] if n in index else [c for c in ((n[0] + 1, 2 * n[1]), (n[0] + 1, 2 * n[1] + 1)) if c in index or c in inner]

    while todo:
        a, b, _ = todo.pop()
        if a in index and b in index:
            out.append((index[a], index[b]))
            continue
        if a == b:
            kids = below(a)
            new = [(x, y) for i, x in enumerate(kids) for y in kids[i:]]
        elif b in index or (a not in index and a[0] <= b[0]):
            new = [(x, b) for x in below(a)]
        else:
            new = [(a, y) for y in below(b)]
        for x, y in new:
            d = min(x[0], y[0])
            if (e := ((x[1] >> (x[0] - d)) ^ (y[1] >> (y[0] - d))).bit_count()) <= budget:
                todo.append((x, y, e))
    return sorted({(min(a, b), max(a, b)) for a, b in out})


def _links(fps: np.ndarray, a0, a1, b0, b1, bit: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Descend from node pairs, given as ranges of the sorted fps and the next bit to tell apart; yield linked places.

    The bits that differ so far are those above the bit in the first members, which all members of a node share.
    """
    stack = [(a0, a1, b0, b1, bit)]
    while stack:
        a0, a1, b0, b1, bit = stack.pop()
        if len(a0) > FRONTIER:
            h = len(a0) // 2
            stack += [(a0[:h], a1[:h], b0[:h], b1[:h], bit[:h]), (a0[h:], a1[h:], b0[h:], b1[h:], bit[h:])]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = (x != y) & (np.bitwise_count(fps[x] ^ fps[y]) <= budget)
            yield x[near], y[near]
            a0, a1, b0, b1, bit = (v[~single] for v in (a0, a1, b0, b1, bit))
        if not len(a0):
            continue
        mask = np.uint64(1) << bit.astype(np.uint64)
        am, bm = (_split(fps, lo, hi, mask) for lo, hi in ((a0, a1), (b0, b1)))
        same = (a0 == b0) & (a1 == b1)
        parts = []
        for (x0, x1), (y0, y1), keep in (
            ((a0, am), (b0, bm), None), ((am, a1), (bm, b1), None), ((a0, am), (bm, b1), None), ((am, a1), (b0, bm), ~same),
        ):
            ok = (x1 > x0) & (y1 > y0)
            if keep is not None:
                ok &= keep
            ok &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
            x0, x1, y0, y1, k = x0[ok], x1[ok], y0[ok], y1[ok], bit[ok]
            above = (fps[x0] ^ fps[y0]) >> k.astype(np.uint64)
            ok = np.bitwise_count(above) <= budget
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], k[ok] - 1))
        stack.append(tuple(np.concatenate(v) for v in zip(*parts)))


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Where the bit turns to one within each sorted range, by bisection of all ranges together."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (fps[np.minimum(mid, len(fps) - 1)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def spanning_links(fps: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Join each place to the smallest of its component, as far as the given links reach."""
    root = np.arange(len(fps))
    for x, y in pairs:
        while len(x):
            rx, ry = root[x], root[y]
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return moved, root[moved]


def near_pairs(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v) that connect just those fingerprints that links within the budget connect.

    distinct: one row for each fingerprint, column fp.
    """
    spark = distinct.sparkSession
    nodes, size, fps = heavy_cut(distinct)
    pairs = node_pairs(nodes, budget)
    own: dict[int, list[tuple[int, int]]] = {}  # node: its tasks, and the side it takes in each
    for t, (a, b) in enumerate(pairs):
        own.setdefault(a, []).append((t, 0))
        if b != a:
            own.setdefault(b, []).append((t, 1))
    tasks = spark.createDataFrame([(k, [list(x) for x in v]) for k, v in own.items()] or [(0, [])], "node int, tasks array<array<int>>")
    copies = sum(len(v) * size[k] for k, v in own.items())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(copies // TASK_ROWS + 1, len(pairs)))
    # nodes are in the order of NODES, and so are the pairs of each
    fps = fps.join(F.broadcast(tasks), "node").select("fp", F.explode("tasks").alias("t"))
    fps = fps.select("fp", F.col("t")[0].alias("task"), F.col("t")[1].alias("side")).repartition(parts, "task")
    first_bit = np.array([63 - min(nodes[a][0], nodes[b][0]) for a, b in pairs] or [63], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [b for b in batches if len(b)]
        if not all_:
            return
        df = pd.concat(all_, ignore_index=True)
        bits = df["fp"].to_numpy(np.int64).view(np.uint64)
        group = df["task"].to_numpy(np.int64) * 2 + df["side"].to_numpy(np.int64)
        order = np.lexsort((bits, group))
        bits, group = bits[order], group[order]
        keys, lo = np.unique(group, return_index=True)
        hi = np.append(lo[1:], len(group))
        at = {int(k): (l, h) for k, l, h in zip(keys, lo, hi)}
        a, b, bit = [], [], []
        for t in sorted({int(k) // 2 for k in keys}):
            if (x := at.get(2 * t)) is None:
                continue
            y = at.get(2 * t + 1, None)
            if y is None:
                if pairs_self[t]:
                    y = x
                else:
                    continue
            a.append(x), b.append(y), bit.append(first_bit[t])
        if not a:
            return
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        # different nodes may share no range, and their own bits below the shallower depth are told apart by the fps
        x, y = spanning_links(bits, _links(bits, a[:, 0], a[:, 1], b[:, 0], b[:, 1], np.array(bit), budget))
        out = pd.DataFrame({"u": bits[x].view(np.int64), "v": bits[y].view(np.int64)})
        yield out[out["u"] != out["v"]].drop_duplicates()

    pairs_self = [a == b for a, b in pairs] or [True]
    return fps.mapInPandas(run, "u long, v long")


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v), u the lesser, that connect what the given links connect, about as many as there are linked nodes.

    A node's links to lesser ones are handed to the least of these: a node keeps one, the others become links between
    the lesser nodes, where most are alike. So no step adds a link. It ends when few nodes have a second lesser one,
    or little is gained.
    """
    least = F.min("u").over(Window.partitionBy("v"))
    rows, before = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links"), None
    while True:
        n, nodes = rows.groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if n <= SPARE * nodes or (before is not None and n > GAIN * before):
            return rows
        handed = rows.withColumn("least", least).select(F.col("least").alias("u"), F.when(F.col("u") == F.col("least"), F.col("v")).otherwise(F.col("u")).alias("v"))
        fewer = materialise(handed.distinct(), "links")
        discard(rows)
        rows, before = fewer, n


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): fp, root, for every linked node. Labels halve their paths each round."""
    links = forest(links)
    both = materialise(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    discard(links)
    label = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "fp"), "labels")
    while True:
        seen = both.join(label.select(F.col("fp").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        new = label.join(seen.withColumnRenamed("u", "fp"), "fp").select("fp", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        new = materialise(new, "labels")
        # one step up for the label itself
        up = label.select(F.col("fp").alias("root"), F.col("root").alias("up"))
        jumped = materialise(new.join(up, "root").select("fp", "old", F.least("root", "up").alias("root")), "labels")
        discard(new)
        discard(label)
        label = jumped
        if jumped.filter(F.col("old") != F.col("root")).isEmpty():
            return jumped.select("fp", "root")


def classes(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", sketch: bool = False) -> DataFrame:
    """One row for each input row: doc_id, text_key, fp, root (a fingerprint that names the class), component_id, and the sketch if asked for.

    component_id is the smallest doc_id that links lead to; where ids repeat, two classes may share it, but no root.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, sketch), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(near_pairs(distinct, budget))
    named = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # roots without links name a class of one fingerprint; only the others are summed
    name = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialise(materialise(named, "named").join(materialise(name, "names"), "root").select("fp", "root", "component_id"), "classes")
    # a fingerprint that a large part of the rows share is split by the adaptive join: both sides are plain scans
    more = [f"s{k}" for k in range(SKETCH if sketch else 0)]
    return fps.join(by_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id", *more)


def key_bits(_total: int | None = None) -> int:
    """Bits of a key, whatever the number of texts."""
    return KEY_BITS


def _crowd(words: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places) that connect what lies within reach in one bucket, fewer than it has texts.

    The first text that no other has taken leads: it is compared with all, takes those within reach that are free, and
    of the others' within reach one for each component. Then texts of different leaders are compared where no link has
    joined these: what lies within `wide` of each other lies within 3 * wide by their leaders, and each within
    2 * wide of the other's leader.
    """
    apart = lambda x, y: np.bitwise_count(words[x] ^ words[y]).sum(axis=-1)
    owner = np.full(len(words), -1)
    label = np.arange(len(words))  # of each leader's cluster: its component
    leader: list[int] = []
    for i in range(len(words)):
        if owner[i] >= 0:
            continue
        near, k = np.flatnonzero(np.bitwise_count(words ^ words[i]).sum(axis=1) <= wide), len(leader)
        taken = owner[near] >= 0
        met, fresh = near[taken], near[~taken]
        owner[fresh] = k
        leader.append(i)
        if len(met):
            of, first = np.unique(label[owner[met]], return_index=True)
            met = met[first]
            label[:k][np.isin(label[:k], of)] = k
        to = np.concatenate([fresh[fresh != i], met])
        yield np.full(len(to), i), to
    owner[leader] = -1  # these have met all others
    members = np.flatnonzero(owner >= 0)
    members = members[np.argsort(owner[members], kind="stable")]
    many, start = np.unique(owner[members], return_index=True)
    taken, heads, label = np.split(members, start[1:]), np.array(leader)[many], label[many]
    for a in range(len(many)):
        rest = np.flatnonzero(label[a + 1 :] != label[a]) + a + 1
        for b in rest[apart(heads[rest], heads[a]) <= 3 * wide]:
            if label[a] == label[b]:
                continue
            x = taken[a][apart(taken[a], heads[b]) <= 2 * wide]
            y = taken[b][apart(taken[b], heads[a]) <= 2 * wide]
            if not len(x):
                continue
            for m in y:
                hit = np.flatnonzero(apart(x, m) <= wide)
                if len(hit):
                    label[label == label[b]] = label[a]
                    yield x[hit[:1]], np.array([m])
                    break


def _close(words: np.ndarray, band: np.ndarray, key: np.ndarray, part: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places) that connect what lies within reach in the buckets of equal band, key and part.

    In a small bucket all pairs are compared, and those within reach given; for a larger one see _crowd.
    """
    order = np.lexsort((part, key, band))
    cut = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(key[order]) != 0) | (np.diff(part[order]) != 0)) + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(order)]])
    yield order[:0], order[:0]
    for m in range(2, SMALL_BUCKET + 1):
        of, step = start[end - start == m], max(1, (1 << 18) // m)
        for at in range(0, len(of), step):
            place = order[of[at : at + step, None] + np.arange(m)]
            for d in range(1, m):
                a, b = place[:, :-d].ravel(), place[:, d:].ravel()
                near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= wide
                yield a[near], b[near]
    large = end - start > SMALL_BUCKET
    for lo, hi in zip(start[large], end[large]):
        at = order[lo:hi]
        for a, b in _crowd(words[at], wide):
            yield at[a], at[b]


def _gathered(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same links in fewer, bounded pieces."""
    some, n = [], 0
    for a, b in links:
        if len(a):
            some.append((a, b))
            n += len(a)
        if n >= LINKS or len(some) >= PIECES:
            yield tuple(np.concatenate(x) for x in zip(*some))
            some, n = [], 0
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some))


def _parts(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Add column part, and tell how many rows that adds: 0, or in a bucket (band, key) of more than `most` rows one for each pair of its blocks.

    A row of such a bucket goes to every pair that its block is in, so any two rows of a bucket meet in a part, and
    no part holds many more than 2 * most rows.
    """
    heavy = materialise(rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "heavy")
    count = heavy.count()
    if not count:
        return rows.withColumn("part", F.lit(0).cast("long")), 0
    blocks = heavy.select("band", "key", F.ceil(F.col("n") / most).cast("long").alias("blocks"))
    cut = rows.join(F.broadcast(blocks) if count <= LEAST_HEAVY else blocks, ["band", "key"], "left")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cut = cut.withColumn("block", F.coalesce(block, F.lit(0).cast("long"))).withColumn("other", F.explode(other))
    pair = F.least("block", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("block", "other")
    copies = heavy.agg(F.sum(F.col("n") * (F.ceil(F.col("n") / most) - 1))).first()[0]
    return cut.withColumn("part", pair).drop("blocks", "block", "other"), int(copies)


def sketch_links(texts: DataFrame, wide: int = WIDE, most: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) that connect the texts (id, s0, s1, ...) whose sketches differ in at most `wide` bits and agree in a key.

    A task links each of its texts at most once, to the least that it is connected with there.
    """
    names = [f"s{k}" for k in range(SKETCH)]
    total = texts.count()
    bits = key_bits()
    turned = lambda s, o: F.shiftleft(s, o).bitwiseOR(F.shiftrightunsigned(s, 64 - o)) if o else F.col(s)
    keys = [F.struct(F.lit(k * len(OFFSETS) + j).cast("short").alias("band"), F.shiftrightunsigned(turned(s, o), 64 - bits).alias("key")) for k, s in enumerate(names) for j, o in enumerate(OFFSETS)]
    rows, copies = _parts(texts.select("id", *names, F.explode(F.array(*keys)).alias("k")).select("id", *names, "k.band", "k.key"), most)
    count = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total * len(keys) + copies) // TASK_ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = [b for b in batches if len(b)]
        if not all_:
            return
        t = pa.Table.from_batches(all_)
        col = lambda c: t.column(c).to_numpy()
        ids, words = col("id"), np.column_stack([col(n) for n in names]).view(np.uint64)
        own, place = np.unique(ids, return_inverse=True)
        links = ((place[a], place[b]) for a, b in _close(words, col("band"), col("key"), col("part"), wide))
        v, u = spanning_links(own, _gathered(links))
        yield pa.RecordBatch.from_arrays([pa.array(own[u], pa.int64()), pa.array(own[v], pa.int64())], ["u", "v"])

    return rows.repartition(count, "band", "key", "part").mapInArrow(run, "u long, v long").distinct()


def deduplicate(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", wide: int | None = WIDE) -> DataFrame:
    """One row of each class, all columns kept: the smallest doc_id, and of rows that share it the smallest text_key.

    wide: the bits that sketches may differ in for classes to be joined; None leaves the classes as the budget makes them.
    """
    names = [f"s{k}" for k in range(SKETCH)] if wide is not None else []
    found = materialise(classes(docs, budget, id_col, text_col, wide is not None), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", *names))
    keep = materialise(found.groupBy("root").agg(first.alias("k")), "keepers")
    if wide is not None:
        label = components(sketch_links(keep.select(F.col("root").alias("id"), "k.*"), wide)).select(F.col("fp").alias("root"), F.col("root").alias("joined"))
        keep = materialise(keep.join(label, "root", "left").groupBy(F.coalesce("joined", "root").alias("root")).agg(F.min("k").alias("k")), "keepers")
    keep = keep.select(F.col("k.doc_id").alias("__dedup_id"), F.col("k.text_key").alias("__dedup_key"))
    same = docs[id_col].eqNullSafe(keep["__dedup_id"]) & (F.xxhash64(docs[text_col]) == keep["__dedup_key"])
    out = docs.join(keep, same, "left_semi")
    repeats = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__dedup_id"), F.col("text_key").alias("__dedup_key"))
    repeats = materialise(repeats, "repeats")
    if repeats.isEmpty():
        return out
    again = out[id_col].eqNullSafe(repeats["__dedup_id"]) & (F.xxhash64(out[text_col]) == repeats["__dedup_key"])
    return out.join(repeats, again, "left_anti").unionByName(out.join(repeats, again, "left_semi").dropDuplicates([id_col, text_col]))


def op6(spark, sf_dir) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
