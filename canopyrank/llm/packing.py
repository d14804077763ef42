"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and an end id. Whole windows are cut off
its front; what remains, shorter than a window, is a piece that is packed with
others. A bucket of pieces is split into k windows of near-equal load: partial
partitions wait in a heap by their imbalance, and the two most unbalanced are
merged, the heaviest slot of one with the lightest of the other. k starts at
the smallest number that could hold the bucket, and rises while a window would
exceed the capacity. Pieces over CUT are halved first ("cut freely"), as
smaller parts balance better.

Tokenizing is one pass over the texts; only piece lengths and checksums move
on. Chunks between spaces are tokenized once for each Python worker, as the
tokenizer drops white space and no merge crosses it.

Defined cases. A null or empty text has the end id alone. Rows that repeat are
packed as documents of their own. Columns beyond the named ones are ignored.
sequence_id is unique, not dense.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import kept_by_worker, map_texts, materialise

CAPACITY = 2048
END_ID = 1
#: Pieces longer than this are cut in two before they are packed.
CUT = 512
#: Pieces of a bucket, on average.
BUCKET = 1024
#: Distinct chunks remembered by a Python worker, and chunks that it learns with one call.
REMEMBER, LEARN = 600_000, 16_384


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, remembered chunk by chunk."""

    #: str.split() takes these for white space, the tokenizer does not.
    separators = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.seen: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in ".,"}

    #: A point or comma that does not stand behind a letter at a chunk's end, in lower-case Latin-1. It starts with the
    #: marks themselves, so that the search skips all else quickly.
    within = re.compile(r"[.,](?:(?![ \n\t\r]|\Z)|(?<![a-zß-öø-ÿ][.,]))")

    def chunks(self, text: str) -> list[str]:
        """Stretches without white space; of plain texts in lower case, and with the mark that ends a sentence apart."""
        try:
            text.encode("latin-1")  # no letter of these is a combining mark, or becomes several in lower case
        except UnicodeEncodeError:
            pass
        else:
            if "<" not in text:  # as in _plain
                text = text.lower()
                if self.within.search(text) is None:
                    text = text.replace(".", " . ").replace(",", " , ")
        if any(c in text for c in self.separators):
            return [c for c in re.split("[ \n\t\r]+", text) if c]
        return text.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        lists = [self.chunks(t) for t in texts]
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        seen = self.seen
        new = set().union(*lists).difference(seen)
        # chunks that differ in A-Z, or in a point or comma behind a letter, share their ids
        same, words, others = [], set(), set()
        for c in new:
            if c.isascii() and c.isalpha() and c.islower():  # as most are
                words.add(c)
                continue
            k, mark = self._plain(c)
            if k is not c:
                same.append((c, k, mark))
            if k not in seen:
                (words if k.isalpha() else others).add(k)
        for learn, part in ((self._words, list(words)), (self._learn, list(others))):
            for at in range(0, len(part), LEARN):
                learn(part[at : at + LEARN])
        for c, k, mark in same:
            seen[c] = seen[k] + mark
        return [b"".join(map(seen.__getitem__, x)) for x in lists]

    def _plain(self, chunk: str) -> tuple[str, bytes]:
        """A chunk with the same ids up to the mark's, which are given."""
        if "<" in chunk:  # it may be a special token's name, which has its case
            return chunk, b""
        if chunk.isascii() and not chunk.islower():
            chunk = chunk.lower()
        if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isalpha():
            # a letter that ends in a combining mark once normalised makes one token run of the mark and the point
            if chunk.isascii() or self.normalise(chunk[:-1])[-1:].isalpha():
                return chunk[:-1], self.marks[chunk[-1]]
        return chunk, b""

    def _words(self, chunks: list[str]) -> None:
        """Tokenize runs of letters in one call: each is one word to the tokenizer, and its last token alone ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(chunks):
            return self._learn(chunks)
        raw = ids.tobytes()
        self.seen.update((c, raw[a:z]) for c, a, z in zip(chunks, [0, *ends], ends))

    def _learn(self, chunks: list[str]) -> None:
        """Tokenize chunks joined by spaces in one call, and part the ids by where tokens start."""
        e = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        raw = np.array(e.ids, dtype="<u4").tobytes()
        starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        at = (4 * np.searchsorted(np.array([a for a, _ in e.offsets], dtype=np.int64), starts)).tolist()
        self.seen.update((c, raw[a:z]) for c, a, z in zip(chunks, at, at[1:]))


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """k subsets of near-equal sum: indexes of lengths, by Karmarkar-Karp differencing."""
    heap = []
    for i, n in enumerate(lengths):
        # loads ascending, and the pieces of each slot; slots that are still empty are not kept
        heapq.heappush(heap, (-n, i, [n], [[i]]))
    if not heap:
        return [[] for _ in range(k)]
    at = len(lengths)
    while len(heap) > 1:
        _, _, la, pa_ = heapq.heappop(heap)
        _, _, lb, pb = heapq.heappop(heap)
        if len(la) < len(lb):
            la, pa_, lb, pb = lb, pb, la, pa_
        # b's slots, heaviest first, meet a's slots, lightest first; empty slots are a's lightest while it has any
        free = k - len(la)
        loads, parts = list(la), list(pa_)
        take = min(free, len(lb))
        for j in range(take):
            loads.append(lb[-1 - j])
            parts.append(pb[-1 - j])
        for j in range(take, len(lb)):
            loads[j - take] += lb[-1 - j]
            parts[j - take] = parts[j - take] + pb[-1 - j]
        both = sorted(zip(loads, parts), key=itemgetter(0))
        loads, parts = [x for x, _ in both], [x for _, x in both]
        low = loads[0] if len(loads) == k else 0
        heapq.heappush(heap, (low - loads[-1], at, loads, parts))
        at += 1
    return heap[0][3] + [[] for _ in range(k - len(heap[0][3]))]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (indexes of lengths) of at most the capacity, as few as differencing finds."""
    if not lengths:
        return []
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = [w for w in differencing(lengths, k) if w]
        over = max(sum(lengths[i] for i in w) for w in windows)
        if over <= capacity:
            return windows
        k += max(1, k // 400)


def _by_size(tokens: Tokens, texts: pa.Array, most: int = 500_000) -> Iterator[bytes]:
    """Ids of a batch's texts, so many characters at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= most:
            yield from tokens(part)
            part, size = [], 0
    yield from tokens(part)


def _pieces_of(path: str, capacity: int, cut: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker("word_tokens", path, lambda: Tokens(path))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(_by_size(tokens, b.column("text"))):
                n = len(ids) // 4 + 1
                full = n // capacity * capacity
                cuts = list(range(0, full, capacity))
                rest = n - full
                if rest:
                    parts = -(-rest // cut)
                    cuts += [full + rest * p // parts for p in range(parts)]
                ends, view = [*cuts[1:], n], memoryview(ids)
                row += [i] * len(cuts)
                start += cuts
                length += [z - a for a, z in zip(cuts, ends)]
                total += [n] * len(cuts)
                crc += [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(cuts, ends)]
                crc[-1] = zlib.crc32(end, crc[-1])  # the end id stands behind the text's
            ids_ = b.column("doc_id").take(pa.array(row, pa.int64()))
            cols = [ids_, *(pa.array(v, pa.int64()) for v in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack_bucket(capacity: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        length = table.column("length").to_pylist()
        bucket = key[0].as_py()
        seq, offset = [0] * len(length), [0] * len(length)
        at = 0
        for i, n in enumerate(length):
            if n == capacity:
                seq[i], at = at, at + 1
        rest = [i for i, n in enumerate(length) if n < capacity]
        for w in pack([length[i] for i in rest], capacity):
            done = 0
            for j in w:
                seq[rest[j]], offset[rest[j]] = at, done
                done += length[rest[j]]
            at += 1
        seq = [(bucket << 24) + s for s in seq]
        table = table.drop_columns(["bucket"])
        return table.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialise(map_texts(rows, _pieces_of(tokenizer, capacity, cut), schema), "pieces")
    buckets = max(1, pieces.count() // BUCKET)
    # a row's place is spread by its own checksum too, so one hot document id does not share a bucket
    where = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets))
    return pieces.withColumn("bucket", where).groupBy("bucket").applyInArrow(_pack_bucket(capacity), schema + ", sequence_id long, offset long")


def op9(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
