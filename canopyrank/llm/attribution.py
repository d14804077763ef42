"""Token counts of sections by offset-mapped attribution.

Every document is encoded once, whole. The tokens' character spans are then
joined to the sections' spans: both are sorted and do not overlap, so a merge
by bisection does it, within the document's own row. A token that crosses a
boundary is allocated by an explicit rule:

  first     to the section that holds its first character
  majority  to the section that holds most of its characters, the earlier at a tie (default)
  split     to every section it meets, in proportion to the characters there

A token that lies within one character (a part of its bytes) spans that
character. Tokens that meet no section count under section -1.

Defined cases. A null or empty text has no tokens and one row: section -1 with
none. Sections of lines() tile the text, a line's break belongs to it. Rows
that repeat are counted each; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import kept_by_worker, map_texts

RULES = ("first", "majority", "split")
#: Distinct chunks remembered by a Python worker.
REMEMBER = 600_000


class ByteTokens:
    """Begun characters of each token of a text, for byte-level ranks; remembered chunk by chunk.

    No alternative of the pattern crosses from a visible character to white space, so chunks of white space
    and what follows it up to the next white space are encoded alone with the same result.
    """

    chunk = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        most = max(ranks.values()) + 1
        # characters begun by each token: its bytes that do not continue one
        self.begun = np.zeros(most, dtype=np.uint16)
        for b, r in ranks.items():
            self.begun[r] = sum(x & 0xC0 != 0x80 for x in b)
        self.seen: dict[str, bytes] = {}

    def lengths(self, text: str) -> np.ndarray:
        chunks = self.chunk.findall(text)
        seen = self.seen
        try:
            joined = b"".join([seen[c] for c in chunks])
        except KeyError:
            if len(seen) > REMEMBER:
                seen.clear()
            for c in chunks:
                if c not in seen:
                    seen[c] = self.begun[self.encoding.encode_ordinary(c)].tobytes()
            joined = b"".join([seen[c] for c in chunks])
        return np.frombuffer(joined, dtype=np.uint16).astype(np.int64)


def token_spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters; one that begins none spans the character it continues."""
    end = np.cumsum(lengths)
    start = end - lengths
    return np.where(lengths == 0, np.maximum(start - 1, 0), start), np.maximum(end, np.where(lengths == 0, 1, 0))


def lines(text: str) -> list[tuple[int, int]]:
    """Spans of the lines, breaks included."""
    cuts = [m.end() for m in re.finditer("\n", text)]
    edges = [0, *cuts] + ([len(text)] if text and (not cuts or cuts[-1] < len(text)) else [])
    return list(zip(edges, edges[1:]))


def attribute(start: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]], rule: str = "majority") -> tuple[np.ndarray, float]:
    """Tokens of each section, and those of none. Sections are sorted and apart; tokens are sorted."""
    lo = np.array([a for a, _ in sections], dtype=np.int64)
    hi = np.array([b for _, b in sections], dtype=np.int64)
    out = np.zeros(len(sections))
    if not len(start):
        return out, 0.0
    if not len(sections):
        return out, float(len(start))
    first = np.searchsorted(hi, start, side="right")  # the first section that ends behind the token's start
    last = np.searchsorted(lo, end, side="left") - 1  # the last that begins before its end
    meets = first <= last
    one = meets & (first == last)
    if rule == "first":
        inside = meets & (lo[np.minimum(first, len(lo) - 1)] <= start)
        np.add.at(out, first[inside], 1.0)
        return out, float(len(start) - inside.sum())
    np.add.at(out, first[one], 1.0)
    for t in np.flatnonzero(meets & ~one):
        k = np.arange(first[t], last[t] + 1)
        share = np.minimum(hi[k], end[t]) - np.maximum(lo[k], start[t])
        if rule == "split":
            out[k] += share / share.sum()
        else:
            out[k[int(share.argmax())]] += 1.0
    return out, float((~meets).sum())


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[tuple[int, int]]] = lines, rule: str = "majority") -> DataFrame:
    """One row for each section: doc_id, section, start, end, n_tokens, doc_tokens; section -1 where tokens meet none."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker("byte_tokens", (tokenizer, pattern), lambda: ByteTokens(tokenizer, pattern))
        for b in batches:
            at, no, lo, hi, n, total = [], [], [], [], [], []
            for i, t in enumerate(b.column("text")):
                text = t.as_py() or ""
                length = tokens.lengths(text)
                cut = sections(text)
                got, none = attribute(*token_spans(length), cut, rule)
                if none or not cut:
                    cut, got = [(None, None), *cut], [none, *got]
                    numbers = range(-1, len(cut) - 1)
                else:
                    numbers = range(len(cut))
                at += [i] * len(cut)
                no += numbers
                lo += [a for a, _ in cut]
                hi += [z for _, z in cut]
                n += [float(x) for x in got]
                total += [len(length)] * len(cut)
            ids = b.column("doc_id").take(pa.array(at, pa.int64()))
            cols = [ids, *(pa.array(v, pa.int64()) for v in (no, lo, hi)), pa.array(n, pa.float64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, section long, start long, end long, n_tokens double, doc_tokens long")


def op1(spark, sf_dir) -> DataFrame:
    import public_tokenizers as tk

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tk.path("byte_bpe_50k.tiktoken"), tk.PATTERN)
