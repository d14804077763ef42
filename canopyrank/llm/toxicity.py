"""Toxicity by a logistic model that is held still under swaps of identity terms.

Features are the words of a text and their stems of four to six characters,
taken as present or absent, so that neither length nor repetition counts. The
most telling features of a bounded labelled sample are kept. For every
labelled text that mentions a group, copies with the mention swapped for other
groups' are scored too, and the squared difference of the log-odds is added to
the loss: a mention alone cannot raise the score.

Defined cases. A null or empty text has no feature and gets the model's
intercept. Labels of null, and labels without a text, are not learnt from;
rows that repeat are scored each. If no label of both kinds can be learnt
from, every score is the share of toxic labels, or 0 without any. Columns
beyond the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import map_texts

#: Labelled rows that the model is fitted on at most, the first by the hash of their id.
SAMPLE = 6_000
#: Features seen in fewer texts than this are not kept.
LEAST_TEXTS = 4
FEATURES = 4_000
THRESHOLD = 0.7
#: Weights of the squared weights and of the squared change under a swap.
RIDGE, SWAP = 2e-5, 1.0
STEPS, RATE = 400, 0.1
WORD = re.compile(r"[^\W\d_]+")
# Group terms that may be exchanged for one another within a row.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("musulman", "chrétien", "juif"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def features(word: str) -> list[str]:
    """A lower-case word and its stems."""
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swaps(words: set[str]) -> list[set[str]]:
    """The text's word set with each mentioned group exchanged for every other of its row."""
    out = []
    for row in IDENTITY:
        for term in row:
            if term in words:
                out += [(words - {term}) | {other} for other in row if other != term]
    return out


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[str | None], float]:
        """Score a text; what each distinct word adds is looked up once for each task."""
        known: dict[str, tuple[str, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            found: set[str] = set()
            for w in words_of(text):
                f = known.get(w)
                if f is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    f = known[w] = tuple(x for x in features(w) if x in weights)
                if f:
                    found.update(f)
            z = bias + sum(weights[f] for f in sorted(found))
            return 1 / (1 + float(np.exp(-min(max(z, -500.0), 500.0))))

        return score


class _Vocabulary:
    """Numbers for features; a word's are worked out once."""

    def __init__(self):
        self.names: list[str] = []
        self.index: dict[str, int] = {}
        self.of_word: dict[str, np.ndarray] = {}

    def _number(self, f: str) -> int:
        k = self.index.get(f)
        if k is None:
            k = self.index[f] = len(self.names)
            self.names.append(f)
        return k

    def ids(self, words: set[str]) -> np.ndarray:
        parts = []
        for w in sorted(words):
            x = self.of_word.get(w)
            if x is None:
                x = self.of_word[w] = np.array([self._number(f) for f in features(w)], dtype=np.int32)
            parts.append(x)
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


def fit(texts: list[str], labels: list[int], swap: float = SWAP) -> Model:
    """Fit the model on labelled texts."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(bias=float(np.log((p + 1e-9) / (1 - p + 1e-9))))
    vocabulary = _Vocabulary()
    rows = [vocabulary.ids(words_of(t)) for t in texts]
    n, n1 = len(y), float(y.sum())
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=len(vocabulary.names)).astype(float)
    toxic = np.bincount(np.concatenate([*(x for x, label in zip(rows, labels) if label), np.zeros(0, np.int64)]), minlength=len(seen)).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        # chi-square of feature and label
        gain = n * (toxic * (n - n1 - seen + toxic) - (seen - toxic) * (n1 - toxic)) ** 2 / (seen * (n - seen) * n1 * (n - n1))
    gain = np.nan_to_num(gain, posinf=0.0)
    groups = {t for row in IDENTITY for t in row}
    some = [k for k in np.flatnonzero(seen >= LEAST_TEXTS) if gain[k] > 6.6 or vocabulary.names[k] in groups]
    kept = sorted(some, key=lambda k: (-gain[k], vocabulary.names[k]))[:FEATURES]
    place = np.full(len(seen), -1)
    place[kept] = np.arange(len(kept))

    def matrix(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [place[x[x < len(place)]] for x in of]
        at = [x[x >= 0] for x in at]
        return np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)

    r, c = matrix(rows)
    pairs = [(i, vocabulary.ids(other)) for i, t in enumerate(texts) for other in swaps(words_of(t))]
    pr, pc = matrix([p for _, p in pairs])
    of = np.array([i for i, _ in pairs], dtype=np.int64)
    w, bias = np.zeros(len(kept)), float(np.log(n1 / (n - n1)))
    # Adam on the whole sample: deterministic, and free of a step size to tune
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(r, w[c], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.bincount(c, e[r], minlength=len(kept)) + RIDGE * w
        gb = e.sum()
        if len(pairs):
            d = (np.bincount(pr, w[pc], minlength=len(pairs)) - (z - bias)[of]) * 2 * swap / len(pairs)
            back = np.bincount(of, d, minlength=n)
            g += np.bincount(pc, d[pr], minlength=len(kept)) - np.bincount(c, back[r], minlength=len(kept))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = RATE / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        bias -= scale * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-10)
    return Model(bias=float(bias), weights={vocabulary.names[k]: float(x) for k, x in zip(kept, w) if abs(x) > 1e-4})


def held_out(c) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most the sample's number of labelled documents outside the held-out third."""
    ok = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    picked = ok.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # as many rows as the sample has, whatever the tables' size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").orderBy("id", "text").limit(2 * sample)
    got = rows.toArrow().to_pylist()
    return fit([r["text"] or "" for r in got], [int(r["y"] > 0) for r in got])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            s = [of(t.as_py()) for t in b.column("text")]
            p = pa.array([int(x >= threshold) for x in s], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), p], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op5(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
