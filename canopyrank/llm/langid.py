"""Language identification: script ranges, word scores and Viterbi spans.

Training counts words and character trigrams for each language. A word's score
for a language is its smoothed log-probability there; words not learnt fall
back on their trigrams. The script of a word's letters narrows the candidates:
only languages that use the script in training compete. Viterbi over the word
scores, with a penalty for each switch, labels spans; a document's language is
the one that labels most letters.

Most texts are in one language, and for these the best path is known without a
search: where no stretch of words gains more than a switch costs by leaving
the leading language, the path that never leaves it is optimal.

Defined cases. Null, empty and letterless texts are und with score 0; numerals of any kind are no letters. A text
whose words give no evidence for any candidate gets the commonest language of
training, with score 0. Where one language alone was learnt, the score is the
share of letters in its scripts. Without training rows every text is und. Ties go to the language
that sorts first. Rows that repeat are labelled each; columns beyond the named
ones are ignored. A text is held by its own row only, so very long ones need
no cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import map_texts, nothing_kept

#: Documents that the model is fitted on at most, the first by the hash of their id.
SAMPLE = 6_000
#: Words kept for each language at most, and the least count of a word.
WORDS, LEAST_COUNT = 60_000, 3
PENALTY = 12.0
#: Bounds of a single word's evidence, in nats.
CLIP = 8.0
#: Languages that use a script for less than this share of its training words are no candidates for it.
SCRIPT_SHARE = 0.001
UND = "und"
#: Characters that count for \w and are neither letters nor decimal digits: fractions, superscripts, Roman and circled numerals.
_NUMERALS = "".join(x for x in map(chr, range(0x110000)) if x.isalnum() and not x.isalpha() and not x.isdecimal())
#: Stretches of letters, and a quick pattern that takes such numerals for letters too.
LETTERS, _QUICK = re.compile(rf"[^\W\d_{_NUMERALS}]+"), re.compile(r"[^\W\d_]+")
# First code points of script ranges, each up to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1D00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2D00, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_STARTS, _NAMES = [a for a, _ in SCRIPTS], [n for _, n in SCRIPTS]


def script(word: str) -> str:
    """The script of most of a word's letters, the first of them at a tie."""
    if word.isascii():
        return "latin"
    c = Counter(_NAMES[bisect_right(_STARTS, ord(x)) - 1] for x in word)
    return max(c, key=c.__getitem__)


def words_of(text: str) -> list[str]:
    """The stretches of letters."""
    found = _QUICK.findall(text)
    return found if all(map(str.isalpha, found)) else LETTERS.findall(text)


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def held_out(c: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_table: np.ndarray
    gram_table: np.ndarray  # its last row is for trigrams not seen
    scripts: dict[str, np.ndarray]
    common: int

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: log-probabilities by language, relative to the best candidate's, bounded by CLIP."""
        n = len(self.languages)
        unseen = len(self.gram_table) - 1
        kinds = [script(w) for w in words]
        lists = [[self.grams.get(g, unseen) for g in grams(w)] for w in words]
        s = np.add.reduceat(self.gram_table[[g for x in lists for g in x]], np.cumsum([0, *(len(x) for x in lists[:-1])]), axis=0)
        at = np.array([self.words.get(w, -1) for w in words])
        s[at >= 0] = self.word_table[at[at >= 0]]
        none = np.zeros(n, dtype=bool)
        may = np.array([self.scripts.get(k, none) for k in kinds])
        s = np.where(may, s, -np.inf)
        top = s.max(axis=1, keepdims=True, initial=-np.inf)
        return np.where(may.any(axis=1, keepdims=True), np.clip(s - np.where(np.isfinite(top), top, 0.0), -CLIP, 0.0), 0.0)


def fit(texts: list[str], labels: list[str]) -> Model:
    """Count words and trigrams by language."""
    languages = sorted(set(labels))
    n = len(languages)
    if not n:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)), {}, 0)
    word, tri = [Counter() for _ in languages], [Counter() for _ in languages]
    use: dict[str, np.ndarray] = {}
    docs = Counter(labels)
    for t, label in zip(texts, labels):
        word[languages.index(label)].update(words_of((t or "").lower()))
    for k, c in enumerate(word):
        for w, m in c.items():
            use.setdefault(script(w), np.zeros(n))[k] += m
            for g in grams(w):
                tri[k][g] += m

    def table(counts: list[Counter], keep: list[str]) -> np.ndarray:
        totals = np.array([sum(c.values()) + 0.5 * len(keep) + 1.0 for c in counts])
        return np.log((np.array([[c[x] for c in counts] for x in [*keep, ""]]).reshape(-1, n) + 0.5) / totals)

    known = sorted({w for c in word for w, m in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:WORDS] if m >= LEAST_COUNT})
    known_grams = sorted({g for c in tri for g in c})
    share = {s: v >= SCRIPT_SHARE * v.sum() for s, v in use.items()}
    return Model(
        languages, {w: k for k, w in enumerate(known)}, {g: k for k, g in enumerate(known_grams)}, table(word, known), table(tri, known_grams),
        share, languages.index(min(docs, key=lambda x: (-docs[x], x))),
    )


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of every word, with a penalty for each switch; ties go to the first language."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    lead = int(total.argmax())
    if n == 0 or k == 1:
        return np.full(n, lead)
    # any stay in other languages costs a switch at least; what it can gain is a stretch's sum of best rival less leader
    rival = np.delete(scores, lead, axis=1).max(axis=1) - scores[:, lead]
    run = np.concatenate([[0.0], np.cumsum(rival)])
    if (run - np.minimum.accumulate(run)).max() <= penalty:
        return np.full(n, lead)
    best, back = scores[0].copy(), np.zeros((n, k), dtype=np.int8 if k < 128 else np.int32)
    stay = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        move = best[top] - penalty > best
        back[i] = np.where(move, top, stay)
        best = np.where(move, best[top] - penalty, best) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class Labeller:
    """Applies a model to texts; each distinct word is scored once for each task."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 12, max(1, len(model.languages))))

    def scores(self, words: list[str]) -> np.ndarray:
        index = self.index
        try:
            return self.table[[index[w] for w in words]]
        except KeyError:
            pass
        if len(index) > 400_000:
            index.clear()
        new = [w for w in dict.fromkeys(words) if w not in index]
        while len(index) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[len(index) : len(index) + len(new)] = self.model.word_scores(new)
        for w in new:
            index[w] = len(index)
        return self.table[[index[w] for w in words]]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the stretches of words in one language; code points, end exclusive."""
        found = list(LETTERS.finditer(text or ""))
        if not found or not self.model.languages:
            return []
        path = viterbi(self.scores([m[0].lower() for m in found]), self.penalty)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(found)]
        return [(found[a].start(), found[z - 1].end(), self.model.languages[path[a]]) for a, z in zip(cuts, cuts[1:])]

    def label(self, text: str | None) -> tuple[str, float]:
        """The language that labels most letters, and how sure: its share of letters times its evidence's."""
        words = words_of(text.lower()) if text else []
        m = self.model
        if not words or not m.languages:
            return UND, 0.0
        if len(m.languages) == 1:  # nothing competes: what counts is the letters in a script that it uses
            used = sum(len(w) for w in words if script(w) in m.scripts and m.scripts[script(w)][0])
            return m.languages[0], used / sum(map(len, words))
        s = self.scores(words)
        path = viterbi(s, self.penalty)
        size = np.array([len(w) for w in words], dtype=np.float64)
        letters = np.bincount(path, size, minlength=len(m.languages))
        if not s.any():
            return m.languages[m.common], 0.0
        k = int(letters.argmax())
        own = s[path == k].sum(axis=0)
        rest = np.delete(own, k)
        margin = (own[k] - rest.max()) if len(rest) else 50.0
        return m.languages[k], float(letters[k] / letters.sum() / (1 + np.exp(-min(max(margin, -50.0), 50.0))))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most the sample's number of labelled documents outside the held-out quarter."""
    ok = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    ids = docs.filter(ok).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    rows = docs.filter(ok).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "id")
    got = rows.orderBy("id", "text", "lang").limit(2 * sample).toArrow()
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        of = Labeller(model, penalty)
        for b in batches:
            got = [of.label(t.as_py()) for t in b.column("text")]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row for each stretch of words in one language: doc_id, start, end, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        of = Labeller(model, penalty)
        for b in batches:
            got = [(i, *x) for i, t in enumerate(b.column("text")) for x in of.spans(t.as_py())]
            ids = b.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
            cols = [ids, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "lang"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, end long, lang string")


def accept(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str | None = None, least_score: float = 0.0, penalty: float = PENALTY) -> DataFrame:
    """The rows whose text has a language, with a score of least_score at least; all columns stay.

    lang_col: a column of strings whose nulls are filled with the language found.
    """
    at = docs.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        of = Labeller(model, penalty)
        for b in batches:
            got = [of.label(t.as_py()) for t in b.column(text_col)]
            if at is not None:
                known = [x.as_py() for x in b.column(at)]
                b = b.set_column(at, b.schema.field(at), pa.array([g[0] if x is None else x for x, g in zip(known, got)], b.column(at).type))
            yield b.filter(pa.array([lang != UND and s >= least_score for lang, s in got], pa.bool_()))

    return map_texts(docs, run, docs.schema)


def op10(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
