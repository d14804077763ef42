"""Ratings from pairwise outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyrank.storage import TASK_ROWS

BETA, DRAW, MU, SIGMA = 25.0 / 6, 0.1, 25.0, 25.0 / 3
GLOBAL_SHARE = 0.3


def bradley_terry(wins: np.ndarray, ties: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Scores (mean zero) and standard errors from a wins matrix and a symmetric ties matrix.

    All rounds are run. Who has no wins keeps the score, and is centred with the others.
    """
    w = wins + ties / 2
    n = w + w.T
    total = w.sum(axis=1)
    s = np.zeros(len(w))
    for _ in range(rounds):
        e = np.exp(s)
        down = (n / (e[:, None] + e[None, :])).sum(axis=1)
        ok = (total > 0) & (down > 0)
        s = np.where(ok, np.log(np.where(ok, total, 1) / np.where(ok, down, 1)), s)
        s -= s.mean()
    p = 1 / (1 + np.exp(s[None, :] - s[:, None]))
    info = n * p * (1 - p)
    k = len(s)
    fisher = np.diag(info.sum(axis=1)) - info
    try:
        var = np.diag(np.linalg.inv(fisher + 1.0)) - 1 / k**2
    except np.linalg.LinAlgError:
        var = 1 / np.maximum(info.sum(axis=1), 1e-9)
    return s, np.maximum(np.sqrt(np.maximum(var, 0)), 0.01)


def fit_pairs(stats: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """Fit every key's pair statistics (a, b, wins_a, wins_b, ties): key, model, score, se. A group has a row for each pair of models."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        models = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {m: i for i, m in enumerate(models)}
        w, t = np.zeros((len(models),) * 2), np.zeros((len(models),) * 2)
        for a, b, x, y, z in zip(pdf["a"].map(at), pdf["b"].map(at), pdf["wins_a"], pdf["wins_b"], pdf["ties"]):
            w[a, b] += x
            w[b, a] += y
            t[a, b] += z
            t[b, a] += z
        s, se = bradley_terry(w, t, rounds)
        return pd.DataFrame({key: pdf[key].iloc[0], "model": models, "score": s, "se": se})

    return stats.groupBy(key).applyInPandas(run, f"{key} {dict(stats.dtypes)[key]}, model string, score double, se double")


def convergence_debt(stats: DataFrame, key: str, budget: int) -> DataFrame:
    """For every key: pairs of its models, and debt, those of them that still need matches.

    A pair that has used its budget needs none; one met less than twice does; any other while its scores differ by less
    than three times the sum of their standard errors. stats has one row for a pair, a < b, with its number of matches n.
    """
    fit = fit_pairs(stats, key).select(key, "model", "score", "se")
    side = lambda m, s, e: fit.select(key, F.col("model").alias(m), F.col("score").alias(s), F.col("se").alias(e))
    pairs = side("a", "sa", "ea").join(side("b", "sb", "eb"), key).filter("a < b").join(stats.select(key, "a", "b", "n"), [key, "a", "b"], "left")
    n = F.coalesce("n", F.lit(0))
    near = F.abs(F.col("sa") - F.col("sb")) < 3 * (F.col("ea") + F.col("eb"))
    return pairs.groupBy(key).agg(F.count("*").alias("pairs"), F.count_if((n < budget) & ((n < 2) | near)).alias("debt"))


def target_nodes(stats: DataFrame, leaves: DataFrame, key: str, budget: int, least_queries: int, most: int = 100) -> DataFrame:
    """The leaves to compare in next, up to `most`: key, fresh, debt, mean_se, queries, place.

    leaves: key and queries; stats as for convergence_debt(). A leaf needs so many queries and a pair that still needs
    matches, pairs with a model that the leaf has not seen included. Those without a match come first, then the most
    debt, the largest mean standard error (10 without a fit), the most queries, and the first key.
    """
    models = F.broadcast(stats.select(F.explode(F.array("a", "b")).alias("m")).agg(F.countDistinct("m").alias("models")))
    se = fit_pairs(stats, key).groupBy(key).agg(F.avg("se").alias("mean_se"))
    known = convergence_debt(stats, key, budget).join(se, key).join(stats.groupBy(key).agg(F.sum("n").alias("n")), key)
    j = leaves.filter(F.col("queries") >= least_queries).join(known, key, "left").join(models)
    unseen = (F.col("models") * (F.col("models") - 1) / 2).cast("long") - F.coalesce("pairs", F.lit(0))
    rows = j.select(key, (F.coalesce("n", F.lit(0)) == 0).alias("fresh"), (F.coalesce("debt", F.lit(0)) + unseen).alias("debt"), F.coalesce("mean_se", F.lit(10.0)).alias("mean_se"), "queries").filter("debt > 0")
    first = rows.orderBy(F.desc("fresh"), F.desc("debt"), F.desc(F.round("mean_se", 9)), F.desc("queries"), key).limit(most)
    # as many rows as are asked for
    order = Window.orderBy(F.desc("fresh"), F.desc("debt"), F.desc(F.round("mean_se", 9)), F.desc("queries"), key)
    return first.withColumn("place", F.row_number().over(order).cast("long"))


def _phi(x: float) -> float:
    return float(np.exp(-x * x / 2) / np.sqrt(2 * np.pi))


def _cdf(x: float) -> float:
    from math import erf, sqrt

    return 0.5 * (1 + erf(x / sqrt(2)))


def rate(a: tuple[float, float], b: tuple[float, float], outcome: float, weight: float = 1.0) -> tuple[tuple[float, float], tuple[float, float]]:
    """Ratings (mu, sigma) after a match; outcome 1 for a, -1 for b, 0 for a tie; weight blends old and new."""
    if outcome < 0:
        y, x = rate(b, a, 1.0, weight)
        return x, y
    c = float(np.sqrt(2 * BETA**2 + a[1] ** 2 + b[1] ** 2))
    t, e = (a[0] - b[0]) / c, DRAW / c
    if outcome > 0:
        d = max(_cdf(t - e), 1e-12)
        v = _phi(t - e) / d
        w = v * (v + t - e)
    else:
        d = max(_cdf(e - t) - _cdf(-e - t), 1e-12)
        v = (_phi(-e - t) - _phi(e - t)) / d
        w = v * v + ((e - t) * _phi(e - t) + (e + t) * _phi(e + t)) / d

    def new(r, sign):
        mu = r[0] + sign * r[1] ** 2 / c * v
        sigma = float(np.sqrt(max(r[1] ** 2 * (1 - r[1] ** 2 / c**2 * w), 1e-4)))
        return r[0] + weight * (mu - r[0]), r[1] + weight * (sigma - r[1])

    return new(a, 1), new(b, -1)


def rate_log(rows: Iterator[tuple], state: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[float, float]]:
    """Apply matches (a, b, outcome), or (a, b, outcome, confidence), in order."""
    state = dict(state or {})
    for a, b, outcome, *weight in rows:
        ra, rb = state.get(a, (MU, SIGMA)), state.get(b, (MU, SIGMA))
        state[a], state[b] = rate(ra, rb, outcome, *weight)
    return state


def with_anchor(matches: DataFrame) -> DataFrame:
    """domain, ts, event_id, a, b, outcome, conf: each match, and once more for the domain global with a share of its confidence."""
    conf = F.col("conf") if "conf" in matches.columns else F.lit(1.0)
    one = lambda d, c: F.struct(d.alias("domain"), c.alias("conf"))
    own, anchor = one(F.col("domain"), conf), one(F.lit("global"), conf * GLOBAL_SHARE)
    rows = matches.select("ts", "event_id", "a", "b", (F.col("wa") - F.col("wb")).alias("outcome"), F.explode(F.when(F.col("domain") == "global", F.array(own)).otherwise(F.array(own, anchor))).alias("x"))
    return rows.select("x.domain", "ts", "event_id", "a", "b", "outcome", "x.conf")


#: Columns of a log that are packed.
PACKED = ("a", "b", "outcome", "conf")


def packed(log: DataFrame) -> DataFrame:
    """A log in order of (domain, ts, event_id), a batch of a domain's matches to a row: domain, ts and event_id of the first, chunk (its place in the partition), log (Arrow, each column by its distinct values, compressed)."""
    parts = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), log.count() // TASK_ROWS + 1)
    order = ("domain", "ts", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        for b in batches:
            domain = b.column("domain")
            ends = [*(np.flatnonzero(pc.not_equal(domain[1:], domain[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(b)]
            for lo, hi in zip([0, *ends], ends):
                if hi > lo:
                    rows = pa.table({c: b.column(c).slice(lo, hi - lo).dictionary_encode() for c in PACKED})
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(rows)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, 1) for c in order), pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*order, "chunk", "log"])
                    chunk += 1

    kinds = dict(log.dtypes)
    rows = log.filter("domain IS NOT NULL").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in order) + ", chunk long, log binary")


def ratings(matches: DataFrame) -> DataFrame:
    """Ratings by domain after all matches in order of (ts, event_id): domain, agent, mu, sigma, ordinal.

    Matches may have a column conf, which moves the ratings by that share only. Each match also counts for the domain
    global, with GLOBAL_SHARE of its confidence. The update depends on order, so one task goes through a domain's
    log; it is sorted and packed by many tasks before, and unpacked there a batch at a time.
    """
    def rows(domain, state):
        return pd.DataFrame([(domain, k, *state[k]) for k in sorted(state)], columns=["domain", "agent", "mu", "sigma"])

    def column(table: pa.Table, name: str) -> list:
        part = table.column(name).combine_chunks()
        values = part.dictionary.to_pylist()
        return [None if k is None else values[k] for k in part.indices.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain, state = None, {}
        for batch in batches:
            for key, log in zip(batch.column("domain"), batch.column("log")):
                if key.as_py() != domain and state:
                    yield pa.RecordBatch.from_pandas(rows(domain, state), preserve_index=False)
                    state = {}
                domain = key.as_py()
                part = pa.ipc.open_stream(log.as_buffer()).read_all()
                state = rate_log(zip(*(column(part, c) for c in PACKED)), state)
        if state:
            yield pa.RecordBatch.from_pandas(rows(domain, state), preserve_index=False)

    # by number: packed rows are so small that domains would be put into one task otherwise
    log = packed(with_anchor(matches)).repartition(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "domain").sortWithinPartitions("domain", "ts", "event_id", "chunk").select("domain", "log")
    got = log.mapInArrow(run, "domain string, agent string, mu double, sigma double")
    return got.withColumn("ordinal", F.col("mu") - 2 * F.col("sigma"))


#: Numbers drawn at once by a permutation test; the draws do not depend on it.
SWAPS = 1 << 20


#: Tasks that share out the rounds of a group's permutation test.
SHARES = 8


def _runs(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the last key first, and where a new combination of keys starts there."""
    order = np.lexsort(by)
    new = np.any([k[order][1:] != k[order][:-1] for k in by], axis=0)
    return order, np.concatenate([[0], np.flatnonzero(new) + 1])


def permutation_hits(truth: np.ndarray, one: np.ndarray, two: np.ndarray, rounds: int, seed: int = 42, first: int = 0) -> tuple[float, int]:
    """Difference of two scores' rank correlations with the truth, and how many of so many swaps within items, from the first on, give one as large.

    Items with equal truth and scores are a cell: how many of them are swapped tells the ranks, so what is drawn for
    each item is summed by cell, and a round costs a few steps for each cell.
    """
    n = len(truth)
    missing, one, two = np.isnan(truth).any(), np.asarray(one, dtype=float), np.asarray(two, dtype=float)
    lost1, lost2 = np.isnan(one), np.isnan(two)
    order, start = _runs(*(np.nan_to_num(v, nan=np.inf) for v in (two, one, truth)))
    sorted_ = bool((order == np.arange(n)).all())
    size = np.diff(np.append(start, n)).astype(float)
    at = order[start]
    t = pd.Series(truth).rank().to_numpy()[at]
    t = t - (n + 1) / 2
    values, place = np.unique(np.nan_to_num(np.concatenate([one[at], two[at]]), nan=np.inf), return_inverse=True)
    p1, p2 = place[: len(at)], place[len(at) :]
    (o1, s1), (o2, s2) = _runs(p1), _runs(p2)
    lost1, lost2 = lost1[at], lost2[at]
    tt = float((size * t) @ t)

    def rho(a: np.ndarray) -> np.ndarray:
        """Rank correlations where a of each cell's items show the first score, the others the second."""
        b = size - a
        count = np.zeros((len(a), len(values)))
        count[:, p1[o1][s1]] += np.add.reduceat(a[:, o1], s1, axis=1)
        count[:, p2[o2][s2]] += np.add.reduceat(b[:, o2], s2, axis=1)
        r = np.cumsum(count, axis=1) - count + (count + 1) / 2 - (n + 1) / 2
        scale = np.sqrt((count * r * r).sum(axis=1) * tt)
        whole = (scale > 0) & ~missing & (a[:, lost1].sum(axis=1) + b[:, lost2].sum(axis=1) == 0)
        return np.where(whole, ((a * r[:, p1] + b * r[:, p2]) @ t) / np.where(scale > 0, scale, 1), 0.0)

    base = float((rho(size[None]) - rho(0 * size[None]))[0])
    random, block, hits = np.random.default_rng(seed), max(1, SWAPS // max(1, n)), 0
    random.bit_generator.advance(first * n)  # a number for each item and round
    for done in range(0, rounds, block):
        swap = (random.random((min(block, rounds - done), n)) < 0.5).view(np.uint8)
        a = np.add.reduceat(swap if sorted_ else swap[:, order], start, axis=1, dtype=np.int32).astype(float)
        # swapped sums differ in the last bit
        hits += int((np.abs(rho(a) - rho(size - a)) >= abs(base) - 1e-12).sum())
    return base, hits


def permutation_p(truth: np.ndarray, one: np.ndarray, two: np.ndarray, rounds: int = 10000, seed: int = 42) -> tuple[float, float]:
    """Difference of two scores' rank correlations with the truth, and how often swaps within items give one as large."""
    base, hits = permutation_hits(truth, one, two, rounds, seed)
    return base, hits / rounds


def permutation_test(items: DataFrame, key: str, truth: str, one: str, two: str, rounds: int = 10000) -> DataFrame:
    """permutation_p of every key: key, delta, p. A group's rounds are shared out; a task holds how often each combination of values occurs in the group."""
    kind = dict(items.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([truth, one, two])
        share = int(pdf["share"].iloc[0])
        first, last = rounds * share // SHARES, rounds * (share + 1) // SHARES
        cells = [np.repeat(pdf[c].to_numpy(dtype=float), pdf["count"]) for c in (truth, one, two)]
        d, hits = permutation_hits(*cells, last - first, first=first)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "delta": [d], "hits": [hits]})

    counts = items.groupBy(key, truth, one, two).count().withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    # as many groups as there are keys and shares: more partitions, so that few of them meet in one task
    got = counts.repartition(4 * SHARES * 4, key, "share").groupBy(key, "share").applyInPandas(run, f"{key} {kind}, delta double, hits long")
    return got.groupBy(key).agg(F.first("delta").alias("delta"), (F.sum("hits") / rounds).alias("p"))
