"""Leaderboards over sets of leaves, with standard errors from resampled queries.

A query's replicate weights are drawn by hash from its id, so every match of a
query carries the same weights wherever it is read. Matches are met once: for
each leaf and pair of models the map side sums the points of the plain log and
of all replicates side by side. What is left has a row for each leaf and pair,
and eligibility, consistency, pooling and fits are worked out on that.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.storage import materialise

REPLICATES, SEED = 50, 42
#: Matches that a leaf needs, and checks after which a pair of models can show its judge to be inconsistent.
LEAST = 5
#: What a match adds to both sides of a replicate, so that no replicate falls apart into groups that never met.
PRIOR = 1e-4
ROUNDS, REPLICATE_ROUNDS = 200, 100
SE_BOUNDS = (1e-3, 10.0)
RELIABLE = 0.3
#: Hexadecimal digits of a draw.
DIGITS = 4


def poisson_bounds() -> list[int]:
    """Where a draw of so many digits passes to the next weight: 16 ** DIGITS times the distribution function of Poisson(1)."""
    total, out, k = 0.0, [], 0
    while True:
        total += exp(-1) / factorial(k)
        at = int(16**DIGITS * total)
        if at >= 16**DIGITS - 1:
            return out
        out.append(at)
        k += 1


def replicate_weights(query: Column, replicates: int = REPLICATES, seed: int = SEED) -> Column:
    """A query's weight in each replicate: Poisson(1), the limit of drawing as many queries with replacement. 0 for a null or negative id."""
    each = 32 // DIGITS
    blocks = F.array(*[F.md5(F.concat(F.lit(f"{seed}:"), query.cast("string"), F.lit(f":{k}"))) for k in range(-(-replicates // each))])
    draws = F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.conv(F.substring(h, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("int"))))
    weight = lambda u: sum((F.when(u >= b, 1).otherwise(0) for b in poisson_bounds()), F.lit(0))
    return F.when(query >= 0, F.transform(F.slice(draws, 1, replicates), weight)).otherwise(F.array_repeat(F.lit(0), replicates))


def leaf_pairs(matches: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """leaf, a, b (a < b): n, checks, agreed, wins_a, wins_b and arrays rep_a, rep_b of a number for each replicate.

    matches: leaf, query_id, a, b, wa, wb, tie, checked, agreed. A tie is a point for each side: half as a win and half
    as a tie, as pair statistics hold both.
    """
    fwd = F.col("a") < F.col("b")
    side = lambda x, y: F.when(fwd, F.col(x)).otherwise(F.col(y)) + F.col("tie")
    rows = matches.select("leaf", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), side("wa", "wb").alias("pa"), side("wb", "wa").alias("pb"), "checked", "agreed", replicate_weights(F.col("query_id"), replicates, seed).alias("w"))
    drawn = lambda p: [F.sum(F.get("w", F.lit(r)) * (F.col(p) + PRIOR)) for r in range(replicates)]
    return rows.groupBy("leaf", "a", "b").agg(
        F.count("*").alias("n"), F.sum(F.col("checked").cast("int")).alias("checks"), F.sum((F.col("checked") & F.col("agreed")).cast("int")).alias("agreed"),
        F.sum("pa").alias("wins_a"), F.sum("pb").alias("wins_b"), F.array(*drawn("pa")).alias("rep_a"), F.array(*drawn("pb")).alias("rep_b"))


def fit_many(wins: np.ndarray, rounds: int) -> np.ndarray:
    """Bradley-Terry scores (mean zero) for a stack of wins matrices: a row each. Who has no wins keeps the score."""
    n = wins + wins.transpose(0, 2, 1)
    n[:, np.arange(n.shape[1]), np.arange(n.shape[1])] = 0
    total, s = wins.sum(axis=2), np.zeros(wins.shape[:2])
    for _ in range(rounds):
        e = np.exp(s)
        down = (n / (e[:, :, None] + e[:, None, :])).sum(axis=2)
        ok = (total > 0) & (down > 0)
        s = np.where(ok, np.log(np.where(ok, total, 1) / np.where(ok, down, 1)), s)
        s -= s.mean(axis=1, keepdims=True)
    return s


def pooled_leaderboard(pairs: DataFrame, leaves: DataFrame, least: int = LEAST) -> DataFrame:
    """A leaderboard for every group of leaves: group, model, score, se, low, high, rank, leaves, eligible, comparisons, reliable.

    pairs: leaf_pairs(); leaves: group, leaf, once each. A leaf with at least so many matches is eligible. If a pair
    of its models was checked as often and agreed in under half, its judge is inconsistent: its models stay on the
    board, its matches go. The interval is two standard errors to either side; a group without any replicate
    weight has a standard error of one. A group is reliable with three tenths of its leaves eligible. Groups without
    an eligible leaf have no rows. A group's fit holds a row for each pair of its models.
    """
    pairs = materialise(pairs, "leaf_pairs")  # read twice, and small
    models = F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))
    torn = F.max(((F.col("checks") >= least) & (F.col("agreed") / F.col("checks") < 0.5)).cast("int"))
    leaf = pairs.groupBy("leaf").agg(F.sum("n").alias("comparisons"), torn.alias("torn"), models.alias("models"))
    seen = leaves.join(leaf, "leaf", "left").withColumn("ok", F.coalesce(F.col("comparisons") >= least, F.lit(False)))
    counts = seen.groupBy("group").agg(F.count("*").alias("leaves"), F.sum(F.col("ok").cast("int")).cast("long").alias("eligible"), F.sum(F.when(F.col("ok"), F.col("comparisons")).otherwise(0)).alias("comparisons"))
    known = seen.filter("ok").select("group", F.explode("models").alias("model")).groupBy("group").agg(F.array_sort(F.collect_set("model")).alias("models"))
    used = seen.filter("ok AND torn = 0").select("group", "leaf").join(pairs, "leaf")
    size = F.size("rep_a")
    many = used.select("group", "a", "b", F.posexplode(F.arrays_zip(F.concat(F.array("wins_a"), "rep_a").alias("x"), F.concat(F.array("wins_b"), "rep_b").alias("y"))).alias("r", "p"), size.alias("k"))
    sums = many.groupBy("group", "a", "b", "r").agg(F.sum("p.x").alias("x"), F.sum("p.y").alias("y"), F.max("k").alias("k"))
    rows = known.join(sums, "group", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(pdf["models"].iloc[0])
        at = {m: i for i, m in enumerate(names)}
        k = 0 if pdf["k"].isna().all() else int(pdf["k"].max())
        w = np.zeros((k + 1, len(names), len(names)))
        for a, b, r, x, y in pdf[["a", "b", "r", "x", "y"]].dropna().itertuples(index=False):
            w[int(r), at[a], at[b]] += x
            w[int(r), at[b], at[a]] += y
        score = fit_many(w[:1], ROUNDS)[0]
        drawn = fit_many(w[1:], REPLICATE_ROUNDS) if k > 1 and w[1:].any() else None
        se = np.clip(drawn.std(axis=0, ddof=1), *SE_BOUNDS) if drawn is not None else np.ones(len(names))
        return pd.DataFrame({"group": pdf["group"].iloc[0], "model": names, "score": score, "se": se})

    fit = rows.groupBy("group").applyInPandas(run, f"group {dict(leaves.dtypes)['group']}, model string, score double, se double")
    by_score = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("k"), "model", "score", "se")))
    ranked = fit.groupBy("group").agg(by_score.alias("x")).select("group", F.posexplode("x").alias("i", "x"))
    return ranked.join(counts, "group").select(
        "group", "x.model", "x.score", "x.se", (F.col("x.score") - 2 * F.col("x.se")).alias("low"), (F.col("x.score") + 2 * F.col("x.se")).alias("high"), (F.col("i") + 1).cast("long").alias("rank"),
        "leaves", "eligible", "comparisons", (F.col("eligible") / F.col("leaves") >= RELIABLE).alias("reliable"))
