"""The match log as a stream: pair statistics and ratings kept up to date.

Both forms equal the batch ones over the same rows: pair statistics add up in
any order; ratings are applied in the order (ts, event_id) within a
micro-batch, and batches in their order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from canopyrank.operators.ratings import rate_log, with_anchor

RATING_SCHEMA = "domain string, agent string, mu double, sigma double"


def distinct_matches(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Matches once each by event_id, as far as the watermark reaches back."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def pair_counts(stream: DataFrame) -> DataFrame:
    """Outcomes by domain and unordered pair; for update or complete mode."""
    fwd = F.col("a") < F.col("b")
    return stream.groupBy("domain", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum(F.when(fwd, F.col("wa")).otherwise(F.col("wb"))).alias("wins_a"), F.sum(F.when(fwd, F.col("wb")).otherwise(F.col("wa"))).alias("wins_b"), F.sum("tie").alias("ties"), F.count("*").alias("n"))


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    agents, mu, sigma = state.get if state.exists else ([], [], [])
    known = dict(zip(agents, zip(mu, sigma)))
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
    known = rate_log(zip(rows["a"], rows["b"], rows["outcome"], rows["conf"]), known)
    names = sorted(known)
    state.update((names, [float(known[a][0]) for a in names], [float(known[a][1]) for a in names]))
    yield pd.DataFrame({"domain": key[0], "agent": names, "mu": [known[a][0] for a in names], "sigma": [known[a][1] for a in names]})


def online_ratings(stream: DataFrame) -> DataFrame:
    """Ratings by domain, and in the domain global, after each micro-batch; the state holds a domain's agents alone."""
    return with_anchor(stream).groupBy("domain").applyInPandasWithState(
        _update, RATING_SCHEMA, "agents array<string>, mu array<double>, sigma array<double>", "update", GroupStateTimeout.NoTimeout
    )


def windowed_volume(stream: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Matches by domain in tumbling windows; late rows count while the watermark lets them."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "domain").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "domain", "n")
