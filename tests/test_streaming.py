"""Streams over files give what the batch gives."""

from pyspark.sql import functions as F

from canopyrank.operators.ratings import ratings
from canopyrank.plans.evaluation import pair_stats
from canopyrank.streaming import online

SCHEMA = "event_id long, ts timestamp, domain string, a string, b string, wa double, wb double, tie double"


def log(spark, tmp_path):
    import datetime as dt

    rows = []
    for i in range(60):
        a, b, o = f"M{i % 3}", f"M{(i + 1) % 3}", i % 3
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"d{i % 2}", a, b, float(o == 0), float(o == 1), float(o == 2)))
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        df.filter(f"event_id div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / f"{k}"))
    return df, spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_pair_counts(spark, tmp_path):
    df, stream = log(spark, tmp_path)
    got = drain(online.pair_counts(stream), "pairs", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pair_stats(df).collect()))


def test_ratings(spark, tmp_path):
    df, stream = log(spark, tmp_path)
    got = drain(online.online_ratings(stream), "rated", "update")
    last = {(r.domain, r.agent): (round(r.mu, 6), round(r.sigma, 6)) for r in got.collect()}
    want = {(r.domain, r.agent): (round(r.mu, 6), round(r.sigma, 6)) for r in ratings(df).collect()}
    assert set(last) == set(want)
    assert last == want


def test_repeated_matches_are_dropped(spark, tmp_path):
    df, _ = log(spark, tmp_path)
    df.filter("event_id < 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / "again"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    got = drain(online.distinct_matches(stream, "10 days"), "once", "append")
    assert sorted(r.event_id for r in got.collect()) == list(range(60))


def test_volume_by_window(spark, tmp_path):
    df, stream = log(spark, tmp_path)
    got = drain(online.windowed_volume(stream), "volume", "complete")
    want = df.groupBy(F.date_trunc("day", "ts").alias("start"), "domain").count().collect()
    assert sorted((r.start, r.domain, r.n) for r in got.collect()) == sorted((r.start, r.domain, r["count"]) for r in want)
