"""Stored answers: ingestion, joins, aggregations and ranks."""

from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.plans.base import EVAL, MATCH, evals, matches, r6
from canopyrank.plans.registry import register
from canopyrank.session import table


def _int(c):
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def _sql(body: str, base: str = EVAL) -> str:
    return f"WITH {base} {body}"


@register("agg01_shared_questions", _sql("SELECT question_id, count(DISTINCT model_name) AS n_models FROM er GROUP BY question_id HAVING count(DISTINCT model_name) >= 5"))
def agg01(spark, sf):
    return evals(spark, sf).groupBy("question_id").agg(F.countDistinct("model_name").alias("n_models")).filter("n_models >= 5")


@register("agg02_model_accuracy", _sql("SELECT model_name, count(*) AS n, CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM er GROUP BY model_name"))
def agg02(spark, sf):
    ok = F.col("is_correct").cast("int").cast("double")
    return evals(spark, sf).groupBy("model_name").agg(F.count("*").alias("n"), _int(F.col("is_correct")).alias("correct"), r6(F.avg(ok)).alias("accuracy"))


@register("agg03_ingestion_health", _sql("SELECT model_name, count(*) AS total, count(*) FILTER (WHERE is_reserved) AS reserved, count(*) FILTER (WHERE category = 'Brand#11') AS topic, count(*) FILTER (WHERE is_reserved AND category = 'Brand#11') AS reserved_topic FROM er GROUP BY model_name"))
def agg03(spark, sf):
    t = F.col("category") == "Brand#11"
    return evals(spark, sf).groupBy("model_name").agg(F.count("*").alias("total"), _int(F.col("is_reserved")).alias("reserved"), _int(t).alias("topic"), _int(t & F.col("is_reserved")).alias("reserved_topic"))


@register("agg04_store_stats", _sql("SELECT count(*) AS results, count(DISTINCT model_name) AS models, count(DISTINCT question_id) AS questions FROM er"))
def agg04(spark, sf):
    return evals(spark, sf).agg(F.count("*").alias("results"), F.countDistinct("model_name").alias("models"), F.countDistinct("question_id").alias("questions"))


@register("agg05_distinct_categories", _sql("SELECT DISTINCT category FROM er ORDER BY category"))
def agg05(spark, sf):
    return evals(spark, sf).select("category").distinct().orderBy("category")


@register("agg06_domain_histogram", "SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand")
def agg06(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"))


@register("agg07_win_counts", _sql("SELECT domain, CASE WHEN wa = 1 THEN a ELSE b END AS winner, CASE WHEN wa = 1 THEN b ELSE a END AS loser, count(*) AS n FROM mt WHERE tie = 0 GROUP BY ALL", MATCH))
def agg07(spark, sf):
    won = F.col("wa") == 1
    m = matches(spark, sf).filter("tie = 0")
    return m.groupBy("domain", F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(won, F.col("b")).otherwise(F.col("a")).alias("loser")).agg(F.count("*").alias("n"))


def pair_stats(m):
    """Outcomes by unordered pair: domain, a, b, wins_a, wins_b, ties, n."""
    fwd = F.col("a") < F.col("b")
    return m.groupBy("domain", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum(F.when(fwd, F.col("wa")).otherwise(F.col("wb"))).alias("wins_a"), F.sum(F.when(fwd, F.col("wb")).otherwise(F.col("wa"))).alias("wins_b"),
        F.sum("tie").alias("ties"), F.count("*").alias("n"),
    ).withColumnsRenamed({"x": "a", "y": "b"})


@register("agg08_pair_stats", _sql("SELECT * FROM ps", MATCH))
def agg08(spark, sf):
    return pair_stats(matches(spark, sf))


@register("agg09_pooled_pair_stats", _sql("SELECT a, b, sum(wins_a) AS wins_a, sum(wins_b) AS wins_b, sum(ties) AS ties, CAST(sum(n) AS BIGINT) AS n, count(*) AS leaves FROM ps WHERE n >= 5 AND domain NOT IN (SELECT domain FROM mt GROUP BY domain HAVING avg(tie) > 0.9) GROUP BY a, b", MATCH))
def agg09(spark, sf):
    m = matches(spark, sf)
    vague = m.groupBy("domain").agg(F.avg("tie").alias("t")).filter("t > 0.9").select("domain")
    return pair_stats(m).filter("n >= 5").join(vague, "domain", "left_anti").groupBy("a", "b").agg(
        F.sum("wins_a").alias("wins_a"), F.sum("wins_b").alias("wins_b"), F.sum("ties").alias("ties"), F.sum("n").alias("n"), F.count("*").alias("leaves"))


@register("agg10_verdict_pair_stats", _sql("SELECT domain, a, b, wins_a + 0.5::DOUBLE * ties AS wins_a, wins_b + 0.5::DOUBLE * ties AS wins_b, ties, n FROM ps", MATCH))
def agg10(spark, sf):
    half = F.lit(0.5) * F.col("ties")
    return pair_stats(matches(spark, sf)).withColumns({"wins_a": F.col("wins_a") + half, "wins_b": F.col("wins_b") + half})


_BOTH = """, jd AS (SELECT x.question_id, x.category, x.model_name AS a, y.model_name AS b, x.is_correct AS ca, y.is_correct AS cb, (x.question_id * 7 + ascii(substr(x.model_name, 2, 1)) * 3 + ascii(substr(y.model_name, 2, 1))) % 10 AS roll
  FROM er x JOIN er y ON x.question_id = y.question_id AND x.model_name < y.model_name),
 vd AS (SELECT *, CASE WHEN roll < 4 THEN 'A' WHEN roll < 8 THEN 'B' ELSE 'TIE' END AS verdict, round(0.5::DOUBLE + roll / 20.0::DOUBLE, 6) AS conf FROM jd)"""


def verdicts(spark, sf):
    """A synthetic verdict for every pair of answers to a question: question_id, category, a, b, ca, cb, verdict, conf."""
    e = evals(spark, sf).select("question_id", "category", "model_name", "is_correct")
    x, y = e.alias("x"), e.drop("category").alias("y")
    j = x.join(y, (F.col("x.question_id") == F.col("y.question_id")) & (F.col("x.model_name") < F.col("y.model_name")))
    no = lambda c: F.ascii(F.substring(c, 2, 1))
    roll = (F.col("x.question_id") * 7 + no("x.model_name") * 3 + no("y.model_name")) % 10
    j = j.select(F.col("x.question_id"), "category", F.col("x.model_name").alias("a"), F.col("y.model_name").alias("b"), F.col("x.is_correct").alias("ca"), F.col("y.is_correct").alias("cb"), roll.alias("roll"))
    v = F.when(F.col("roll") < 4, "A").when(F.col("roll") < 8, "B").otherwise("TIE")
    return j.withColumn("verdict", v).withColumn("conf", F.round(F.lit(0.5) + F.col("roll") / F.lit(20.0), 6))


_AGREE = "((verdict = 'A' AND ca) OR (verdict = 'B' AND cb) OR (verdict = 'TIE' AND NOT ca AND NOT cb))"


def agree():
    v = F.col("verdict")
    return ((v == "A") & F.col("ca")) | ((v == "B") & F.col("cb")) | ((v == "TIE") & ~F.col("ca") & ~F.col("cb"))


@register("agg11_judge_agreement", _sql(f"SELECT a, b, count(*) AS checks, count(*) FILTER (WHERE {_AGREE}) AS agreed FROM vd GROUP BY a, b", EVAL + _BOTH))
def agg11(spark, sf):
    return verdicts(spark, sf).groupBy("a", "b").agg(F.count("*").alias("checks"), _int(agree()).alias("agreed"))


@register("agg12_weighted_pair_stats", _sql("SELECT category, a, b, round(sum(CASE WHEN verdict = 'A' THEN conf ELSE 0.0::DOUBLE END), 6) AS wins_a, round(sum(CASE WHEN verdict = 'B' THEN conf ELSE 0.0::DOUBLE END), 6) AS wins_b, round(sum(CASE WHEN verdict = 'TIE' THEN conf ELSE 0.0::DOUBLE END), 6) AS ties FROM vd GROUP BY ALL", EVAL + _BOTH))
def agg12(spark, sf):
    part = lambda k: r6(F.sum(F.when(F.col("verdict") == k, F.col("conf")).otherwise(F.lit(0.0))))
    return verdicts(spark, sf).groupBy("category", "a", "b").agg(part("A").alias("wins_a"), part("B").alias("wins_b"), part("TIE").alias("ties"))


@register("agg13_pair_report", _sql(f"SELECT a, b, count(*) AS n, count(*) FILTER (WHERE verdict = 'A' AND conf >= 0.6) AS judge_a, count(*) FILTER (WHERE verdict = 'B' AND conf >= 0.6) AS judge_b, count(*) FILTER (WHERE ca AND NOT cb) AS acc_a, count(*) FILTER (WHERE cb AND NOT ca) AS acc_b, round(avg(CASE WHEN {_AGREE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement, round(round(avg(conf), 9), 6) AS mean_conf, count(*) < 20 AS exhausted FROM vd GROUP BY a, b", EVAL + _BOTH))
def agg13(spark, sf):
    sure, v = F.col("conf") >= 0.6, F.col("verdict")
    return verdicts(spark, sf).groupBy("a", "b").agg(
        F.count("*").alias("n"), _int((v == "A") & sure).alias("judge_a"), _int((v == "B") & sure).alias("judge_b"), _int(F.col("ca") & ~F.col("cb")).alias("acc_a"),
        _int(F.col("cb") & ~F.col("ca")).alias("acc_b"), r6(F.avg(agree().cast("int").cast("double"))).alias("agreement"), r6(F.round(F.avg("conf"), 9)).alias("mean_conf"), (F.count("*") < 20).alias("exhausted"))


@register("agg14_category_report", _sql(f"SELECT category, count(*) AS n, count(DISTINCT question_id) AS questions, round(avg(CASE WHEN {_AGREE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement, round(round(avg(conf), 9), 6) AS mean_conf FROM vd GROUP BY category ORDER BY n DESC, category", EVAL + _BOTH))
def agg14(spark, sf):
    return verdicts(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("questions"), r6(F.avg(agree().cast("int").cast("double"))).alias("agreement"), r6(F.round(F.avg("conf"), 9)).alias("mean_conf")).orderBy(F.desc("n"), "category")


@register("agg15_coverage", _sql(f"SELECT (SELECT count(DISTINCT question_id) FROM vd) AS covered, (SELECT count(*) FROM part) AS questions, round((SELECT count(DISTINCT question_id) FROM vd) / (SELECT count(*) FROM part)::DOUBLE, 6) AS coverage, (SELECT round(avg(CASE WHEN {_AGREE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM vd) AS agreement", EVAL + _BOTH))
def agg15(spark, sf):
    v = verdicts(spark, sf).agg(F.countDistinct("question_id").alias("covered"), r6(F.avg(agree().cast("int").cast("double"))).alias("agreement"))
    return v.join(table(spark, sf, "part").agg(F.count("*").alias("questions"))).select("covered", "questions", r6(F.col("covered") / F.col("questions")).alias("coverage"), "agreement")


@register("agg16_leaf_agreement", _sql(f"SELECT category AS leaf, round(avg(CASE WHEN {_AGREE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement FROM vd GROUP BY category", EVAL + _BOTH))
def agg16(spark, sf):
    return verdicts(spark, sf).groupBy(F.col("category").alias("leaf")).agg(r6(F.avg(agree().cast("int").cast("double"))).alias("agreement"))


@register("agg17_round_summary", _sql("SELECT CAST(event_id // 500 AS BIGINT) AS round, least(a, b) AS a, greatest(a, b) AS b, CAST(sum(CASE WHEN a < b THEN wa ELSE wb END) AS BIGINT) AS w, CAST(sum(CASE WHEN a < b THEN wb ELSE wa END) AS BIGINT) AS l, CAST(sum(tie) AS BIGINT) AS t, count(*) FILTER (WHERE a > b) AS flips, round(avg(value / 100.0::DOUBLE), 6) AS mean_conf FROM mt GROUP BY ALL", MATCH))
def agg17(spark, sf):
    f = F.col("a") < F.col("b")
    return matches(spark, sf).groupBy(F.expr("event_id div 500").alias("round"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum(F.when(f, F.col("wa")).otherwise(F.col("wb"))).cast("long").alias("w"), F.sum(F.when(f, F.col("wb")).otherwise(F.col("wa"))).cast("long").alias("l"), F.sum("tie").cast("long").alias("t"),
        _int(~f).alias("flips"), r6(F.avg(F.col("value") / F.lit(100.0))).alias("mean_conf")).withColumnsRenamed({"x": "a", "y": "b"})


_SEAT = "st AS (SELECT domain, least(a, b) AS a, greatest(a, b) AS b, count(*)::DOUBLE AS n, sum(tie) AS ties, sum(CASE WHEN a < b THEN wa ELSE 0 END) AS first, sum(CASE WHEN a > b THEN wb ELSE 0 END) AS second, sum(CASE WHEN a < b THEN wb ELSE wa END) AS wb0 FROM mt GROUP BY ALL)"


@register("agg18_position_bias", _sql("SELECT domain, a, b, n, abs(first - second) / n > 0.3 AND n >= 6 AS biased, round(CASE WHEN n >= 6 AND abs(first - second) / n > 0.3 THEN (first + second) / 2 ELSE first + second END, 6) AS wins_a, round(CASE WHEN n >= 6 AND abs(first - second) / n > 0.3 THEN greatest(0, n - (first + second) / 2 - ties) ELSE wb0 END, 6) AS wins_b FROM st", MATCH + ", " + _SEAT))
def agg18(spark, sf):
    f, z = F.col("a") < F.col("b"), F.lit(0.0)
    s = matches(spark, sf).groupBy("domain", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.count("*").cast("double").alias("n"), F.sum("tie").alias("ties"), F.sum(F.when(f, F.col("wa")).otherwise(z)).alias("first"), F.sum(F.when(~f, F.col("wb")).otherwise(z)).alias("second"), F.sum(F.when(f, F.col("wb")).otherwise(F.col("wa"))).alias("wb0"))
    biased = (F.abs(F.col("first") - F.col("second")) / F.col("n") > 0.3) & (F.col("n") >= 6)
    both = F.col("first") + F.col("second")
    return s.select("domain", F.col("x").alias("a"), F.col("y").alias("b"), "n", biased.alias("biased"), r6(F.when(biased, both / 2).otherwise(both)).alias("wins_a"), r6(F.when(biased, F.greatest(z, F.col("n") - both / 2 - F.col("ties"))).otherwise(F.col("wb0"))).alias("wins_b"))


@register("agg19_flip_rate", _sql("SELECT domain, round(count(*) FILTER (WHERE a > b) / count(*)::DOUBLE, 6) AS flip_rate FROM mt GROUP BY domain", MATCH))
def agg19(spark, sf):
    return matches(spark, sf).groupBy("domain").agg(r6(_int(F.col("a") > F.col("b")) / F.count("*")).alias("flip_rate"))


@register("agg23_flow_matrix", _sql("SELECT gt, count(*) FILTER (WHERE pred = 'A') AS \"A\", count(*) FILTER (WHERE pred = 'B') AS \"B\", count(*) FILTER (WHERE pred = 'C') AS \"C\", count(*) FILTER (WHERE pred = 'D') AS \"D\", count(*) FILTER (WHERE pred NOT IN ('A', 'B', 'C', 'D')) AS \"Other\" FROM er GROUP BY gt"))
def agg23(spark, sf):
    e = evals(spark, sf)
    known = [_int(F.col("pred") == k).alias(k) for k in "ABCD"]
    return e.groupBy("gt").agg(*known, _int(~F.col("pred").isin(*"ABCD")).alias("Other"))


#: Ranges of values that a phase is cut into for its order statistics.
RANGES = 1024


@register("agg24_phase_timings", "SELECT event_type AS phase, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, max(CASE WHEN k = n // 2 THEN value END) AS p50, max(CASE WHEN k = CAST(floor(n * 0.95) AS BIGINT) THEN value END) AS p95, round(CASE WHEN sum(value) > 0 THEN count(*) * 1000 / sum(value) ELSE 0 END, 4) AS throughput FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def agg24(spark, sf):
    """Order statistics without sorting a phase: counts by value are cut into ranges of each phase, and only the ranges that hold a wanted rank are gone through."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("phase"), "value")
    by = e.groupBy("phase", "value").agg(F.count("*").alias("c"))
    v, c = F.col("value"), F.col("c")
    # a row for each phase, of which there are few
    whole = by.groupBy("phase").agg(F.sum("c").alias("n"), F.sum(v * c).alias("s"), F.min("value").alias("least"), F.max("value").alias("most"))
    span = F.col("most") - F.col("least")
    part = F.when(span > 0, F.least(F.lit(RANGES - 1), F.floor((v - F.col("least")) / span * RANGES))).otherwise(F.lit(0)).alias("part")
    cut = by.join(whole, "phase").select("phase", part, "value", "c", "n")
    sizes = cut.groupBy("phase", "part").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    upto = F.sum("c").over(W.partitionBy("phase").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    ranks = F.array(F.struct(F.lit("p50").alias("q"), F.expr("n div 2").alias("k")), F.struct(F.lit("p95").alias("q"), F.floor(F.col("n") * F.lit(0.95)).alias("k")))
    held = sizes.withColumn("upto", upto).select("phase", "part", (F.col("upto") - F.col("c")).alias("before"), "upto", F.explode(ranks).alias("r")).filter("before <= r.k AND r.k < upto")
    inside = cut.select("phase", "part", "value", "c").join(held.select("phase", "part", "before", "r"), ["phase", "part"])
    run = F.col("before") + F.sum("c").over(W.partitionBy("phase", "part", "r.q").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    got = inside.withColumn("run", run).filter("run > r.k").groupBy("phase").agg(*[F.min(F.when(F.col("r.q") == q, v)).alias(q) for q in ("p50", "p95")])
    per = F.when(F.col("s") > 0, F.col("n") * 1000 / F.col("s")).otherwise(F.lit(0.0))
    return whole.join(got, "phase").select("phase", F.col("n").alias("calls"), F.round("s", 4).alias("total"), r6(F.col("s") / F.col("n")).alias("mean"), "least", "most", "p50", "p95", F.round(per, 4).alias("throughput"))


@register("agg27_effective_sample", "SELECT label, round(sum(quality_w) * sum(quality_w) / sum(quality_w * quality_w), 6) AS ess FROM (SELECT label, 1.0::DOUBLE / (1 + vec_id % 4) AS quality_w FROM embeddings) GROUP BY label")
def agg27(spark, sf):
    w = F.lit(1.0) / (1 + F.col("vec_id") % 4)
    return table(spark, sf, "embeddings").groupBy("label").agg(r6(F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


# joins and sinks over stored answers


@register("jn01_dataset_link", "SELECT c_custkey, c_name, o_orderkey AS link FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def jn01(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", F.col("o_orderkey").alias("link"))


@register("jn02_reserved_linked", _sql("SELECT DISTINCT question_id, question FROM er WHERE is_reserved AND question_id IN (SELECT question_id FROM er GROUP BY question_id HAVING count(DISTINCT model_name) >= 4)"))
def jn02(spark, sf):
    e = evals(spark, sf)
    full = e.groupBy("question_id").agg(F.countDistinct("model_name").alias("k")).filter("k >= 4")
    return e.filter("is_reserved").select("question_id", "question").distinct().join(full, "question_id", "left_semi")


_NORM = r"trim(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\s+', ' ', 'g'))"


@register("jn03_text_link", f"SELECT b.item_id, coalesce(e.doc_id, n.doc_id) AS doc_id FROM benchmark b LEFT JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) e ON b.text = e.text LEFT JOIN (SELECT {_NORM.format('text')} AS t, min(doc_id) AS doc_id FROM documents GROUP BY 1) n ON {_NORM.format('b.text')} = n.t")
def jn03(spark, sf):
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\s+", " "))
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    e = d.groupBy("text").agg(F.min("doc_id").alias("exact"))
    n = d.groupBy(norm(F.col("text")).alias("t")).agg(F.min("doc_id").alias("near"))
    return b.join(e, "text", "left").join(n, norm(b.text) == n.t, "left").select("item_id", F.coalesce("exact", "near").alias("doc_id"))


@register("jn04_has_embedding", "SELECT p_partkey, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = p_partkey) AS has_embedding FROM part")
def jn04(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id").distinct()
    p = table(spark, sf, "part")
    return p.join(v, p.p_partkey == v.vec_id, "left").select("p_partkey", F.col("vec_id").isNotNull().alias("has_embedding"))


@register("jn06_pool_minus_reserved", _sql("SELECT DISTINCT question_id FROM er e WHERE NOT EXISTS (SELECT 1 FROM er r WHERE r.is_reserved AND r.question_id = e.question_id)"))
def jn06(spark, sf):
    e = evals(spark, sf)
    return e.select("question_id").distinct().join(e.filter("is_reserved").select("question_id"), "question_id", "left_anti")


@register("jn05_reserved_ids", _sql("SELECT DISTINCT question_id FROM er WHERE question IN (SELECT question FROM er WHERE is_reserved)"))
def jn05(spark, sf):
    e = evals(spark, sf)
    return e.join(e.filter("is_reserved").select("question").distinct(), "question", "left_semi").select("question_id").distinct()


@register("jn07_model_pairs", _sql("SELECT x.m AS a, y.m AS b FROM (SELECT DISTINCT model_name AS m FROM er) x, (SELECT DISTINCT model_name AS m FROM er) y WHERE x.m < y.m"))
def jn07(spark, sf):
    m = evals(spark, sf).select("model_name").distinct()
    return m.select(F.col("model_name").alias("a")).join(m.select(F.col("model_name").alias("b")), F.col("a") < F.col("b"))


@register("jn08_symmetric_match", _sql("SELECT domain, count(*) AS n FROM mt WHERE (a = 'M1' AND b = 'M3') OR (a = 'M3' AND b = 'M1') GROUP BY domain", MATCH))
def jn08(spark, sf):
    return matches(spark, sf).filter((F.least("a", "b") == "M1") & (F.greatest("a", "b") == "M3")).groupBy("domain").agg(F.count("*").alias("n"))


@register("jn09_answer_matrix", _sql("SELECT question_id, " + ", ".join(f"max(CASE WHEN model_name = 'M{k}' THEN pred END) AS \"M{k}\"" for k in range(6)) + " FROM er GROUP BY question_id HAVING count(*) >= 4"))
def jn09(spark, sf):
    cells = [F.max(F.when(F.col("model_name") == f"M{k}", F.col("pred"))).alias(f"M{k}") for k in range(6)]
    return evals(spark, sf).groupBy("question_id").agg(F.count("*").alias("k"), *cells).filter("k >= 4").drop("k")


@register("jn15_frozen_replay", _sql("SELECT t.event_id, e.pred AS pred_a, f.pred AS pred_b FROM (SELECT event_id, event_id % (SELECT count(*) FROM part) AS question_id, a, b FROM mt) t JOIN er e ON e.question_id = t.question_id AND e.model_name = t.a JOIN er f ON f.question_id = t.question_id AND f.model_name = t.b", EVAL + ", " + MATCH))
def jn15(spark, sf):
    n = table(spark, sf, "part").agg(F.count("*").alias("n"))
    t = matches(spark, sf).join(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("question_id"), "a", "b")
    e = evals(spark, sf).select("question_id", "model_name", "pred")
    one = t.join(e.withColumnsRenamed({"model_name": "a", "pred": "pred_a"}), ["question_id", "a"])
    return one.join(e.withColumnsRenamed({"model_name": "b", "pred": "pred_b"}), ["question_id", "b"]).select("event_id", "pred_a", "pred_b")


@register("jn16_mcnemar_pairing", _sql("SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT x.is_correct AS a, coalesce(y.is_correct, false) AS b FROM er x LEFT JOIN er y ON y.question_id = x.question_id AND y.model_name = 'M5' WHERE x.model_name = 'M0')"))
def jn16(spark, sf):
    e = evals(spark, sf)
    x = e.filter("model_name = 'M0'").select("question_id", F.col("is_correct").alias("a"))
    y = e.filter("model_name = 'M5'").select("question_id", F.col("is_correct").alias("c"))
    j = x.join(y, "question_id", "left").withColumn("b", F.coalesce("c", F.lit(False)))
    a, b = F.col("a"), F.col("b")
    return j.agg(_int(a & b).alias("both"), _int(a & ~b).alias("only_a"), _int(~a & b).alias("only_b"), _int(~a & ~b).alias("neither"))


@register("jn17_common_keys", _sql("SELECT x.question_id, x.pred AS left_label, y.pred AS right_label FROM er x JOIN er y USING (question_id) WHERE x.model_name = 'M1' AND y.model_name = 'M2'"))
def jn17(spark, sf):
    e = evals(spark, sf)
    pick = lambda m, n: e.filter(F.col("model_name") == m).select("question_id", F.col("pred").alias(n))
    return pick("M1", "left_label").join(pick("M2", "right_label"), "question_id")


@register("snk01_insert_or_ignore", _sql("SELECT model_name, count(*) FILTER (WHERE NOT old) AS inserted, count(*) FILTER (WHERE old) AS skipped FROM (SELECT model_name, EXISTS (SELECT 1 FROM er s WHERE s.question_id = e.question_id AND s.model_name = e.model_name AND s.question_id % 2 = 0) AS old FROM er e) GROUP BY model_name"))
def snk01(spark, sf):
    e = evals(spark, sf)
    store = e.filter("question_id % 2 = 0").select("question_id", "model_name", F.lit(True).alias("old"))
    j = e.join(store, ["question_id", "model_name"], "left")
    return j.groupBy("model_name").agg(_int(F.col("old").isNull()).alias("inserted"), _int(F.col("old").isNotNull()).alias("skipped"))


@register("snk02_latest_wins", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 GROUP BY o_custkey")
def snk02(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@register("snk03_reserved_reset", "SELECT p_partkey, p_partkey IN (SELECT item_id FROM benchmark) AS is_reserved FROM part")
def snk03(spark, sf):
    p, b = table(spark, sf, "part"), table(spark, sf, "benchmark").select("item_id").distinct()
    return p.join(b, p.p_partkey == b.item_id, "left").select("p_partkey", F.col("item_id").isNotNull().alias("is_reserved"))


@register("snk22_missing_answers", _sql("SELECT question_id, string_agg(model_name, '|' ORDER BY model_name) AS missing FROM (SELECT q.question_id, m.model_name FROM (SELECT DISTINCT question_id FROM er) q, (SELECT DISTINCT model_name FROM er) m WHERE NOT EXISTS (SELECT 1 FROM er e WHERE e.question_id = q.question_id AND e.model_name = m.model_name)) GROUP BY question_id"))
def snk22(spark, sf):
    e = evals(spark, sf)
    # as many models as take part; the questions are not paired but get the whole roster in one row
    all_ = e.agg(F.array_sort(F.collect_set("model_name")).alias("roster"))
    have = e.groupBy("question_id").agg(F.collect_set("model_name").alias("have"))
    return have.join(F.broadcast(all_)).select("question_id", F.array_join(F.array_except("roster", "have"), "|").alias("missing")).filter("missing <> ''")


@register("src06_dataset_scan", "SELECT p_partkey, p_name, p_brand, coalesce(nullif(item_id, 0), p_partkey) AS row_id FROM part LEFT JOIN benchmark ON p_partkey = item_id WHERE p_brand IN ('Brand#11', 'Brand#22') ORDER BY p_partkey LIMIT 50")
def src06(spark, sf):
    p, b = table(spark, sf, "part"), table(spark, sf, "benchmark").select("item_id")
    some = p.filter(F.col("p_brand").isin("Brand#11", "Brand#22")).join(b, p.p_partkey == b.item_id, "left").orderBy("p_partkey").limit(50)
    return some.select("p_partkey", "p_name", "p_brand", F.coalesce(F.nullif("item_id", F.lit(0)), "p_partkey").alias("row_id"))


@register("src07_point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def src07(spark, sf):
    return table(spark, sf, "part").filter("p_partkey = 17").select("p_partkey", "p_name")


@register("src08_batch_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)")
def src08(spark, sf):
    p, v = table(spark, sf, "part"), table(spark, sf, "embeddings")
    return p.join(v, p.p_partkey == v.vec_id, "left_semi").select("p_partkey", "p_name")


@register("src18_ingest", _sql("SELECT * FROM er"))
def src18(spark, sf):
    return evals(spark, sf)


@register("top02_first_eligible", _sql("SELECT question_id FROM er GROUP BY question_id HAVING count(*) >= 3 ORDER BY question_id LIMIT 25"))
def top02(spark, sf):
    return evals(spark, sf).groupBy("question_id").agg(F.count("*").alias("k")).filter("k >= 3").select("question_id").orderBy("question_id").limit(25)


@register("top08_seeded_sample", _sql("SELECT question_id FROM (SELECT DISTINCT question_id FROM er) ORDER BY md5(CAST(question_id AS VARCHAR) || ':42'), question_id LIMIT 30"))
def top08(spark, sf):
    return evals(spark, sf).select("question_id").distinct().orderBy(F.md5(F.concat(F.col("question_id").cast("string"), F.lit(":42"))), "question_id").limit(30)


@register("win01_rank", _sql("SELECT model_name, row_number() OVER (ORDER BY avg(CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) DESC, model_name) AS rank FROM er GROUP BY model_name"))
def win01(spark, sf):
    s = evals(spark, sf).groupBy("model_name").agg(F.avg(F.col("is_correct").cast("int").cast("double")).alias("s"))
    return s.select("model_name", F.row_number().over(W.orderBy(F.desc("s"), "model_name")).cast("long").alias("rank"))


@register("win02_average_ranks", "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS avg_rank FROM part")
def win02(spark, sf):
    r = F.rank().over(W.partitionBy("p_brand").orderBy("p_size"))
    ties = F.count("*").over(W.partitionBy("p_brand", "p_size"))
    return table(spark, sf, "part").select("p_partkey", "p_brand", (r + (ties - 1) / F.lit(2.0)).alias("avg_rank"))


_ROUND = "rd AS (SELECT CAST(event_id // 500 AS BIGINT) AS round, domain, count(*) AS n, round(avg(value), 6) AS conf, sum(wa) AS w FROM mt GROUP BY ALL)"


def rounds(spark, sf):
    return matches(spark, sf).groupBy(F.expr("event_id div 500").alias("round"), "domain").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("conf"), F.sum("wa").alias("w"))


@register("win03_rank_stability", _sql("SELECT round, domain, min(w) OVER k = max(w) OVER k AND count(*) OVER k = 3 AS stable FROM rd WINDOW k AS (PARTITION BY domain ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", MATCH + ", " + _ROUND))
def win03(spark, sf):
    k = W.partitionBy("domain").orderBy("round").rowsBetween(-2, 0)
    return rounds(spark, sf).select("round", "domain", ((F.min("w").over(k) == F.max("w").over(k)) & (F.count("*").over(k) == 3)).alias("stable"))


@register("win04_confidence_change", _sql("SELECT round, domain, round(conf - lag(conf) OVER (PARTITION BY domain ORDER BY round), 6) AS change FROM rd", MATCH + ", " + _ROUND))
def win04(spark, sf):
    return rounds(spark, sf).select("round", "domain", r6(F.col("conf") - F.lag("conf").over(W.partitionBy("domain").orderBy("round"))).alias("change"))


@register("win08_trajectory", _sql("SELECT round, domain, CAST(sum(n) OVER (PARTITION BY domain ORDER BY round ROWS UNBOUNDED PRECEDING) AS BIGINT) AS comparisons FROM rd", MATCH + ", " + _ROUND))
def win08(spark, sf):
    k = W.partitionBy("domain").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    return rounds(spark, sf).select("round", "domain", F.sum("n").over(k).alias("comparisons"))


@register("set04_distinct_by_text", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def set04(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@register("set06_residual_texts", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set06(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti").distinct()


@register("rat23_oracle_verdict", _sql("SELECT a, b, CASE WHEN ca AND NOT cb THEN 'Model A' WHEN cb AND NOT ca THEN 'Model B' ELSE 'TIE' END AS winner, count(*) AS n FROM vd GROUP BY ALL", EVAL + _BOTH))
def rat23(spark, sf):
    w = F.when(F.col("ca") & ~F.col("cb"), "Model A").when(F.col("cb") & ~F.col("ca"), "Model B").otherwise("TIE")
    return verdicts(spark, sf).groupBy("a", "b", w.alias("winner")).agg(F.count("*").alias("n"))


# two trials of a pair, the second with the answers swapped; what the judge says of it is named by its own seats
_TRIALS = """, tr AS (SELECT *, CASE verdict WHEN 'A' THEN 'Model A' WHEN 'B' THEN 'Model B' ELSE 'TIE' END AS one,
 CASE WHEN roll = 5 THEN 'INVALID' WHEN roll % 3 = 0 THEN 'Model A' WHEN verdict = 'A' THEN 'Model B' WHEN verdict = 'B' THEN 'Model A' ELSE 'TIE' END AS two, conf AS c1, 1 - conf / 2 AS c2 FROM vd),
 cb AS (SELECT *, CASE two WHEN 'Model A' THEN 'Model B' WHEN 'Model B' THEN 'Model A' ELSE two END AS back FROM tr)"""


@register("rat22_verdict_combine", _sql("SELECT winner, source, count(*) AS n, round(sum(c), 4) AS conf, sum(a1)::DOUBLE AS win_a_first, sum(a2)::DOUBLE AS win_a_second FROM (SELECT CASE WHEN one = 'INVALID' OR back = 'INVALID' THEN 'INVALID' WHEN one <> back THEN 'TIE' ELSE one END AS winner, CASE WHEN one = 'INVALID' OR back = 'INVALID' THEN 'none' WHEN one <> back THEN 'POSITION_FLIP' WHEN one = 'TIE' THEN 'JUDGE_EMITTED' ELSE 'none' END AS source, CASE WHEN one <> 'INVALID' AND back <> 'INVALID' AND one <> back THEN 0.5::DOUBLE ELSE greatest(0, least(0.95::DOUBLE, (c1 + c2) / 2)) END AS c, CASE one WHEN 'Model A' THEN 1.0::DOUBLE WHEN 'Model B' THEN 0 ELSE 0.5::DOUBLE END AS a1, CASE two WHEN 'Model B' THEN 1.0::DOUBLE WHEN 'Model A' THEN 0 ELSE 0.5::DOUBLE END AS a2 FROM cb) GROUP BY ALL", EVAL + _BOTH + _TRIALS))
def rat22(spark, sf):
    """Two trials agree, or the pair is a tie by position; an unreadable trial makes it invalid; confidence is the trials' mean, at most 0.95."""
    v, roll = F.col("verdict"), F.col("roll")
    one = F.when(v == "A", "Model A").when(v == "B", "Model B").otherwise("TIE")
    two = F.when(roll == 5, "INVALID").when(roll % 3 == 0, "Model A").when(v == "A", "Model B").when(v == "B", "Model A").otherwise("TIE")
    t = verdicts(spark, sf).select(one.alias("one"), two.alias("two"), F.col("conf").alias("c1"), (1 - F.col("conf") / 2).alias("c2"))
    t = t.withColumn("back", F.when(F.col("two") == "Model A", "Model B").when(F.col("two") == "Model B", "Model A").otherwise(F.col("two")))
    bad, same = (F.col("one") == "INVALID") | (F.col("back") == "INVALID"), F.col("one") == F.col("back")
    winner = F.when(bad, "INVALID").when(~same, "TIE").otherwise(F.col("one"))
    source = F.when(bad, "none").when(~same, "POSITION_FLIP").when(F.col("one") == "TIE", "JUDGE_EMITTED").otherwise("none")
    c = F.when(~bad & ~same, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), (F.col("c1") + F.col("c2")) / 2)))
    seat = lambda col, won, lost: F.sum(F.when(F.col(col) == won, 1.0).when(F.col(col) == lost, 0.0).otherwise(0.5))
    return t.groupBy(winner.alias("winner"), source.alias("source")).agg(
        F.count("*").alias("n"), F.round(F.sum(c), 4).alias("conf"), seat("one", "Model A", "Model B").alias("win_a_first"), seat("two", "Model B", "Model A").alias("win_a_second"))


@register("prj11_confidence_gate", _sql("SELECT CASE WHEN conf < 0.7 AND NOT roll = 3 THEN 'TIE' ELSE verdict END AS gated, count(*) AS n FROM vd GROUP BY 1", EVAL + _BOTH))
def prj11(spark, sf):
    g = F.when((F.col("conf") < 0.7) & (F.col("roll") != 3), "TIE").otherwise(F.col("verdict"))
    return verdicts(spark, sf).groupBy(g.alias("gated")).agg(F.count("*").alias("n"))
