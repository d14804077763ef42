"""Records of matches, pools of ratings, stopping, intervals, gates, stores and lookups of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.functions import scalars as S
from canopyrank.operators import ratings as R
from canopyrank.plans.base import EVAL, MATCH, evals, matches, r6
from canopyrank.plans.evaluation import _BOTH, _ROUND, pair_stats, rounds, verdicts
from canopyrank.plans.registry import register
from canopyrank.session import table
from canopyrank.sources import store
from canopyrank.storage import shared_dir

# match records: a tenth of the events come again with the outcome turned round, a fifteenth unchanged

_LOG = MATCH + """, lg AS (SELECT event_id AS id, 0 AS seq, domain, a, b, wa - wb AS outcome FROM mt UNION ALL SELECT event_id, 1, domain, a, b, wb - wa FROM mt WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 2, domain, a, b, wa - wb FROM mt WHERE event_id % 15 = 0)"""


def match_log(spark, sf) -> DataFrame:
    """id, seq, domain, a, b, outcome: repeats of an id stand at a later seq."""
    m = matches(spark, sf).select(F.col("event_id").alias("id"), F.lit(0).alias("seq"), "domain", "a", "b", (F.col("wa") - F.col("wb")).alias("outcome"))
    return m.unionByName(m.filter("id % 10 = 0").withColumns({"seq": F.lit(1), "outcome": -F.col("outcome") + F.lit(0.0)})).unionByName(m.filter("id % 15 = 0").withColumn("seq", F.lit(2)))


@register("rat05_record_match", f"WITH {_LOG} SELECT id, seq, CASE WHEN prev IS NULL THEN 'insert' WHEN prev <> outcome THEN 'update' ELSE 'ignore' END AS action FROM (SELECT *, lag(outcome) OVER (PARTITION BY id ORDER BY seq) AS prev FROM lg)")
def rat05(spark, sf):
    """What each record does: the first of an id is inserted, another outcome updates it, an equal one is ignored."""
    prev = F.lag("outcome").over(W.partitionBy("id").orderBy("seq"))
    return match_log(spark, sf).select("id", "seq", F.when(prev.isNull(), "insert").when(prev != F.col("outcome"), "update").otherwise("ignore").alias("action"))


@register("snk06_match_upsert", f"WITH {_LOG} SELECT id, domain, outcome + 0.0::DOUBLE AS outcome FROM lg QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def snk06(spark, sf):
    """The log's state: the latest outcome of every id, met on the map side."""
    return match_log(spark, sf).groupBy("id").agg(F.max_by(F.struct("domain", "outcome"), "seq").alias("x")).select("id", "x.domain", (F.col("x.outcome") + F.lit(0.0)).alias("outcome"))


@register("hlp06_match_reads", f"WITH {MATCH} SELECT event_id || '::' || domain AS key, CASE WHEN tie = 1 THEN 'TIE' WHEN wa = 1 THEN a ELSE b END AS winner FROM mt")
def hlp06(spark, sf):
    winner = F.when(F.col("tie") == 1, "TIE").when(F.col("wa") == 1, F.col("a")).otherwise(F.col("b"))
    return matches(spark, sf).select(F.concat(F.col("event_id").cast("string"), F.lit("::"), "domain").alias("key"), winner.alias("winner"))


@register("rat17_global_stop", f"WITH {MATCH}, {_ROUND}, st AS (SELECT round, domain, n, min(w) OVER k = max(w) OVER k AND count(*) OVER k = 2 AS stable, row_number() OVER (PARTITION BY domain ORDER BY round DESC) AS back FROM rd WINDOW k AS (PARTITION BY domain ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)), t AS (SELECT domain, sum(n) AS n, coalesce(bool_or(stable) FILTER (WHERE back <= 5), false) AS stable FROM st GROUP BY domain) SELECT CAST(count(*) AS BIGINT) AS leaves, CAST(count(*) FILTER (WHERE stable) AS BIGINT) AS settled, round(coalesce(sum(n) FILTER (WHERE stable), 0) / sum(n)::DOUBLE, 6) AS share, coalesce(sum(n) FILTER (WHERE stable), 0) / sum(n)::DOUBLE >= 0.65 AS stop FROM t")
def rat17(spark, sf):
    """Stop once leaves with 65 % of the comparisons have been stable (here: two rounds alike among the last five)."""
    by = W.partitionBy("domain").orderBy("round")
    k = by.rowsBetween(-1, 0)
    stable = (F.min("w").over(k) == F.max("w").over(k)) & (F.count("*").over(k) == 2)
    st = rounds(spark, sf).select("domain", "n", stable.alias("stable"), F.row_number().over(W.partitionBy("domain").orderBy(F.desc("round"))).alias("back"))
    t = st.groupBy("domain").agg(F.sum("n").alias("n"), F.coalesce(F.bool_or(F.col("stable") & (F.col("back") <= 5)), F.lit(False)).alias("stable"))
    share = F.sum(F.when(F.col("stable"), F.col("n")).otherwise(0)) / F.sum("n")
    return t.agg(F.count("*").alias("leaves"), F.count_if("stable").alias("settled"), r6(share).alias("share"), (share >= 0.65).alias("stop"))


# pools of categories with enough comparisons, of which no pair disagrees with the truth

_POOL = EVAL + _BOTH + """, cs AS (SELECT category, a, b, sum((verdict = 'A')::INT)::DOUBLE AS wins_a, sum((verdict = 'B')::INT)::DOUBLE AS wins_b, sum((verdict = 'TIE')::INT)::DOUBLE AS ties, count(*) AS n, sum((ca <> cb)::INT) AS checks, sum(((verdict = 'A' AND ca AND NOT cb) OR (verdict = 'B' AND cb AND NOT ca))::INT) AS agree FROM vd GROUP BY ALL),
 el AS (SELECT category FROM cs GROUP BY category HAVING sum(n) >= 5 AND NOT bool_or(checks >= 5 AND agree < 0.2::DOUBLE * checks)),
 ps AS (SELECT 'pooled' AS domain, a, b, sum(wins_a) AS wins_a, sum(wins_b) AS wins_b, sum(ties) AS ties, sum(n) AS n FROM cs JOIN el USING (category) GROUP BY a, b)"""
AGREE = 0.2  # the rule's default is 0.5, which the made-up verdicts of no category reach


def eligible_stats(spark, sf) -> DataFrame:
    """domain (pooled), a, b, wins_a, wins_b, ties, n over the eligible categories."""
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    v = F.col("verdict")
    right = ((v == "A") & F.col("ca") & ~F.col("cb")) | ((v == "B") & F.col("cb") & ~F.col("ca"))
    cs = verdicts(spark, sf).groupBy("category", "a", "b").agg(
        one(v == "A").alias("wins_a"), one(v == "B").alias("wins_b"), one(v == "TIE").alias("ties"), F.count("*").alias("n"), F.count_if(F.col("ca") != F.col("cb")).alias("checks"), F.count_if(right).alias("agree"))
    ok = cs.groupBy("category").agg(F.sum("n").alias("m"), F.bool_or((F.col("checks") >= 5) & (F.col("agree") < AGREE * F.col("checks"))).alias("bad")).filter("m >= 5 AND NOT bad")
    pool = cs.join(ok.select("category"), "category").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("wins_a", "wins_b", "ties", "n")])
    return pool.withColumn("domain", F.lit("pooled"))


@register("sta05_canonical_pool", f"WITH {_POOL} SELECT a, b, wins_a, wins_b, ties, CAST(n AS BIGINT) AS n FROM ps")
def sta05(spark, sf):
    return eligible_stats(spark, sf).select("a", "b", "wins_a", "wins_b", "ties", "n")


_FIT = """, wm AS (SELECT a AS i, b AS j, wins_a + ties / 2 AS w, n::DOUBLE AS n FROM ps UNION ALL SELECT b, a, wins_b + ties / 2, n::DOUBLE FROM ps), tw AS (SELECT i, sum(w) AS w FROM wm GROUP BY i),
 bt AS (SELECT i, 0.0::DOUBLE AS s, 0 AS it FROM tw UNION ALL SELECT i, x - avg(x) OVER (), it + 1 FROM (SELECT u.i, u.it, CASE WHEN max(tw.w) > 0 THEN ln(max(tw.w) / sum(wm.n / (exp(u.s) + exp(v.s)))) ELSE max(u.s) END AS x FROM bt u JOIN wm ON wm.i = u.i JOIN bt v ON v.i = wm.j JOIN tw ON tw.i = u.i WHERE u.it < 30 GROUP BY u.i, u.it))"""


@register("sta05_canonical_scores", f"WITH RECURSIVE {_POOL}{_FIT} SELECT i AS model, round(s, 6) AS score FROM bt WHERE it = 30")
def sta05_scores(spark, sf):
    return R.fit_pairs(eligible_stats(spark, sf), "domain", rounds=30).select("model", r6(F.col("score")).alias("score"))


@register("sta06_bootstrap_interval", f"WITH {EVAL}, m AS (SELECT category AS k, row_number() OVER (PARTITION BY category ORDER BY model_name) - 1 AS i, count(*) OVER (PARTITION BY category) AS n, avg(is_correct::INT::DOUBLE) AS x FROM er GROUP BY category, model_name), d AS (SELECT k, r, ('0x' || substr(md5(k || ':' || r || ':' || i), 1, 8))::BIGINT % n AS i FROM m, range(2000) t(r)), s AS (SELECT d.k, r, round(avg(x), 9) AS v FROM d JOIN m ON m.k = d.k AND m.i = d.i GROUP BY d.k, r), o AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS p FROM s) SELECT k, round(max(CASE WHEN p = 50 THEN v END), 6) AS lo, round(max(CASE WHEN p = 1949 THEN v END), 6) AS hi FROM o GROUP BY k")
def sta06(spark, sf):
    """Bounds of a category's mean accuracy over 2000 resamples of its models, drawn by hash; a group has as many rows as there are models."""
    by = W.partitionBy("k")
    g = evals(spark, sf).groupBy(F.col("category").alias("k"), "model_name").agg(F.avg(F.col("is_correct").cast("int").cast("double")).alias("x"))
    m = g.select("k", "x", (F.row_number().over(by.orderBy("model_name")) - 1).cast("long").alias("i"), F.count("*").over(by).alias("n"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "k", F.col("r").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    d = m.select("k", "n", "i", F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("r")).select("k", "r", draw.alias("i"))
    s = d.join(F.broadcast(m.select("k", "i", "x")), ["k", "i"]).groupBy("k", "r").agg(F.round(F.avg("x"), 9).alias("v"))
    v = s.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"))  # 2000 numbers
    return v.select("k", r6(F.get("v", F.lit(50))).alias("lo"), r6(F.get("v", F.lit(1949))).alias("hi"))


@register("sta12_report", f"WITH {EVAL}, m AS (SELECT category AS k, model_name, avg(is_correct::INT::DOUBLE) AS x, count(*) AS n FROM er GROUP BY ALL) SELECT k, count(*) AS models, CAST(sum(n) AS BIGINT) AS answers, round(avg(x), 6) AS mean, round(max(x) - min(x), 6) AS spread, arg_max(model_name, (round(x, 9) * 1000000000)::BIGINT * 100 - ascii(substr(model_name, 2, 1))) AS best FROM m GROUP BY k")
def sta12(spark, sf):
    """A line for each domain: models, answers, mean and spread of accuracy, and the best model (the first by name at a tie)."""
    m = evals(spark, sf).groupBy(F.col("category").alias("k"), "model_name").agg(F.avg(F.col("is_correct").cast("int").cast("double")).alias("x"), F.count("*").alias("n"))
    best = F.min_by("model_name", F.struct((-F.round("x", 9)).alias("a"), "model_name"))
    return m.groupBy("k").agg(F.count("*").alias("models"), F.sum("n").alias("answers"), r6(F.avg("x")).alias("mean"), r6(F.max("x") - F.min("x")).alias("spread"), best.alias("best"))


@register("tun03_soft_gates", "SELECT s_suppkey, s_acctbal BETWEEN 1000 AND 8000 AND s_nationkey >= 5 AS passes, concat_ws(';', CASE WHEN NOT s_acctbal BETWEEN 1000 AND 8000 THEN 'balance outside band' END, CASE WHEN s_nationkey < 5 THEN 'nation below' END) AS reasons FROM supplier")
def tun03(spark, sf):
    bad = [F.when(~F.col("s_acctbal").between(1000, 8000), "balance outside band"), F.when(F.col("s_nationkey") < 5, "nation below")]
    reasons = F.concat_ws(";", *bad)
    return table(spark, sf, "supplier").select("s_suppkey", (reasons == "").alias("passes"), reasons.alias("reasons"))


# stores


def _root(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/canopyrank/{name}-{uuid.uuid4().hex}"


@register("snk04_pair_stats_store", f"WITH {MATCH} SELECT domain, a, b, wins_a, wins_b, ties, n FROM ps")
def snk04(spark, sf):
    """Half the statistics with wrong counts, then all of them: the later rows take the place of the earlier ones."""
    s, root = pair_stats(matches(spark, sf)), _root(spark, "pair_stats")
    store.upsert(s.filter("a = 'M0'").withColumn("ties", F.lit(-1.0)), root, ["domain", "a", "b"])
    store.upsert(s, root, ["domain", "a", "b"])
    return store.read(spark, root).select("domain", "a", "b", "wins_a", "wins_b", "ties", "n")


@register("snk05_rating_state_store", f"WITH {MATCH}, w AS (SELECT domain, m, round(sum(x), 4) AS score FROM (SELECT domain, a AS m, wins_a + ties / 2 AS x FROM ps UNION ALL SELECT domain, b, wins_b + ties / 2 FROM ps) GROUP BY ALL) SELECT domain, m AS model, score FROM w")
def snk05(spark, sf):
    """Scores by model as one map for each domain, stored and read back."""
    p = pair_stats(matches(spark, sf))
    side = lambda m, w: p.select("domain", F.col(m).alias("m"), (F.col(w) + F.col("ties") / 2).alias("x"))
    s = side("a", "wins_a").union(side("b", "wins_b")).groupBy("domain", "m").agg(F.round(F.sum("x"), 4).alias("score"))
    state = s.groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "score")))).alias("scores"))
    root = _root(spark, "states")
    store.upsert(state, root, ["domain"])
    return store.read(spark, root).select("domain", F.explode("scores").alias("model", "score"))


@register("snk07_query_offsets", "SELECT event_type AS node, max(event_id) AS next FROM events GROUP BY event_type")
def snk07(spark, sf):
    """Offsets of a scheduler: saved at half of the log, and again at its end."""
    e, root = table(spark, sf, "events"), _root(spark, "offsets")
    at = lambda rows: rows.groupBy(F.col("event_type").alias("node")).agg(F.max("event_id").alias("next"))
    store.upsert(at(e.filter("event_id % 2 = 0")), root, ["node"])
    store.upsert(at(e), root, ["node"])
    return store.read(spark, root).select("node", "next")


@register("snk08_benchmark_metadata", "SELECT 'model' AS key, CAST(count(DISTINCT l_suppkey % 6) AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'questions', CAST(count(*) AS VARCHAR) FROM part")
def snk08(spark, sf):
    n = table(spark, sf, "lineitem").agg(F.countDistinct(F.col("l_suppkey") % 6).alias("n")).select(F.lit("model").alias("key"), F.col("n").cast("string").alias("value"))
    q = table(spark, sf, "part").agg(F.count("*").cast("string").alias("value")).select(F.lit("questions").alias("key"), "value")
    root = _root(spark, "metadata")
    store.upsert(n, root, ["key"])
    store.upsert(q, root, ["key"])
    return store.read(spark, root).select("key", "value")


@register("snk09_clear_snapshot", "SELECT event_type AS domain, count(*) AS n FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1")
def snk09(spark, sf):
    """One snapshot for each kind of event; the first is cleared."""
    e, root = table(spark, sf, "events").select(F.col("event_type").alias("snapshot_id"), "event_id"), _root(spark, "snapshots")
    store.write_snapshots(e, root)
    store.clear(spark, root, e.agg(F.min("snapshot_id")).first()[0])
    return store.read(spark, root).groupBy(F.col("snapshot_id").cast("string").alias("domain")).agg(F.count("*").alias("n"))


@register("src09_append_rows", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def src09(spark, sf):
    p, root = table(spark, sf, "part").select("p_partkey", "p_brand"), _root(spark, "dataset")
    for rest in (0, 1):
        p.filter(F.col("p_partkey") % 2 == rest).write.mode("append").parquet(root)
    return store.read(spark, root).groupBy("p_brand").agg(F.count("*").alias("n"))


# lookups


@register("src11_question_category", "SELECT p_name || ' #' || p_partkey AS question, upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS category FROM part")
def src11(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("question"), S.pretty_category(F.lower("p_type")).alias("category"))


@register("src20_embedding_batch", "SELECT d.doc_id, e.vec_id, len(embedding) AS dims FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def src20(spark, sf):
    d, e = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"))
    return d.join(e, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "vec_id", "dims")


@register("src21_missing_embeddings", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def src21(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").distinct()


@register("src24_vector_json", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def src24(spark, sf):
    text = table(spark, sf, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("j"))
    return text.select("vec_id", F.round(F.aggregate(F.from_json("j", "array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register("hlp01_model_results", f"WITH {EVAL} SELECT question_id, pred, is_correct FROM er WHERE model_name = 'M2' AND is_reserved")
def hlp01(spark, sf):
    return evals(spark, sf).filter("model_name = 'M2' AND is_reserved").select("question_id", "pred", "is_correct")


@register("hlp02_options_mapping", "SELECT p_partkey, 2 AS n, p_type AS second FROM part")
def hlp02(spark, sf):
    row = table(spark, sf, "part").select("p_partkey", F.to_json(F.array("p_brand", "p_type")).alias("options"))
    o = F.from_json("options", "array<string>")
    return row.select("p_partkey", F.size(o).alias("n"), F.get(o, F.lit(1)).alias("second"))


@register("hlp05_text_registry", r"SELECT h, min(doc_id) AS doc_id FROM (SELECT md5(coalesce(text, '')) AS h, doc_id FROM documents UNION ALL SELECT md5(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), doc_id FROM documents) GROUP BY h")
def hlp05(spark, sf):
    """Ids by the hash of a text as it is and of its normal form; the smallest id where texts repeat."""
    t = F.coalesce("text", F.lit(""))
    both = F.array(F.md5(t), F.md5(F.regexp_replace(F.lower(t), r"[ \t\n\f\r]+", " ")))
    return table(spark, sf, "documents").select("doc_id", F.explode(both).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@register("hlp09_compare_outputs", f"WITH {EVAL} SELECT x.question_id, x.pred AS one, y.pred AS two, CASE WHEN x.is_correct AND NOT y.is_correct THEN 'Model A' WHEN y.is_correct AND NOT x.is_correct THEN 'Model B' ELSE 'TIE' END AS winner FROM er x JOIN er y USING (question_id) WHERE x.model_name = 'M0' AND y.model_name = 'M5'")
def hlp09(spark, sf):
    e = evals(spark, sf)
    pick = lambda m, n, ok: e.filter(F.col("model_name") == m).select("question_id", F.col("pred").alias(n), F.col("is_correct").alias(ok))
    j = pick("M0", "one", "a").join(pick("M5", "two", "b"), "question_id")
    return j.select("question_id", "one", "two", F.when(F.col("a") & ~F.col("b"), "Model A").when(F.col("b") & ~F.col("a"), "Model B").otherwise("TIE").alias("winner"))


@register("hlp13_cleared_phases", "SELECT p_partkey, p_size & ~6 AS phases FROM part")
def hlp13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").bitwiseAND(F.lit(~6)).alias("phases"))


@register("fn16_near_uniform", "SELECT p_brand, h / ln(k) > 0.95 OR ln(k) - h < 0.05 AS near_uniform FROM (SELECT p_brand, round(-sum(p * ln(p)), 9) AS h, count(*) AS k FROM (SELECT p_brand, n / sum(n) OVER (PARTITION BY p_brand)::DOUBLE AS p FROM (SELECT p_brand, p_size % 7 AS t, count(*) AS n FROM part GROUP BY ALL)) GROUP BY p_brand) WHERE k > 1")
def fn16(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand", F.col("p_size") % 7).agg(F.count("*").cast("double").alias("n")).groupBy("p_brand").agg(F.array_sort(F.collect_list("n")).alias("n"), F.sum("n").alias("t"))
    h, top = F.round(S.entropy(F.transform("n", lambda x: x / F.col("t"))), 9), F.ln(F.size("n"))
    return n.filter(F.size("n") > 1).select("p_brand", ((h / top > 0.95) | (top - h < 0.05)).alias("near_uniform"))


@register("fn23_csv_escape", "SELECT doc_id, md5(CASE WHEN contains(t, ',') OR contains(t, '\"') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def fn23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.csv_escape(F.coalesce("text", F.lit("")))).alias("h"))


@register("prj10_question_ids", "SELECT h, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY text)")
def prj10(spark, sf):
    """Ids in the order in which texts are first seen, counted within ranges and joined by the ranges' totals."""
    f = table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("first")).select(F.coalesce(F.md5("text"), F.lit(None).cast("string")).alias("h"), "first", F.expr("first div 65536").alias("range"))
    size = f.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range of ids
    start = size.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return f.join(start, "range").select("h", (F.row_number().over(W.partitionBy("range").orderBy("first")) - 1 + F.col("start")).alias("id"))
