"""Scalar functions, applied to columns of the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from canopyrank.functions import scalars as S
from canopyrank.functions.vectors import cosine, dot, norm, unit
from canopyrank.plans.base import VEC, r6, vectors
from canopyrank.plans.registry import register
from canopyrank.session import table

_V = f"WITH {VEC} "


@register("prj01_slice_unit", _V + "SELECT vec_id, round(sqrt(list_dot_product(s, s)), 6) AS length, round(s[1] / sqrt(list_dot_product(s, s)), 6) AS first FROM (SELECT vec_id, v0[1:16] AS s FROM q)")
def prj01(spark, sf):
    e = table(spark, sf, "embeddings")
    raw = F.slice(F.col("embedding").cast("array<double>"), 1, 16)
    return e.select("vec_id", r6(norm(raw)).alias("length"), r6(unit("embedding", 16)[0]).alias("first"))


@register("prj04_normalise_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def prj04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.normalise_text(F.col("text"))).alias("h"))


# every subject, some names that are no subject, in mixed case and with white space around
_SUBJECT = "(SELECT p_partkey, CASE WHEN i < n THEN s[CAST(i + 1 AS BIGINT)] ELSE p_brand END AS s FROM (SELECT p_partkey, p_brand, p_partkey % 60 AS i, {names} AS s, {n} AS n FROM part))"


@register("prj05_normalise_category", "SELECT p_partkey, coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.SUBJECTS.items()) + "}[lower(trim(s))], lower(trim(s))) AS category FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(s) || ' ' ELSE s END AS s FROM " + _SUBJECT.format(names=str(list(S.SUBJECTS)), n=len(S.SUBJECTS)) + ")")
def prj05(spark, sf):
    names = F.array(*[F.lit(k) for k in S.SUBJECTS])
    i = F.col("p_partkey") % 60
    raw = F.when(i < len(S.SUBJECTS), F.get(names, i.cast("int"))).otherwise(F.col("p_brand"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper(raw), F.lit(" "))).otherwise(raw)
    return table(spark, sf, "part").select("p_partkey", S.normalise_category(raw).alias("category"))


@register("prj06_pretty_category", "SELECT c_custkey, array_to_string(list_transform(string_split_regex(lower(c_mktsegment) || '_of-the_sea', '[_-]'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS pretty FROM customer")
def prj06(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.pretty_category(F.concat(F.lower("c_mktsegment"), F.lit("_of-the_sea"))).alias("pretty"))


@register("prj07_model_of_file", "SELECT s_suppkey, 'M' || (s_suppkey % 6) AS model FROM supplier")
def prj07(spark, sf):
    m = F.concat(F.lit("M"), (F.col("s_suppkey") % 6).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", S.model_of_file(F.concat(F.lit("model_outputs_"), m, F.lit("_5shots.json.zip"))).alias("model"))


@register("prj08_answer_trace", "SELECT l_orderkey, l_linenumber, count(*) AS n, max(CASE WHEN l_returnflag = 'A' THEN 'out' WHEN l_linenumber <= 4 THEN 'selected option ' || ['w', 'x', 'y', 'z'][l_linenumber] ELSE 'predicted' END) AS trace FROM lineitem GROUP BY ALL")
def prj08(spark, sf):
    opts = F.array(*[F.lit(x) for x in "wxyz"])
    t = F.when(F.col("l_returnflag") == "A", "out").when(F.col("l_linenumber") <= 4, F.concat(F.lit("selected option "), F.get(opts, F.col("l_linenumber") - 1))).otherwise("predicted")
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max(t).alias("trace"))


@register("prj09_text_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents")
def prj09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.text_hash(F.col("text")).alias("h"))


@register("prj12_options_block", "SELECT p_partkey, 'A) ' || p_brand || chr(10) || 'B) ' || p_type AS block FROM part")
def prj12(spark, sf):
    o = F.array("p_brand", "p_type")
    line = F.transform(o, lambda x, i: F.concat(F.char((i + 65).cast("long")), F.lit(") "), x))
    return table(spark, sf, "part").select("p_partkey", F.array_join(line, "\n").alias("block"))


@register("prj14_domain_anchors", "SELECT p_type, string_agg(p_brand, ', ' ORDER BY k) AS anchors FROM (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS k FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE k <= 2 GROUP BY p_type")
def prj14(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    top = n.groupBy("p_type").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "p_brand"))), 1, 2).alias("t"))
    return top.select("p_type", F.array_join(F.transform("t", lambda x: x["p_brand"]), ", ").alias("anchors"))


@register("prj16_hold_out", "SELECT p_partkey FROM part WHERE p_partkey * 31 % 5 <> 0")
def prj16(spark, sf):
    return table(spark, sf, "part").filter(F.pmod(F.col("p_partkey") * 31, F.lit(5)) != 0).select("p_partkey")


@register("prj17_train_test_split", "SELECT p_partkey, p_brand, k <= least(CAST(floor(n * 0.7::DOUBLE + 0.5) AS BIGINT), n - 1) AS train FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || ':42'), p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def prj17(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("p_brand")
    k = F.row_number().over(w.orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":42"))), "p_partkey"))
    n = F.count("*").over(w)
    return table(spark, sf, "part").select("p_partkey", "p_brand", (k <= F.least(F.floor(n * F.lit(0.7) + 0.5), n - 1)).alias("train"))


_PAIR = "SELECT x.vec_id AS a, y.vec_id AS b, x.v AS va, y.v AS vb FROM q x JOIN q y ON x.label = y.label AND x.vec_id < y.vec_id AND y.vec_id - x.vec_id < 40"


def _pairs(spark, sf):
    v = vectors(spark, sf)
    x, y = v.alias("x"), v.alias("y")
    gap = F.col("y.vec_id") - F.col("x.vec_id")
    return x.join(y, (F.col("x.label") == F.col("y.label")) & (gap > 0) & (gap < 40)).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), F.col("x.v").alias("va"), F.col("y.v").alias("vb"))


@register("fn01_dot_product", _V + f"SELECT a, b, round(list_dot_product(va, vb), 6) AS dot FROM ({_PAIR})")
def fn01(spark, sf):
    return _pairs(spark, sf).select("a", "b", r6(dot("va", "vb")).alias("dot"))


@register("fn02_cosine", _V + f"SELECT a, b, round(list_cosine_similarity(va, vb), 6) AS cos FROM ({_PAIR})")
def fn02(spark, sf):
    return _pairs(spark, sf).select("a", "b", r6(cosine("va", "vb")).alias("cos"))


@register("fn03_cosine_distance", _V + f"SELECT a, b, round(1 - list_cosine_similarity(va, vb), 6) AS dist FROM ({_PAIR})")
def fn03(spark, sf):
    return _pairs(spark, sf).select("a", "b", r6(1 - cosine("va", "vb")).alias("dist"))


@register("fn04_log_gamma", "SELECT p_partkey, round(lgamma(p_size + 0.5::DOUBLE), 6) AS g FROM part")
def fn04(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(S.log_gamma(F.col("p_size") + F.lit(0.5)), 6).alias("g"))


_BES = "(o * (sqrt(1 + z * z) + ln(z / (1 + sqrt(1 + z * z)))) - 0.5::DOUBLE * ln(2 * pi() * o * sqrt(1 + z * z)))"


@register("fn05_log_bessel", f"SELECT p_partkey, round({_BES}, 6) AS b FROM (SELECT p_partkey, 31.0::DOUBLE AS o, p_size / 31.0::DOUBLE AS z FROM part)")
def fn05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(S.log_bessel(F.lit(31.0), F.col("p_size").cast("double")), 6).alias("b"))


@register("fn06_log_vmf_normalizer", f"SELECT p_partkey, round(o * ln(k) - 32 * ln(2 * pi()) - {_BES}, 6) AS c FROM (SELECT p_partkey, 31.0::DOUBLE AS o, p_size::DOUBLE AS k, p_size / 31.0::DOUBLE AS z FROM part)")
def fn06(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(S.log_vmf_normalizer(F.lit(64.0), F.col("p_size").cast("double")), 6).alias("c"))


@register("fn07_bessel_ratio", "SELECT p_partkey, round(k / (31.5::DOUBLE + sqrt(32.5::DOUBLE * 32.5 + k * k)), 6) AS a FROM (SELECT p_partkey, p_size::DOUBLE AS k FROM part)")
def fn07(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(S.bessel_ratio(F.lit(64.0), F.col("p_size").cast("double"))).alias("a"))


@register("fn10_log_volume", _V + "SELECT vec_id, round(list_sum(list_transform(v, lambda x: ln(greatest(abs(x), 1e-9::DOUBLE)))), 5) AS vol FROM q")
def fn10(spark, sf):
    logs = F.transform("v", lambda x: F.ln(F.greatest(F.abs(x), F.lit(1e-9))))
    return vectors(spark, sf).select("vec_id", (F.round(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)).alias("vol"))


@register("fn11_log_sum_exp", _V + "SELECT vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS l FROM q")
def fn11(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(S.log_sum_exp(F.col("v"))).alias("l"))


def _poly(terms, t):
    s = "0.0::DOUBLE"
    for c in reversed(terms):
        s = f"(({s} + ({c!r}::DOUBLE)) * {t})"
    return s


@register("fn12_normal_cdf", f"SELECT p_partkey, round(0.5::DOUBLE * (1 + sign(y) * (1 - {_poly(S.ERF, 't')} * exp(-y * y))), 6) AS p FROM (SELECT p_partkey, y, 1 / (1 + {S.ERF_P}::DOUBLE * abs(y)) AS t FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE / sqrt(2.0::DOUBLE) AS y FROM part))")
def fn12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(S.normal_cdf((F.col("p_size") - 25) / F.lit(10.0))).alias("p"))


@register("fn13_normal_cdf_tail", f"SELECT p_partkey, round(CASE WHEN x < 0 THEN 1 - u ELSE u END, 6) AS p FROM (SELECT p_partkey, x, 1 - exp(-0.5::DOUBLE * x * x) / sqrt(2 * pi()) * {_poly(S.CDF, 't')} AS u FROM (SELECT p_partkey, x, 1 / (1 + {S.CDF_P}::DOUBLE * abs(x)) AS t FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS x FROM part)))")
def fn13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(S.normal_cdf_tail((F.col("p_size") - 25) / F.lit(10.0))).alias("p"))


@register("fn14_chi_square_p", f"SELECT p_partkey, round(2 * (exp(-0.5::DOUBLE * x * x) / sqrt(2 * pi()) * {_poly(S.CDF, 't')}), 6) AS p FROM (SELECT p_partkey, x, 1 / (1 + {S.CDF_P}::DOUBLE * x) AS t FROM (SELECT p_partkey, sqrt(p_size / 5.0::DOUBLE) AS x FROM part))")
def fn14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(S.chi_square_p(F.col("p_size") / F.lit(5.0))).alias("p"))


@register("fn15_entropy", "SELECT p_type, round(-sum(p * ln(p)), 6) AS nats, round(-sum(p * log2(p)), 6) AS bits, round(-sum(p * ln(p)), 6) / round(ln(count(*)), 6) > 0.95 AS near_uniform FROM (SELECT p_type, n / sum(n) OVER (PARTITION BY p_type)::DOUBLE AS p FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) GROUP BY p_type")
def fn15(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").cast("double").alias("n")).groupBy("p_type").agg(F.array_sort(F.collect_list("n")).alias("n"), F.sum("n").alias("t"))
    h = S.entropy(F.transform("n", lambda x: x / F.col("t")))
    return n.select("p_type", r6(h).alias("nats"), r6(h / math.log(2)).alias("bits"), (r6(h) / r6(F.ln(F.size("n"))) > 0.95).alias("near_uniform"))


# texts of the table with every form put in front of them, behind them or not at all
_LETTER_TEXT = """(SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN t || ' So the answer is ' || lower(l) || '.' WHEN 1 THEN 'The correct option is ' || l || chr(10) || t WHEN 2 THEN t || chr(10) || '  **' || l || '** because A is wrong'
 WHEN 3 THEN '(' || l || ') because A is wrong. ' || t WHEN 4 THEN t || ' Answer: ' || l || '!' WHEN 5 THEN t || ' I take ' || l || ' over it' WHEN 6 THEN t || ' the answer is unclear' ELSE t END AS t
 FROM (SELECT conv_id, turn, coalesce(text, '') AS t, chr(CAST(65 + conv_id % 10 AS INTEGER)) AS l FROM conversations))"""


@register("fn17_answer_letter", rf"SELECT conv_id, turn, coalesce(nullif(upper(regexp_extract(t, '{S.LETTER_BY_PHRASE}', 1)), ''), nullif(upper(regexp_extract(t, '{S.LETTER_BY_LINE}', 1)), ''), regexp_extract_all(right(t, 100), '{S.LETTER_ALONE}', 1)[-1], '?') AS letter FROM {_LETTER_TEXT}")
def fn17(spark, sf):
    t, l, n = F.coalesce("text", F.lit("")), F.char((F.col("conv_id") % 10 + 65).cast("long")), F.col("turn") % 8
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    whole = (
        F.when(n == 0, c(t, " So the answer is ", F.lower(l), ".")).when(n == 1, c("The correct option is ", l, "\n", t)).when(n == 2, c(t, "\n  **", l, "** because A is wrong"))
        .when(n == 3, c("(", l, ") because A is wrong. ", t)).when(n == 4, c(t, " Answer: ", l, "!")).when(n == 5, c(t, " I take ", l, " over it")).when(n == 6, c(t, " the answer is unclear")).otherwise(t)
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", S.answer_letter(whole).alias("letter"))


@register("fn18_bracket_verdict", r"SELECT conv_id, turn, coalesce(MAP {'A': 'Model A', 'B': 'Model B', 'C': 'TIE'}[regexp_extract_all(t, '\[\[([ABC])\]\]', 1)[-1]], 'INVALID') AS winner FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[[A]] ' || t || ' [[B]]' WHEN 1 THEN t || '[[C]]' WHEN 2 THEN 'y[[A]]z' || t ELSE '[A] ' || t || ' [[D]]' END AS t FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))".replace("\\\\", "\\"))
def fn18(spark, sf):
    t, n = F.coalesce("text", F.lit("")), F.col("turn") % 4
    whole = F.when(n == 0, F.concat(F.lit("[[A]] "), t, F.lit(" [[B]]"))).when(n == 1, F.concat(t, F.lit("[[C]]"))).when(n == 2, F.concat(F.lit("y[[A]]z"), t)).otherwise(F.concat(F.lit("[A] "), t, F.lit(" [[D]]")))
    return table(spark, sf, "conversations").select("conv_id", "turn", S.bracket_verdict(whole).alias("winner"))


# escapes, whole and broken, before, behind or around the texts of the table
_ESCAPE_TEXT = r"""(SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN t || ' \alpha' WHEN 1 THEN '\\alpha \\\beta' || t WHEN 2 THEN '\u00e9 \u12 ' || t || '\' WHEN 3 THEN '\"\n' || t || '\\' WHEN 4 THEN '\/\q\u00E' || t ELSE t END AS t
 FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))"""


@register("fn19_escape_repair", rf"""SELECT conv_id, turn, md5(replace(replace(replace(regexp_replace(replace(t, '\\', chr(2)), '\\(["/bfnrt]|u[0-9A-Fa-f]{{4}})', chr(1) || '\1', 'g'), '\', '\\'), chr(1), '\'), chr(2), '\\')) AS h FROM {_ESCAPE_TEXT}""")
def fn19(spark, sf):
    t, n = F.coalesce("text", F.lit("")), F.col("turn") % 6
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    whole = (
        F.when(n == 0, c(t, " \\alpha")).when(n == 1, c("\\\\alpha \\\\\\beta", t)).when(n == 2, c("\\u00e9 \\u12 ", t, "\\"))
        .when(n == 3, c('\\"\\n', t, "\\\\")).when(n == 4, c("\\/\\q\\u00E", t)).otherwise(t)
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(S.repair_escapes(whole)).alias("h"))


@register("fn20_judge_json", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Model A' WHEN 1 THEN 'TIE' ELSE 'Model B' END AS winner, CASE turn % 3 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM conversations")
def fn20(spark, sf):
    t = F.when(F.col("turn") % 3 == 0, '```json\n{"winner": "model a", "confidence": 0.75, "why": "\\alpha"}\n```').when(F.col("turn") % 3 == 1, 'Sure: {"winner": "draw"} ok').otherwise('broken "winner": "B", "confidence": 3')
    return table(spark, sf, "conversations").select("conv_id", "turn", S.judge_json(t).alias("j")).select("conv_id", "turn", "j.winner", "j.confidence")


@register("fn21_strip_fence", "SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS h FROM documents")
def fn21(spark, sf):
    t = F.concat(F.lit("```text\n"), F.regexp_replace("text", r"^[ \n]+|[ \n]+$", ""), F.lit("\n```"))
    return table(spark, sf, "documents").select("doc_id", F.md5(S.strip_fence(t)).alias("h"))


@register("fn22_query_key", "SELECT doc_id, doc_id AS id, substr(sha256(text), 1, 8) AS h FROM documents")
def fn22(spark, sf):
    k = F.concat(F.col("doc_id").cast("string"), F.lit("::"), "text")
    d = table(spark, sf, "documents").select("doc_id", k.alias("k"), "text")
    return d.select("doc_id", F.split_part("k", F.lit("::"), F.lit(1)).try_cast("bigint").alias("id"), F.substring(F.sha2(F.expr("substring(k, instr(k, '::') + 2)"), 256), 1, 8).alias("h"))


@register("fn24_config_hash", "SELECT p_brand, sha256(string_agg(p_partkey || '=' || p_size, ';' ORDER BY p_partkey)) AS h FROM part GROUP BY p_brand")
def fn24(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", "p_size")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["p_partkey"].cast("string"), F.lit("="), x["p_size"].cast("string"))), ";")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.sha2(text, 256).alias("h"))


@register("fn25_prior_blend", "SELECT p_partkey, round(CASE WHEN 64.0::DOUBLE / p_size <= 2 THEN 0 WHEN 64.0::DOUBLE / p_size >= 10 THEN 1 ELSE (64.0::DOUBLE / p_size - 2) / 8 END, 6) AS alpha FROM part")
def fn25(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(S.prior_blend(F.col("p_size"), F.lit(64.0))).alias("alpha"))


@register("fn26_hoeffding", "SELECT p_partkey, round(sqrt(ln(2 * 15 * 100 / 0.05::DOUBLE) / (2 * p_size)), 6) AS r FROM part")
def fn26(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(S.hoeffding_radius(F.lit(15), F.lit(100), F.col("p_size"))).alias("r"))


@register("fn27_match_quality", "SELECT p_partkey, round(exp(-(p_size - 25.0::DOUBLE) * (p_size - 25) / (2 * 70)) * sqrt(2 * 16.0::DOUBLE / 70), 6) AS quality FROM part")
def fn27(spark, sf):
    d = F.col("p_size") - F.lit(25.0)
    return table(spark, sf, "part").select("p_partkey", r6(F.exp(-d * d / 140) * F.sqrt(F.lit(32.0 / 70))).alias("quality"))


@register("sta10_wilson", "SELECT category, n, round((p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n), 6) AS lo, round((p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n), 6) AS hi FROM (SELECT p_brand AS category, count(*) AS n, count(*) FILTER (WHERE p_size < 20) / count(*)::DOUBLE AS p FROM part GROUP BY 1)")
def sta10(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") < 20).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("category", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))
