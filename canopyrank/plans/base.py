"""The model's tables, derived from the driver's parquet, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.functions.vectors import unit
from canopyrank.session import table

EVAL = """er0 AS (SELECT l_partkey AS question_id, 'M' || (l_suppkey % 6) AS model_name, p_brand AS category, p_name AS question,
  chr(CAST(65 + p_size % 4 AS INTEGER)) AS gt,
  CASE WHEN (l_orderkey + l_linenumber) % 10 < 3 + l_suppkey % 6 THEN chr(CAST(65 + p_size % 4 AS INTEGER)) ELSE chr(CAST(65 + (p_size + 1) % 4 AS INTEGER)) END AS pred,
  l_partkey % 10 < 3 AS is_reserved,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey % 6 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_tax, l_discount) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey),
 er AS (SELECT question_id, model_name, category, question, gt, pred, pred = gt AS is_correct, is_reserved FROM er0 WHERE rn = 1)"""

MATCH = """mt AS (SELECT event_id, ts, event_type AS domain, 'M' || (user_id % 6) AS a, 'M' || ((user_id + 1 + event_id % 5) % 6) AS b,
  CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wa, CASE WHEN value < 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wb,
  CASE WHEN value >= 30 AND value <= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tie, value FROM events),
 ps AS (SELECT domain, least(a, b) AS a, greatest(a, b) AS b, sum(CASE WHEN a < b THEN wa ELSE wb END) AS wins_a, sum(CASE WHEN a < b THEN wb ELSE wa END) AS wins_b,
  sum(tie) AS ties, count(*) AS n FROM mt GROUP BY ALL)"""

VEC = """q AS (SELECT vec_id, label, label * 2 + vec_id % 2 AS leaf, v0, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v0 FROM embeddings)),
 qx AS (SELECT vec_id, label, leaf, unnest(range(len(v))) AS i, unnest(v) AS x FROM q)"""

LEAVES = VEC + """,
 lsum AS (SELECT leaf, i, sum(x) AS s, count(*) AS n FROM qx GROUP BY ALL),
 lmu AS (SELECT leaf, any_value(label) AS label, max(n) AS n, list(s / nn ORDER BY i) AS mu FROM (SELECT leaf, CAST(leaf // 2 AS BIGINT) AS label, i, s, n, sqrt(sum(s * s) OVER (PARTITION BY leaf)) AS nn FROM lsum) GROUP BY leaf),
 cosx AS (SELECT vec_id, q.label, q.leaf AS own, m.leaf, m.label AS leaf_label, round(list_dot_product(v, mu), 9) AS c FROM q, lmu m)"""

TREE = """ed AS (SELECT 'root' AS p, 'r' || r_regionkey AS c FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""

DAG = """ed AS (SELECT DISTINCT p, c, kind FROM (SELECT 'root' AS p, 'b' || p_brand AS c, 'TREE' AS kind FROM part UNION ALL SELECT 'root', 't' || p_type, 'TREE' FROM part
  UNION ALL SELECT 'b' || p_brand, 'p' || p_partkey, 'TREE' FROM part UNION ALL SELECT 't' || p_type, 'p' || p_partkey, 'CROSS' FROM part))"""


def letter(c: Column) -> Column:
    return F.char((c % 4 + 65).cast("long"))


def evals(spark, sf_dir) -> DataFrame:
    """question_id, model_name, category, question, gt, pred, is_correct, is_reserved: the first answer of a model to a question."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    m = F.col("l_suppkey") % 6
    right = (F.col("l_orderkey") + F.col("l_linenumber")) % 10 < 3 + m
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_tax", "l_discount")
    # first by a minimum rather than a sort: it is met on the map side
    first = li.groupBy("l_partkey", m.alias("m")).agg(F.min_by(right, order).alias("right"))
    return first.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("question_id"), F.concat(F.lit("M"), F.col("m").cast("string")).alias("model_name"), F.col("p_brand").alias("category"),
        F.col("p_name").alias("question"), letter(F.col("p_size")).alias("gt"), F.when(F.col("right"), letter(F.col("p_size"))).otherwise(letter(F.col("p_size") + 1)).alias("pred"),
        F.col("right").alias("is_correct"), (F.col("l_partkey") % 10 < 3).alias("is_reserved"),
    )


def matches(spark, sf_dir) -> DataFrame:
    """event_id, ts, domain, a, b, wa, wb, tie, value."""
    e = table(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("M"), c.cast("string"))
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    v = F.col("value")
    return e.select(
        "event_id", "ts", F.col("event_type").alias("domain"), name(F.col("user_id") % 6).alias("a"),
        name((F.col("user_id") + 1 + F.col("event_id") % 5) % 6).alias("b"), one(v > 60).alias("wa"), one(v < 30).alias("wb"), one((v >= 30) & (v <= 60)).alias("tie"), "value",
    )


def vectors(spark, sf_dir) -> DataFrame:
    """vec_id, label, leaf, v (unit, double)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("label") * 2 + F.col("vec_id") % 2).alias("leaf"), unit(F.col("embedding")).alias("v"))


def tree_edges(spark, sf_dir) -> DataFrame:
    """p, c of root, regions, nations and suppliers."""
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(F.lit("root").alias("p"), key("r", "r_regionkey").alias("c"))
    n = table(spark, sf_dir, "nation").select(key("r", "n_regionkey"), key("n", "n_nationkey"))
    return r.union(n).union(table(spark, sf_dir, "supplier").select(key("n", "s_nationkey"), key("s", "s_suppkey")))


def dag_edges(spark, sf_dir) -> DataFrame:
    """p, c, kind: parts under their brand (TREE) and their type (CROSS)."""
    t = table(spark, sf_dir, "part")
    b, y, k = F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("t"), "p_type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    rows = [(F.lit("root"), b, "TREE"), (F.lit("root"), y, "TREE"), (b, k, "TREE"), (y, k, "CROSS")]
    out = None
    for p, c, kind in rows:
        one = t.select(p.alias("p"), c.alias("c"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def r6(c) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
