"""Nearest-centroid routing over the embedded queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.functions.vectors import centroids, unit
from canopyrank.plans.registry import register
from canopyrank.session import table


@register(
    "entry_routing",
    """
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM q),
 p AS (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM u),
 m AS (SELECT label, i, sum(x) AS s FROM p GROUP BY ALL),
 n AS (SELECT label, i, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS s FROM m),
 c AS (SELECT label AS c_label, list(s ORDER BY i) AS mu FROM n GROUP BY label),
 r AS (SELECT vec_id, label, c_label, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, mu), 9) DESC, c_label) AS k FROM u, c)
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(CASE WHEN label = c_label THEN 1 ELSE 0 END) AS BIGINT) AS hits,
 round(avg(CASE WHEN label = c_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
FROM r WHERE k = 1 GROUP BY label
""",
)
def entry_routing(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(F.col("embedding")).alias("v"))
    c = centroids(q, "label", "v").select(F.col("label").alias("c_label"), "mu")
    # one array of all labels' directions: as many as the taxonomy has categories
    m = c.agg(F.collect_list(F.struct("c_label", "mu")).alias("m"))
    score = lambda x: F.round(F.aggregate(F.zip_with(F.col("v"), x["mu"], lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y), 9)
    best = F.array_max(F.transform("m", lambda x: F.struct(score(x).alias("s"), (-x["c_label"]).alias("neg"))))
    best = q.crossJoin(F.broadcast(m)).select("label", best.alias("b"))
    hit = (F.col("label") == -F.col("b.neg")).cast("long")
    return best.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy")
    )
