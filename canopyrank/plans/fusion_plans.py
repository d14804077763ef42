"""Fusing categories of the taxonomy, with their leaves and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.operators import fusion as U
from canopyrank.operators import taxonomy as T
from canopyrank.plans.base import r6
from canopyrank.plans.proposal_plans import NODES, queries
from canopyrank.plans.registry import register

# categories five apart become one; a leaf of each also hangs below the other (cross links), and every second category below the one before
_FUSED = NODES + """,
 lb AS (SELECT DISTINCT label FROM q), mp AS (SELECT 'c' || label AS node, 'c' || (label - 5) AS target FROM lb WHERE label >= 5 AND label - 5 IN (SELECT label FROM lb)),
 ed AS (SELECT parent AS p, node AS c, 'TREE' AS kind FROM nd UNION ALL SELECT 'c' || label, 'l' || (label + 5) % 10 * 2, 'CROSS' FROM lb WHERE 'l' || (label + 5) % 10 * 2 IN (SELECT node FROM nd)
  UNION ALL SELECT 'c' || label, 'c' || (label + 1), 'CROSS' FROM lb WHERE label % 2 = 0 AND label < 8 AND label + 1 IN (SELECT label FROM lb)),
 e1 AS (SELECT coalesce(a.target, p) AS p, coalesce(b.target, c) AS c, max(kind = 'TREE') AS tree FROM ed LEFT JOIN mp a ON a.node = p LEFT JOIN mp b ON b.node = c WHERE coalesce(a.target, p) <> coalesce(b.target, c) GROUP BY 1, 2),
 r1 AS (SELECT p AS anc, c AS node FROM e1 UNION SELECT r1.anc, e1.c FROM r1 JOIN e1 ON e1.p = r1.node),
 e2 AS (SELECT * FROM e1 WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.anc = e1.c AND r1.node = e1.p)),
 e3 AS (SELECT p, c, CASE WHEN tree THEN 'TREE' ELSE 'CROSS' END AS kind FROM e2 WHERE c NOT IN (SELECT target FROM mp) OR NOT EXISTS (SELECT 1 FROM e2 o JOIN r1 ON r1.anc = e2.p AND r1.node = o.p WHERE o.c = e2.c)),
 bw AS (SELECT coalesce(target, node) AS node, greatest(n, 1) AS w, n, mu, kappa FROM nd LEFT JOIN mp USING (node)),
 bi AS (SELECT node, i, sum(w * m) AS s FROM (SELECT node, w, unnest(range(64)) AS i, unnest(mu) AS m FROM bw) GROUP BY ALL),
 bm AS (SELECT node, list(s / z ORDER BY i) AS mu FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY node)) AS z FROM bi) GROUP BY node),
 bf AS (SELECT node, sum(n) AS n, sum(w * kappa) / sum(w) AS kappa FROM bw GROUP BY node),
 mb AS (SELECT vec_id, v, CASE WHEN vec_id % 3 = 0 THEN 'c' || label ELSE 'l' || leaf END AS node, CASE WHEN vec_id % 4 = 0 THEN 0.75::DOUBLE ELSE 1 END AS w FROM q UNION ALL SELECT vec_id, v, 'c' || (label + 5) % 10, 0.25::DOUBLE FROM q WHERE vec_id % 4 = 0 AND (label + 5) % 10 IN (SELECT label FROM lb)),
 m1 AS (SELECT vec_id, v, coalesce(target, node) AS node, w, coalesce(target, node) IN (SELECT target FROM mp) AS fused FROM mb LEFT JOIN mp USING (node)),
 m2 AS (SELECT vec_id, v, node, sum(w) AS w, fused FROM m1 GROUP BY ALL),
 kd AS (SELECT vec_id, m2.node, c, row_number() OVER (PARTITION BY vec_id, m2.node ORDER BY round(list_dot_product(v, mu), 9) DESC, c) AS k FROM m2 JOIN e3 ON e3.p = m2.node JOIN bm ON bm.node = c WHERE fused),
 m3 AS (SELECT m2.vec_id, coalesce(c, m2.node) AS node, sum(w) AS w FROM m2 LEFT JOIN (SELECT * FROM kd WHERE k = 1) x ON x.vec_id = m2.vec_id AND x.node = m2.node GROUP BY ALL)"""


def fused(spark, sf):
    """Edges, members and fits of the tree of categories and leaves with cross links, after categories five apart are fused."""
    q = queries(spark, sf)
    name = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    label, leaf = F.col("label"), F.col("leaf")
    have = sorted(r["label"] for r in q.select("label").distinct().collect())
    leaves = {r["leaf"]: r["label"] for r in q.select("leaf", "label").distinct().collect()}
    edges = [("root", f"c{x}", "TREE") for x in have] + [(f"c{x}", f"l{k}", "TREE") for k, x in leaves.items()]
    edges += [(f"c{x}", f"l{(x + 5) % 10 * 2}", "CROSS") for x in have if (x + 5) % 10 * 2 in leaves] + [(f"c{x}", f"c{x + 1}", "CROSS") for x in have if x % 2 == 0 and x < 8 and x + 1 in have]
    into = [(f"c{x}", f"c{x - 5}") for x in have if x >= 5 and x - 5 in have]
    fits = [(n, float(m), [float(y) for y in mu], k) for key in (name("c", label), name("l", leaf)) for n, (m, mu, k) in T.fit(q.withColumn("node", key)).items()]
    shared = F.col("vec_id") % 4 == 0
    own = q.select("vec_id", F.when(F.col("vec_id") % 3 == 0, name("c", label)).otherwise(name("l", leaf)).alias("node"), F.when(shared, 0.75).otherwise(1.0).alias("weight"), "v")
    other = q.filter(shared & ((label + 5) % 10).isin(have)).select("vec_id", name("c", (label + 5) % 10).alias("node"), F.lit(0.25).alias("weight"), "v")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return U.fuse(frame(edges, "p string, c string, kind string"), own.unionByName(other), frame(fits, "node string, n double, mu array<double>, kappa double"), frame(into, "node string, target string"))


@register("clu21_fused_edges", f"WITH RECURSIVE {_FUSED} SELECT * FROM e3")
def clu21_edges(spark, sf):
    return fused(spark, sf)[0]


@register("clu21_fused_members", f"WITH RECURSIVE {_FUSED} SELECT vec_id, node, round(w, 6) AS weight FROM m3")
def clu21_members(spark, sf):
    """Every query keeps its mass; what a fused category held itself is with its children."""
    return fused(spark, sf)[1].select("vec_id", "node", r6(F.col("weight")).alias("weight"))


@register("clu21_fused_fits", f"WITH RECURSIVE {_FUSED} SELECT node, CAST(n AS DOUBLE) AS n, round(kappa, 5) AS kappa, round(mu[1], 6) AS mu0 FROM bf JOIN bm USING (node)")
def clu21_fits(spark, sf):
    return fused(spark, sf)[2].select("node", "n", F.round("kappa", 5).alias("kappa"), r6(F.col("mu")[0]).alias("mu0"))
