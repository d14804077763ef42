"""Names of nodes from their texts, and snapshots of a taxonomy in a catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyrank.operators import labels as N
from canopyrank.plans.base import dag_edges, tree_edges
from canopyrank.plans.registry import register
from canopyrank.session import table
from canopyrank.sources.catalogue import Catalogue
from canopyrank.storage import scratch

_TERMS = """tx AS (SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS node, coalesce(lang, 'none') AS parent, text FROM documents),
 wd AS (SELECT node, parent, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{M}]+')) AS term FROM tx),
 c2 AS (SELECT node, parent, term, count(*) AS n FROM wd WHERE len(term) >= 3 GROUP BY ALL), c1 AS (SELECT parent AS node, 'root' AS parent, term, sum(n) AS n FROM c2 GROUP BY ALL), c0 AS (SELECT 'root' AS node, '' AS parent, term, sum(n) AS n FROM c1 GROUP BY ALL)"""


def _scores(level: int) -> str:
    return f"""s{level} AS (SELECT c.node, c.parent, c.term, n / words * ln(1 + mean / among) AS score FROM c{level} c JOIN (SELECT node, sum(n) AS words FROM c{level} GROUP BY node) USING (node)
  JOIN (SELECT parent, avg(words) AS mean FROM (SELECT parent, node, sum(n) AS words FROM c{level} GROUP BY ALL) GROUP BY parent) USING (parent) JOIN (SELECT parent, term, sum(n) AS among FROM c{level} GROUP BY ALL) USING (parent, term))"""


_TOP = "row_number() OVER (PARTITION BY node ORDER BY round(score, 12) DESC, term) AS place"


@register("clu34_node_labels", f"""WITH {_TERMS}, {_scores(2)}, {_scores(1)}, {_scores(0)},
 t2 AS (SELECT *, 2 AS depth FROM (SELECT *, {_TOP} FROM s2) WHERE place <= {N.TOP}),
 t1 AS (SELECT *, 1 AS depth FROM (SELECT *, {_TOP} FROM s1 WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.parent = s1.node AND t2.term = s1.term)) WHERE place <= {N.TOP}),
 t0 AS (SELECT *, 0 AS depth FROM (SELECT *, {_TOP} FROM s0 WHERE term NOT IN (SELECT term FROM t1 UNION ALL SELECT term FROM t2)) WHERE place <= {N.TOP})
 SELECT node, depth, place, term, round(score, 6) AS score FROM (FROM t2 UNION ALL FROM t1 UNION ALL FROM t0)""")
def clu34(spark, sf):
    """The terms that tell sources from each other within a language, and languages from each other, over whole documents."""
    name = lambda c: F.coalesce(F.col(c), F.lit("none"))
    d = table(spark, sf, "documents").select(name("lang").alias("lang"), F.concat(name("lang"), F.lit("/"), name("source")).alias("node"), "text")
    leaves = d.select("node", F.col("lang").alias("parent")).distinct().withColumn("depth", F.lit(2))
    inner = d.select(F.col("lang").alias("node"), F.lit("root").alias("parent")).distinct().withColumn("depth", F.lit(1))
    nodes = leaves.unionByName(inner).unionByName(spark.createDataFrame([("root", None, 0)], "node string, parent string, depth int"))
    return N.top_terms(d.select("node", "text"), nodes).select("node", "depth", "place", "term", F.round("score", 6).alias("score"))


@register("snk11_snapshot_catalogue", """WITH t AS (SELECT 'root' AS p, 'r' || r_regionkey AS c FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
 d AS (SELECT DISTINCT p, c, kind FROM (SELECT 'root' AS p, 'b' || p_brand AS c, 'TREE' AS kind FROM part UNION ALL SELECT 'root', 't' || p_type, 'TREE' FROM part UNION ALL SELECT 'b' || p_brand, 'p' || p_partkey, 'TREE' FROM part UNION ALL SELECT 't' || p_type, 'p' || p_partkey, 'CROSS' FROM part))
 SELECT 'brands' AS name, 'renamed' AS note, 'edges' AS tbl, p, count(*) AS kids FROM d GROUP BY p UNION ALL SELECT 'places', 'second', 'edges', p, count(*) FROM t WHERE p <> 'root' GROUP BY p UNION ALL SELECT 'places', 'second', 'pinned', p, count(*) FROM t GROUP BY p""")
def snk11(spark, sf):
    """Snapshots saved, saved again, renamed, noted and deleted; then every table that is listed, read back, and the first version of one that was pinned before."""
    c = Catalogue(spark, scratch(spark, "catalogue"))
    e = tree_edges(spark, sf)
    c.save("places", {"edges": e}, "first")
    pinned = c.pin("places")
    c.save("places", {"edges": e.filter("p <> 'root'")}, "second")
    c.save("parts", {"edges": dag_edges(spark, sf)}, "made")
    c.save("gone", {"edges": e.limit(1)})
    c.rename("parts", "brands")
    c.update("brands", "renamed")
    c.delete("gone")
    rows = [(s["name"], s["note"], t, c.load(s["name"], t)) for s in c.list() for t in s["tables"]] + [("places", "second", "pinned", c.load("places", "edges", pinned))]
    out = None
    for name, note, t, df in rows:
        one = df.groupBy("p").agg(F.count("*").alias("kids")).select(F.lit(name).alias("name"), F.lit(note).alias("note"), F.lit(t).alias("tbl"), "p", "kids")
        out = one if out is None else out.unionByName(one)
    return out
