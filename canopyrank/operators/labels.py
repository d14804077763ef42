"""Names for the nodes of a taxonomy from the texts they hold, without a model.

A term counts for a node by how much more often it stands there than among the
node's siblings: its share of the node's words times the logarithm of one plus
the mean number of words of a sibling over the term's count among all of them.
Deeper nodes are named first, and a term that names a node names none of its
ancestors, so that a parent is called by what its children share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyrank.storage import materialise

#: Stretches that part words, once letters are lower-case: everything but letters and marks.
GAP = r"[^\p{L}\p{M}]+"
TOP, LEAST_LETTERS = 3, 3


def term_counts(texts: DataFrame) -> DataFrame:
    """node, term, n from texts (node, text): words of a few letters at least, whole texts, counted on the map side; null texts have none."""
    words = F.filter(F.split(F.lower("text"), GAP, -1), lambda w: F.length(w) >= LEAST_LETTERS)
    return texts.filter("text IS NOT NULL").select("node", F.explode(words).alias("term")).groupBy("node", "term").agg(F.count("*").alias("n"))


def rolled_up(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of every node with those of all below it. nodes: node, parent, depth, of a tree."""
    whole, now = None, None
    # deepest level first; a number for each level
    for depth in [r["depth"] for r in nodes.select("depth").distinct().orderBy(F.desc("depth")).collect()]:
        level = nodes.filter(F.col("depth") == depth)
        own = counts.join(level.select("node"), "node", "left_semi")
        now = own if now is None else own.unionByName(now).groupBy("node", "term").agg(F.sum("n").alias("n"))
        now = materialise(now, "terms")
        whole = now if whole is None else whole.unionByName(now)
        now = now.join(level.select("node", "parent"), "node").filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), "term").agg(F.sum("n").alias("n"))
    return whole if whole is not None else counts


def scores(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, term, score, from rolled-up counts: how well a term tells a node from its siblings."""
    c = counts.join(nodes.select("node", "parent"), "node").withColumn("group", F.coalesce("parent", F.lit("")))
    size = c.groupBy("group", "node").agg(F.sum("n").alias("words"))
    mean = size.groupBy("group").agg(F.avg("words").alias("mean"))
    among = c.groupBy("group", "term").agg(F.sum("n").alias("among"))
    j = c.join(among, ["group", "term"]).join(size, ["group", "node"]).join(mean, "group")
    return j.select("node", "term", (F.col("n") / F.col("words") * F.ln(1 + F.col("mean") / F.col("among"))).alias("score"))


def top_terms(texts: DataFrame, nodes: DataFrame, top: int = TOP) -> DataFrame:
    """node, depth, place, term, score: up to so many terms for each node with texts, the best first, at a tie the first in order."""
    nodes = materialise(nodes, "nodes")  # read for every level
    # texts are read once: the counts are read for every level
    rolled = materialise(rolled_up(materialise(term_counts(texts), "counts"), nodes), "rolled")
    best = materialise(scores(rolled, nodes), "scores")
    out, taken = None, None
    for depth in [r["depth"] for r in nodes.select("depth").distinct().orderBy(F.desc("depth")).collect()]:
        level = best.join(nodes.filter(F.col("depth") == depth).select("node", "depth", "parent"), "node")
        if taken is not None:
            level = level.join(taken, ["node", "term"], "left_anti")
        # a task passes on no more than so many of each of its nodes
        order = Window.partitionBy("node").orderBy((-F.round("score", 12)).asc(), "term")
        names = level.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top)
        names = materialise(names.select("node", "depth", "parent", "place", "term", "score"), "names")
        out = names if out is None else out.unionByName(names)
        up = names.filter("parent IS NOT NULL").select(F.col("parent").alias("node"), "term")
        if taken is not None:  # and those of deeper descendants
            up = up.unionByName(taken.join(nodes.filter(F.col("depth") == depth).select("node", "parent"), "node").filter("parent IS NOT NULL").select(F.col("parent").alias("node"), "term"))
        taken = materialise(up.distinct(), "taken")
    return out.drop("parent")
