"""Fusing nodes of a topology, children and members included: edges are contracted under a map of representatives.

What is left has no circle, no parallel edges, and above a fused node no parent
that is an ancestor of another of its parents. Members of a fused node that has
children go to the child that fits best; no weight is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.functions.vectors import dot, sums, unit
from canopyrank.operators.graph import closure
from canopyrank.storage import materialise


def contract(edges: DataFrame, into: DataFrame, root: str = "root") -> DataFrame:
    """Edges (p, c, kind) after the nodes of `into` (node, target) have become their targets; a target is no node of `into`.

    Loops go. Of parallel edges one stays, TREE if one of them is. Where fusing closes a circle, its edges that lead no
    farther from the root go, so every node stays reachable. A parent of a target goes if another of its parents lies
    below it. Edges from nodes that the root does not reach are left as they are.
    """
    up = lambda c: into.select(F.col("node").alias(c), F.col("target").alias(f"{c}_to"))
    e = edges.join(up("p"), "p", "left").join(up("c"), "c", "left").select(F.coalesce("p_to", "p").alias("p"), F.coalesce("c_to", "c").alias("c"), "kind")
    e = materialise(e.filter("p <> c").groupBy("p", "c").agg(F.max(F.col("kind") == "TREE").alias("tree")), "contracted")
    reach = materialise(closure(e), "reach").select("node", "anc", "d")
    depth = reach.filter(F.col("anc") == root).select("node", F.col("d").alias("depth"))
    # an edge lies on a circle if its parent also lies below its child
    back = reach.filter("d > 0").select(F.col("node").alias("p"), F.col("anc").alias("c"), F.lit(True).alias("circle"))
    level = lambda c: depth.select(F.col("node").alias(c), F.col("depth").alias(f"{c}_depth"))
    e = e.join(back, ["p", "c"], "left").join(level("p"), "p", "left").join(level("c"), "c", "left")
    e = materialise(e.filter("circle IS NULL OR p_depth IS NULL OR p_depth < c_depth").select("p", "c", "tree"), "acyclic")
    above = materialise(closure(e), "above").filter("d > 0").select(F.col("node").alias("other"), F.col("anc").alias("p"))
    fused = e.join(into.select(F.col("target").alias("c")).distinct(), "c", "left_semi").select("p", "c")
    idle = fused.join(fused.select(F.col("p").alias("other"), "c"), "c").join(above, ["other", "p"]).select("p", "c").distinct()
    return e.join(idle, ["p", "c"], "left_anti").select("p", "c", F.when(F.col("tree"), "TREE").otherwise("CROSS").alias("kind"))


def blended(fits: DataFrame, into: DataFrame) -> DataFrame:
    """Fits (node, n, mu, kappa) after fusing: directions and concentrations weighed by members, one at least."""
    f = fits.join(into, "node", "left").select(F.coalesce("target", "node").alias("node"), F.greatest("n", F.lit(1.0)).alias("w"), "n", "mu", "kappa")
    k = f.groupBy("node").agg(F.sum("n").alias("n"), (F.sum(F.col("w") * F.col("kappa")) / F.sum("w")).alias("kappa"))
    return k.join(sums(f, "node", "mu", F.col("w")).select("node", unit("total").alias("mu")), "node").select("node", "n", "mu", "kappa")


def moved(members: DataFrame, into: DataFrame, edges: DataFrame, fits: DataFrame) -> DataFrame:
    """Members (vec_id, node, weight, v) after fusing: a query's shares add up, and where a target has children in `edges`, the child whose direction fits best takes it, the first name at a tie."""
    m = members.join(into, "node", "left")
    stay = m.filter("target IS NULL").select("vec_id", "node", "weight", "v")
    fused = m.filter("target IS NOT NULL").select("vec_id", F.col("target").alias("node"), "weight", "v")
    fused = fused.unionByName(stay.join(into.select(F.col("target").alias("node")).distinct(), "node", "left_semi"))
    stay = stay.join(into.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    kids = edges.join(into.select(F.col("target").alias("p")).distinct(), "p", "left_semi").join(fits.select(F.col("node").alias("c"), "mu"), "c")
    # a row for each target: as many children as the topology gives it
    kids = kids.groupBy(F.col("p").alias("node")).agg(F.collect_list(F.struct("c", "mu")).alias("kids"))
    best = F.array_min(F.transform("kids", lambda k: F.struct((-F.round(dot("v", k["mu"]), 9)).alias("k"), k["c"].alias("c"))))["c"]
    taken = fused.join(kids, "node", "left").select("vec_id", F.coalesce(best, "node").alias("node"), "weight", "v")
    touched = taken.select("node").distinct()
    beside = stay.join(touched, "node", "left_semi")
    once = taken.unionByName(beside).groupBy("vec_id", "node").agg(F.sum("weight").alias("weight"), F.first("v").alias("v"))
    return stay.join(touched, "node", "left_anti").unionByName(once)


def fuse(edges: DataFrame, members: DataFrame, fits: DataFrame, into: DataFrame, root: str = "root") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, members and fits after fusing the nodes of `into` with their targets."""
    e = materialise(contract(edges, into, root), "fused_edges")
    f = materialise(blended(fits, into), "fused_fits")
    return e, moved(members, into, e, f), f
