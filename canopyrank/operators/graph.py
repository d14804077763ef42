"""Graph operators over edge tables (p, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopyrank.storage import dealt, materialise


def closure(edges: DataFrame) -> DataFrame:
    """Ancestors of every node at any distance: node, anc, with the shortest distance d; a node is its own at 0.

    One join for each level, until a level has no new pair; a pair counts where it is met first, so paths that meet
    do not multiply and circles end. Levels are written to the shared folder: none is worked out twice.
    """
    e = materialise(edges.select("p", "c").distinct(), "edges")
    up = e.select(F.col("c").alias("anc"), F.col("p").alias("up"))
    nodes = e.select(F.col("c").alias("node")).union(e.select("p")).distinct()
    found = nodes.select("node", F.col("node").alias("anc"), F.lit(0).alias("d"))
    front, d = found, 0
    while True:
        d += 1
        step = front.select("node", "anc").join(up, "anc").select("node", F.col("up").alias("anc")).distinct()
        front = materialise(step.join(found, ["node", "anc"], "left_anti").withColumn("d", F.lit(d)), "level")
        if front.isEmpty():
            return found
        found = found.union(front)


def depths(edges: DataFrame, root: str = "root") -> DataFrame:
    """Shortest distance from the root."""
    return closure(edges).filter(F.col("anc") == root).select("node", F.col("d").alias("depth"))


def lowest_common(pairs: DataFrame, reach: DataFrame, depth: DataFrame) -> DataFrame:
    """For pairs (x, y): the deepest common ancestor, the smallest name at a tie."""
    a = reach.select(F.col("node").alias("x"), "anc")
    b = reach.select(F.col("node").alias("y"), "anc")
    both = pairs.join(a, "x").join(b, ["y", "anc"]).join(depth.withColumnRenamed("node", "anc"), "anc")
    best = both.groupBy("x", "y").agg(F.min(F.struct((-F.col("depth")).alias("k"), "anc")).alias("m"))
    return best.select("x", "y", F.col("m.anc").alias("lca"), (-F.col("m.k")).alias("depth"))


def reduce_edges(edges: DataFrame) -> DataFrame:
    """Edges left by transitive reduction: an edge goes if another parent of its child lies below its own parent."""
    e = edges.select("p", "c").distinct()
    reach = closure(e).filter("d > 0").select(F.col("node").alias("other"), F.col("anc").alias("p"))
    other = e.select(F.col("p").alias("other"), "c")
    return e.join(e.join(other, "c").join(reach, ["other", "p"]).select("p", "c").distinct(), ["p", "c"], "left_anti")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Component of every node, named by its smallest member; edges are (p, c) and may hold cycles."""
    reach = closure(edges).select("node", "anc")
    back = reach.select(F.col("anc").alias("node"), F.col("node").alias("anc"))
    return reach.join(back, ["node", "anc"]).groupBy("node").agg(F.min("anc").alias("scc"))


def component_order(edges: DataFrame) -> DataFrame:
    """Strong components in topological order: node, scc, level (edges on the longest way from a component that none leads to).

    Components that no other of the rest leads to are taken off, one level at a time, so a level holds what could stand
    side by side in the order. Between components there are no circles, so none is left over.
    """
    scc = materialise(strongly_connected(edges), "components")
    side = lambda c: scc.select(F.col("node").alias(c), F.col("scc").alias(c + "s"))
    between = edges.select("p", "c").join(side("p"), "p").join(side("c"), "c").filter("ps <> cs")
    rest, e = scc.select("scc").distinct(), materialise(between.select(F.col("ps").alias("p"), F.col("cs").alias("c")).distinct(), "between")
    order, level = None, 0
    while True:
        free = materialise(rest.join(e.select(F.col("c").alias("scc")), "scc", "left_anti").withColumn("level", F.lit(level).cast("long")), "level")
        order = free if order is None else order.union(free)
        rest = materialise(rest.join(free, "scc", "left_anti"), "rest")
        if rest.isEmpty():
            return scc.join(order, "scc").select("node", "scc", "level")
        e, level = materialise(e.join(free.select(F.col("scc").alias("p")), "p", "left_anti"), "between"), level + 1


def chains(edges: DataFrame, least: int) -> DataFrame:
    """Runs of at least so many nodes with a single child each: head (a node that no other of the run leads to), length."""
    e = edges.select("p", "c").distinct()
    single = materialise(e.groupBy("p").agg(F.count("*").alias("n"), F.min("c").alias("c")).filter("n = 1").select("p", "c"), "single")
    inside = single.join(single.select(F.col("p").alias("c")), "c", "left_semi")
    heads = single.select("p").join(inside.select(F.col("c").alias("p")).distinct(), "p", "left_anti")
    far = run_lengths(single, inside)
    return heads.join(far, "p").select(F.col("p").alias("head"), "length").filter(F.col("length") >= least)


def numbered_chains(steps: DataFrame, first: int, least: int) -> DataFrame:
    """chains() where nodes are a group's numbers k and an edge leads to k from k - 1: group, k (the head's), length.

    The edge to `first` comes from the group's own node (k null). A row is an edge, repeats count once. No edge leaves
    its group, so one shuffle by group is all, and a run is what keeps its distance to its place in order.
    """
    k, side = F.col("k"), F.col("k") >= first
    each = dealt(steps.select("group", "k").filter("k IS NOT NULL"), steps.count(), "group").withColumn("side", side)
    by = W.partitionBy("group", "side").orderBy("k")
    run = each.withColumn("run", k - F.dense_rank().over(by)).groupBy("group", "side", "run").agg(F.min("k").alias("low"), (F.max("k") - F.min("k") + 1).cast("long").alias("length"))
    return run.filter(F.col("length") >= least).select("group", F.when(F.col("low") != first, F.col("low") - 1).alias("k"), "length")


def run_lengths(single: DataFrame, inside: DataFrame) -> DataFrame:
    """p, length for every node with a single child: nodes on the way from it until one has another number of children.

    Pointers double: each round a node's pointer goes as far again, so a run of L nodes takes log L rounds of a row for
    each node. Pointers that never end go into a circle; there each node counts once, as the closure tells.
    """
    n = single.count()
    far = materialise(single.select("p").join(inside.select("p", F.col("c").alias("to")), "p", "left").withColumn("length", F.lit(1).cast("long")), "runs")
    for _ in range(n.bit_length()):
        if far.filter("to IS NOT NULL").isEmpty():
            return far.select("p", "length")
        ahead = far.select(F.col("p").alias("to"), F.col("to").alias("then"), F.col("length").alias("more"))
        far = materialise(far.join(ahead, "to", "left").select("p", F.col("then").alias("to"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")), "runs")
    ends = far.filter("to IS NULL").select("p", "length")
    if far.filter("to IS NOT NULL").isEmpty():
        return ends
    circle = far.filter("to IS NOT NULL").select("p")
    reach = closure(inside.join(circle, "p", "left_semi").select("p", "c")).groupBy(F.col("anc").alias("p")).agg((F.max("d") + 1).cast("long").alias("length"))
    return ends.unionByName(circle.join(reach, "p").select("p", "length"))


def collapse(edges: DataFrame, depth: int) -> DataFrame:
    """Edges without sole children: a child that is its parent's only one and has no other parent is folded into the
    parent, which takes over its children; parents nearer to the root than depth are left alone. Repeats until none is left."""
    e = materialise(edges.select("p", "c").distinct(), "edges")
    level = depths(e)
    while True:
        deep = level.filter(F.col("depth") >= depth).select(F.col("node").alias("p"))
        only = e.groupBy("p").agg(F.count("*").alias("n"), F.min("c").alias("c")).filter("n = 1").join(deep, "p", "left_semi")
        alone = e.groupBy("c").agg(F.count("*").alias("m")).filter("m = 1")
        sole = materialise(only.join(alone, "c").select(F.col("c").alias("gone"), F.col("p").alias("into")), "sole")
        if sole.isEmpty():
            return e
        # of a run of sole children the first goes; the next round takes the one behind it
        first = sole.join(sole.select(F.col("gone").alias("into")), "into", "left_anti")
        kept = e.join(first.select(F.col("gone").alias("c")), "c", "left_anti")
        e = materialise(kept.join(first, kept["p"] == first["gone"], "left").select(F.coalesce("into", "p").alias("p"), "c").distinct(), "edges")


def merge_groups(pairs: DataFrame, a: str, b: str, node: str, group: str) -> DataFrame:
    """Groups of nodes joined by pairs, named by the smallest member. Pairs of taxonomy nodes: as small as the topology, which the driver holds."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for r in pairs.select(a, b).collect():
        x, y = sorted((find(r[0]), find(r[1])))
        up[y] = x
    kind = dict(pairs.dtypes)[a]
    return pairs.sparkSession.createDataFrame([(x, find(x)) for x in sorted(up)], f"{node} {kind}, {group} {kind}")
