"""Changes of the taxonomy, proposed site by site, kept where the objective gains and dropped otherwise.

The objective is the chance-corrected separation of all cells, a cell being what
a node holds itself. It needs a cell's mass and component sum and nothing else,
so the driver keeps one row for each node, a proposal says which rows go and
which come, and its gain is worked out from these in time that does not depend
on the members. Members are read in one pass for all sites together, to see
what each proposal would make of them; a rejected proposal has changed nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.operators.mixtures import Held, Spread, fit_of, room, separation_of, split
from canopyrank.operators.routing import _dots, steps
from canopyrank.operators.topology import Node, Settings, Taxonomy

#: Members of a node up to which one task takes them all, in files of the task where they are more than HELD. A step of their mixture takes it half a second; a job for each step takes longer.
ALONE = 1 << 20
#: Cosine over which two leaves anywhere are redundant.
REDUNDANT = 0.92

Cell = tuple[float, np.ndarray]


def added(each: DataFrame, *keys: str) -> DataFrame:
    """keys and r: arrays added up by key, of which each task has given a row at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple, np.ndarray] = {}
        for b in batches:
            r = np.asarray(b.column("r").flatten(), dtype=float).reshape(len(b), -1) if len(b) else []
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in keys)), r):
                got[key] = got[key] + row if key in got else row
        if got:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*got)), pa.array(list(map(list, got.values())), pa.list_(pa.float64()))], [*keys, "r"])

    return each.repartition(*keys).mapInArrow(run, "".join(f"{k} string, " for k in keys) + "r array<double>")


def cell_sums(members: DataFrame) -> dict[str, Cell]:
    """Mass and component sum of every node from (node, v, perhaps weight): each task adds up its rows as arrays, and a row for each task and node is shuffled."""
    m = members.select("node", "v", (F.col("weight") if "weight" in members.columns else F.lit(1.0)).cast("double").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for b in batches:
            if len(b):
                names, of = np.unique(np.array(b.column("node").to_pylist(), dtype=object), return_inverse=True)
                w = b.column("weight").to_numpy(zero_copy_only=False)
                x = np.column_stack([np.ones(len(b)), np.asarray(b.column("v").flatten(), dtype=float).reshape(len(b), -1)]) * w[:, None]
                for j, name in enumerate(names):
                    new = x[of == j].sum(axis=0)
                    got[name] = got[name] + new if name in got else new
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array(list(map(list, got.values())), pa.list_(pa.float64()))], ["node", "r"])

    return {r["node"]: (r["r"][0], np.array(r["r"][1:])) for r in added(m.mapInArrow(run, "node string, r array<double>"), "node").collect()}


@dataclass
class Cells:
    """Mass and component sum of every node that holds members itself."""

    of: dict[str, Cell]

    def __post_init__(self):
        self.total = sum((t for _, t in self.of.values()), np.zeros(1))
        n = np.array([m for m, _ in self.of.values()])
        self.n, self.pairs, self.within = float(n.sum()), float((n * (n - 1)).sum()), float(sum(m * m - t @ t for m, t in self.of.values()))

    @staticmethod
    def read(members: DataFrame) -> "Cells":
        """From memberships (node, v, weight): as many rows as there are nodes reach the driver."""
        return Cells(cell_sums(members))

    @staticmethod
    def _value(count: int, n: float, total: np.ndarray, pairs: float, within: float) -> float:
        if count < 2 or n < 2:
            return 0.0
        expected = (n * n - total @ total) * pairs / (n * (n - 1))
        return float(1 - within / expected) if expected > 1e-10 else 0.0

    def objective(self) -> float:
        return self._value(sum(m > 0 for m, _ in self.of.values()), self.n, self.total, self.pairs, self.within)

    def gain(self, change: dict[str, Cell | None]) -> float:
        """By how much the objective grows when these cells are replaced (None: dropped); nothing is changed."""
        count, n, pairs, within = sum(m > 0 for m, _ in self.of.values()), self.n, self.pairs, self.within
        total = self.total
        for name, new in change.items():
            for sign, cell in ((-1, self.of.get(name)), (1, new)):
                if cell is not None:
                    m, t = cell
                    count, n, pairs = count + sign * (m > 0), n + sign * m, pairs + sign * m * (m - 1)
                    within, total = within + sign * (m * m - t @ t), total + sign * t
        return self._value(count, n, total, pairs, within) - self.objective()

    def put(self, change: dict[str, Cell | None]) -> "Cells":
        return Cells({k: c for k, c in {**self.of, **change}.items() if c is not None})

    def region(self, tree: Taxonomy, name: str) -> Cell:
        """What a node and all below it hold, each cell once."""
        names, todo = set(), [name]
        while todo:
            if (x := todo.pop()) not in names:
                names.add(x)
                todo += [k.name for k in tree.children(x)]
        some = [self.of[x] for x in sorted(names) if x in self.of]
        return sum(m for m, _ in some), sum((t for _, t in some), np.zeros_like(self.total))

    def share(self, tree: Taxonomy, site: str) -> float:
        """The site's share of all pairs within cells, by which thresholds are scaled; 1 for the root."""
        m = self.region(tree, site)[0]
        return 1.0 if tree.nodes[site].depth == 0 or self.pairs <= 1e-5 else min(1.0, m * (m - 1) / self.pairs)


@dataclass(frozen=True)
class Record:
    """What became of a proposal."""

    kind: str
    site: str
    gain: float
    threshold: float
    accepted: bool


def gates(members: DataFrame, tree: Taxonomy, s: Settings, viable: Iterable[str] = ()) -> DataFrame:
    """node, mass, ess, depth, kappa, gate for every node with members of its own: the first gate that keeps it from being split, or "open".

    mass, ess (effective number of members): under twice the least; depth: at the greatest; diffuse: hardly
    concentrated and small, unless its residuals are viable.
    """
    spark = members.sparkSession
    rows = [(n.name, n.depth, float(n.kappa), n.name in set(viable)) for n in tree.nodes.values()]
    nodes = F.broadcast(spark.createDataFrame(rows, "node string, depth int, kappa double, viable boolean"))
    w = F.col("weight")
    mass = members.groupBy("node").agg(F.sum(w).alias("mass"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))
    diffuse = (F.col("kappa") < s.diffuse_kappa) & (F.col("mass") < s.diffuse_times * s.least)
    gate = F.when(F.col("mass") < 2 * s.least, "mass").when(F.col("ess") < 2 * s.least, "ess").when(F.col("depth") >= s.max_depth, "depth").when(diffuse & ~F.col("viable"), "diffuse").otherwise("open")
    return mass.join(nodes, "node").select("node", "mass", "ess", "depth", "kappa", gate.alias("gate"))


def viable(hits: dict[str, Cell], tree: Taxonomy, cells: Cells, s: Settings) -> set[str]:
    """Nodes whose residual queries, of whom there are these counts and sums, are as many as the least and separate from what every sibling holds."""
    out = set()
    for node, own in hits.items():
        if own[0] >= s.least:
            parent = tree.nodes[node].parent
            beside = [cells.region(tree, k.name) for k in tree.children(parent) if k.name != node]
            if all(m <= 0 or separation_of(np.array([own[0], m]), np.stack([own[1], t])) >= s.epsilon for m, t in beside):
                out.add(node)
    return out


def viable_residuals(hits: DataFrame, queries: DataFrame, tree: Taxonomy, cells: Cells, s: Settings) -> set[str]:
    """The viable nodes of residual hits (vec_id, node)."""
    return viable(cell_sums(hits.join(queries.select("vec_id", "v"), "vec_id").select("node", "v")), tree, cells, s)


def shelves(counts: dict[str, int], most: int) -> dict[str, int]:
    """Which of `most` tasks takes a node: the largest first, each to the task that has least."""
    load = [(0, k) for k in range(most)]
    out = {}
    for node in sorted(counts, key=lambda n: (-counts[n], n)):
        had, out[node] = load[0]
        heapq.heapreplace(load, (had + counts[node] + 1, out[node]))
    return out


def split_parts(members: DataFrame, s: Settings, most: int = ALONE) -> dict[str, tuple[str, list[Cell], float]]:
    """For every node: what the split came to ("split" or the gate that it failed), masses and sums of the parts, their separation.

    The mixture sees all members of a node, by their weight. A node of at most `most` members is one task's;
    a larger one stays spread, and each step of its mixture is a pass over it.
    """
    spark = members.sparkSession
    weight = F.col("weight") if "weight" in members.columns else F.lit(1.0)
    rows = members.select("node", "vec_id", "v", weight.cast("double").alias("weight"))
    counts = {r["node"]: r["count"] for r in rows.groupBy("node").count().collect()}
    few, large = {n: c for n, c in counts.items() if c <= most}, sorted(n for n, c in counts.items() if c > most)
    names = ["node", "gate", "size", "total", "sep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            node = np.array(b.column("node").to_pylist(), dtype=object)
            v = np.asarray(b.column("v").flatten(), dtype=float).reshape(len(b), -1) if len(b) else None
            u = b.column("weight").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1), len(node)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if node[lo] != at:
                    at, n = node[lo], 0
                    x, w = room(few[at], v.shape[1]), np.empty(few[at])
                x[n : n + hi - lo], w[n : n + hi - lo], n = v[lo:hi], u[lo:hi], n + hi - lo
                if n == few[at]:
                    gate, size, total, sep = split(Held(x, w), s.least, s.most_children, s.epsilon)
                    row = [at, gate, list(map(float, size)), [list(map(float, t)) for t in total], float(sep)]
                    kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names)

    found: dict[str, tuple[str, list[Cell], float]] = {}
    if few:
        # a task takes its nodes one after the other: where there are more nodes than tasks, each gets about as many members
        tasks = min(len(few), int(spark.conf.get("spark.sql.shuffle.partitions")))
        shelf = F.broadcast(spark.createDataFrame(sorted(shelves(few, tasks).items()), "node string, shelf int"))
        mine = rows.join(shelf, "node").repartitionById(tasks, "shelf").sortWithinPartitions("node", "vec_id").select("node", "v", "weight")
        for r in mine.mapInArrow(run, "node string, gate string, size array<double>, total array<array<double>>, sep double").collect():
            found[r["node"]] = (r["gate"], [(m, np.array(t)) for m, t in zip(r["size"], r["total"])], r["sep"])
        if len(found) < len(few):
            raise RuntimeError("members changed between two reads of them")
    if large:
        rows = rows.filter(F.col("node").isin(large)).persist()
        try:
            for node in large:
                gate, size, total, sep = split(Spread(rows.filter(F.col("node") == node)), s.least, s.most_children, s.epsilon)
                found[node] = (gate, list(zip(map(float, size), total)), sep)
        finally:
            rows.unpersist()
    return dict(sorted(found.items()))


def shared_out(members: DataFrame, targets: dict[str, list[Node]], s: Settings, rows: bool) -> DataFrame:
    """What becomes of the members of some nodes if these targets take them, each its share as in routing.

    rows: the members themselves (vec_id, node, weight, v), those of other nodes as they are; otherwise sums by site and
    target as rows (site, node, r), the mass and then the components.
    """
    plan = {site: ([k.name for k in kids], [np.array(k.mu) for k in kids], np.array([k.kappa for k in kids])) for site, kids in targets.items()}
    m = members.select("vec_id", "node", "weight", "v")

    def parts(b: pa.RecordBatch):
        node = np.array(b.column("node").to_pylist(), dtype=object)
        x = np.asarray(b.column("v").flatten(), dtype=float).reshape(len(b), -1)
        w = b.column("weight").to_numpy(zero_copy_only=False)
        for site in sorted(set(node) & set(plan)):
            at = np.flatnonzero(node == site)
            names, mus, kappa = plan[site]
            p = np.exp(steps(_dots(x[at], mus), kappa, s.margin)) * w[at][:, None]
            yield site, at, names, p, x
        yield None, np.flatnonzero(~np.isin(node, list(plan))), None, None, x

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for site, at, names, p, _ in parts(b):
                if site is None:
                    yield b.take(pa.array(at))
                else:
                    r, k = np.nonzero(p)
                    some = b.take(pa.array(at[r]))
                    yield some.set_column(1, "node", pa.array([names[j] for j in k], pa.string())).set_column(2, "weight", pa.array(p[r, k], pa.float64()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[str, str], np.ndarray] = {}
        for b in batches:
            for site, at, names, p, x in parts(b):
                if site is not None:
                    for j, name in enumerate(names):
                        new = np.concatenate([[p[:, j].sum()], p[:, j] @ x[at]])
                        got[site, name] = got[site, name] + new if (site, name) in got else new
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got]), pa.array([k[1] for k in got]), pa.array(list(map(list, got.values())), pa.list_(pa.float64()))], ["site", "node", "r"])

    if rows:
        return m.mapInArrow(moved, m.schema)
    return added(m.filter(F.col("node").isin(list(plan))).mapInArrow(summed, "site string, node string, r array<double>"), "site", "node")


def outcomes(members: DataFrame, targets: dict[str, list[Node]], s: Settings) -> dict[str, dict[str, Cell]]:
    """Mass and sum that each target would take of each site, in one pass over the members."""
    if not targets:
        return {}
    out: dict[str, dict[str, Cell]] = {site: {} for site in targets}
    for site, node, r in sorted(map(tuple, shared_out(members, targets, s, False).collect())):
        out[site][node] = (r[0], np.array(r[1:]))
    return out


def settle(cells: Cells, tree: Taxonomy, kind: str, site: str, change: dict[str, Cell | None], threshold: float, at: str | None = None) -> tuple[Cells, Record]:
    """Take a change of cells if the objective's gain passes the threshold, scaled by the share of pairs at the site (`at`, if another's)."""
    limit = threshold * cells.share(tree, at or site)
    gain = cells.gain(change)
    ok = gain > limit
    return (cells.put(change) if ok else cells), Record(kind, site, gain, limit, ok)


def split_pass(members: DataFrame, tree: Taxonomy, cells: Cells, s: Settings, *, viable: Iterable[str] = (), most: int = ALONE) -> tuple[Taxonomy, Cells, DataFrame, list[Record]]:
    """Propose to split every node that the gates let through, deepest first: taxonomy, cells, members and records.

    A child that does not separate by epsilon from what a child that is already there holds spoils its split.
    """
    free = [r["node"] for r in gates(members, tree, s, viable).filter("gate = 'open'").collect()]
    if not free:
        return tree, cells, members, []
    found = split_parts(members.filter(F.col("node").isin(free)), s, most)
    targets: dict[str, list[Node]] = {}
    for site, (gate, parts, _) in found.items():
        if gate != "split":
            continue
        there = [cells.region(tree, k.name) for k in tree.children(site)]
        if any(m > 0 and separation_of(np.array([n, m]), np.stack([t, u])) < s.epsilon for n, t in parts for m, u in there):
            continue
        names = (f"{site}.{j}" for j in range(10**9) if f"{site}.{j}" not in tree.nodes)
        targets[site] = [Node(next(names), site, tree.nodes[site].depth + 1, tuple(mu), kappa, n) for (n, t) in parts for mu, kappa in [fit_of(n, t)]]
    taken, nodes, log = {}, dict(tree.nodes), []
    result = outcomes(members, targets, s)
    for site in sorted(targets, key=lambda x: (-tree.nodes[x].depth, x)):
        cells, record = settle(cells, tree, "split", site, {site: None, **result[site]}, s.epsilon)
        log.append(record)
        if record.accepted:
            taken[site] = targets[site]
            nodes |= {k.name: replace(k, mass=result[site].get(k.name, (0.0,))[0]) for k in targets[site]}
    return Taxonomy(nodes), cells, shared_out(members, taken, s, True) if taken else members, log


def merge_pass(tree: Taxonomy, cells: Cells, s: Settings, redundant: float = REDUNDANT) -> tuple[Taxonomy, Cells, dict[str, str], list[Record]]:
    """Merge sibling leaves that separate by less than epsilon, then leaves anywhere whose directions are redundant; also what became of whom.

    Cells of merged leaves add up, so no member is read. The pair that separates least goes first; who has taken or
    been taken waits for the next pass.
    """
    nodes, into, log = dict(tree.nodes), {}, []
    leaves = [x for x in tree.leaves() if x in cells.of and nodes[x].depth > 1]
    def apart(a, b):
        return separation_of(np.array([cells.of[a][0], cells.of[b][0]]), np.stack([cells.of[a][1], cells.of[b][1]]))

    by_parent: dict[str | None, list[str]] = {}
    for x in leaves:
        by_parent.setdefault(nodes[x].parent, []).append(x)
    pairs = [(apart(a, b), a, b, "merge") for kids in by_parent.values() for i, a in enumerate(kids) for b in kids[i + 1 :]]
    pairs = sorted(p for p in pairs if p[0] < s.epsilon)
    mus: dict[int, list[str]] = {}
    for x in leaves:
        mus.setdefault(len(nodes[x].mu), []).append(x)
    for names in mus.values():
        m = np.array([nodes[x].mu for x in names]).reshape(len(names), -1)
        for i in range(len(names)):
            c = np.round(m[i + 1 :] @ m[i], 9)
            pairs += [(2 - c[j], names[i], names[i + 1 + j], "redundant") for j in np.flatnonzero(c > redundant)]
    busy: set[str] = set()
    for _, a, b, kind in pairs:
        if {a, b} & busy:
            continue
        new = (cells.of[a][0] + cells.of[b][0], cells.of[a][1] + cells.of[b][1])
        site = nodes[a].parent if kind == "merge" else tree.root
        cells, record = settle(cells, tree, kind, a, {a: new, b: None}, -s.epsilon, site)
        log.append(record)
        if record.accepted:
            busy |= {a, b}
            into[b] = a
            mu, kappa = fit_of(*new)
            more = tuple(p for p in (nodes[b].parent, *nodes[b].also) if p not in (nodes[a].parent, *nodes[a].also))
            nodes[a] = replace(nodes[a], mu=tuple(mu), kappa=kappa, mass=new[0], also=nodes[a].also + (more if kind == "redundant" else ()))
            del nodes[b]
    return Taxonomy(nodes), cells, into, log


def starved_changes(members: DataFrame, tree: Taxonomy, cells: Cells, ways: dict[str, list[Node]], s: Settings) -> tuple[dict[str, dict[str, Cell | None]], dict[str, tuple[str, dict[str, Cell | None]]]]:
    """For leaves and those who could take their members: the change of cells if each takes its shares, and the nearest with the change if it takes all. One pass over the members."""
    result, prunes, merges = outcomes(members, ways, s), {}, {}
    add = lambda k, c: (c[0] + cells.of[k][0], c[1] + cells.of[k][1]) if k in cells.of else c
    for x, targets in ways.items():
        mu = tree.nodes[x].mu
        near = max(targets, key=lambda n: (float(np.round(np.dot(n.mu, mu), 9)) if len(n.mu) == len(mu) else -2.0, n.name)).name
        prunes[x] = {x: None, **{k: add(k, c) for k, c in result.get(x, {}).items()}}
        merges[x] = near, ({x: None, near: add(near, cells.of[x])} if x in cells.of else {x: None})
    return prunes, merges


def starved(tree: Taxonomy, cells: Cells, s: Settings) -> dict[str | None, str]:
    """For each parent of leaves under the least mass the lightest of them."""
    out: dict[str | None, str] = {}
    for x in tree.leaves():
        n, mass = tree.nodes[x], cells.of.get(x, (0.0,))[0]
        if n.depth > 1 and mass < s.least and (n.parent not in out or mass < cells.of.get(out[n.parent], (0.0,))[0]):
            out[n.parent] = x
    return out


def prune_pass(members: DataFrame, tree: Taxonomy, cells: Cells, s: Settings) -> tuple[Taxonomy, Cells, DataFrame, list[Record]]:
    """For starved leaves keep, prune (siblings take the members, or the parent where there are none) or merge with the nearest sibling, whichever separates best.

    One leaf of a parent at a time, the lightest, as siblings are each other's targets; all such sites go in one pass
    over the members.
    """
    beside = {x: [k for k in tree.children(p) if k.name != x and k.mu] or [tree.nodes[p]] for p, x in starved(tree, cells, s).items()}
    # a lone target without a direction takes all
    ways = {x: [k if k.mu else replace(k, mu=tree.nodes[x].mu) for k in ks] for x, ks in beside.items()}
    prunes, merges = starved_changes(members, tree, cells, ways, s)
    nodes, taken, log = dict(tree.nodes), {}, []
    for x in sorted(ways):
        (near, merge), prune = merges[x], prunes[x]
        gains = sorted(((cells.gain(c), kind, c) for kind, c in (("prune", prune), ("starved merge", merge))), key=lambda g: (-g[0], g[1]))
        gain, kind, change = gains[0]
        # an empty leaf goes; otherwise keeping is best unless the gain is real
        ok = gain > 0 or cells.of.get(x, (0.0,))[0] <= 0
        log.append(Record(kind, x, gain, 0.0, ok))
        if ok:
            cells = cells.put(change)
            taken[x] = ways[x] if kind == "prune" else [k for k in ways[x] if k.name == near]
            del nodes[x]
    return Taxonomy(nodes), cells, shared_out(members, taken, s, True) if taken else members, log


def renamed(members: DataFrame, into: dict[str, str]) -> DataFrame:
    """Members of merged nodes under the name of who took them; a query with shares in both has one row with their sum."""
    if not into:
        return members
    def last(x):
        while x in into:
            x = into[x]
        return x

    names = F.broadcast(members.sparkSession.createDataFrame([(k, last(k)) for k in into], "node string, new string"))
    rows = members.join(names, "node", "left").select("vec_id", F.coalesce("new", "node").alias("node"), "weight", "v")
    touched = F.col("node").isin(sorted({last(k) for k in into}))
    once = rows.filter(touched).groupBy("vec_id", "node").agg(F.sum("weight").alias("weight"), F.first("v").alias("v"))
    return rows.filter(~touched).unionByName(once.select("vec_id", "node", "weight", "v"))


def collapse_pass(tree: Taxonomy, cells: Cells, s: Settings) -> tuple[Taxonomy, Cells, dict[str, str], list[Record]]:
    """Fold a sole child with no other parent into its parent, which takes over its cell and its children; depth-1 nodes stay."""
    nodes, into, log = dict(tree.nodes), {}, []
    while True:
        now = Taxonomy(nodes)
        sole = [(p, k[0]) for p in sorted(nodes) if len(k := now.children(p)) == 1 and k[0].depth > 1 and not k[0].also and k[0].name not in {r.site for r in log}]
        if not sole:
            return now, cells, into, log
        p, child = sole[0]
        both = [cells.of[x] for x in (p, child.name) if x in cells.of]
        change = {child.name: None} | ({p: (sum(m for m, _ in both), sum(t for _, t in both))} if both else {})
        cells, record = settle(cells, now, "collapse", child.name, change, -s.epsilon, p)
        log.append(record)
        if record.accepted:
            into[child.name] = p
            del nodes[child.name]
            for k in now.children(child.name):
                nodes[k.name] = replace(k, parent=p if k.parent == child.name else k.parent, also=tuple(p if x == child.name else x for x in k.also))
            todo = [(p, nodes[p].depth)]
            while todo:  # those below stand one level higher
                x, d = todo.pop()
                for k in [n for n in nodes.values() if n.parent == x]:
                    nodes[k.name] = replace(nodes[k.name], depth=d + 1)
                    todo.append((k.name, d + 1))


def optimise(members: DataFrame, tree: Taxonomy, cells: Cells, s: Settings) -> tuple[Taxonomy, Cells, DataFrame, list[Record]]:
    """Prune, merge, collapse and prune again: the sequence after the splits of a round."""
    log: list[Record] = []
    for step in (prune_pass, merge_pass, collapse_pass, prune_pass):
        if step is prune_pass:
            while True:
                tree, cells, members, new = prune_pass(members, tree, cells, s)
                log += new
                if not any(r.accepted for r in new):
                    break
        else:
            tree, cells, into, new = step(tree, cells, s)
            members, log = renamed(members, into), log + new
    return tree, cells, members, log


def refit(tree: Taxonomy, cells: Cells) -> Taxonomy:
    """Directions, concentrations and masses of all nodes but the root from what they and their descendants hold; who holds nothing keeps its fit."""
    nodes = {}
    for n in tree.nodes.values():
        m, t = cells.region(tree, n.name)
        mu, kappa = fit_of(m, t) if n.parent is not None and m > 0 else (n.mu, n.kappa)
        nodes[n.name] = replace(n, mu=tuple(mu), kappa=kappa, mass=cells.of.get(n.name, (0.0,))[0])
    return Taxonomy(nodes)
