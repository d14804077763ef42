"""Routing of queries through a taxonomy: memberships and residual hits from one walk.

Nodes are a small table that reaches every task; queries are read once, batch by
batch, without a shuffle. A query descends from the root in log space. At an
inner node with a direction of its own it stops where no child fits as well as
the node does (the gate), which in training is recorded as a residual hit.
Otherwise it goes on to every child within a margin of the best, each with its
share. No query is lost: where the walk ended at inner nodes, these are
candidates too, and the root is where nothing else is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopyrank.operators.topology import Settings, Taxonomy

#: Numbers of a batch's matrix of rows and nodes.
CELLS = 1 << 22
DIGITS = 9


@dataclass
class Plan:
    """A topology as arrays, nodes in order of their names."""

    names: list[str]
    root: int
    inner: list[int]  # parents before children
    kids: dict[int, np.ndarray]
    mu: list[np.ndarray]
    kappa: np.ndarray
    shrink: dict[int, float]
    depth: np.ndarray
    bridge: np.ndarray


def plan_of(tree: Taxonomy) -> Plan:
    names = sorted(tree.nodes)
    at = {n: i for i, n in enumerate(names)}
    kids: dict[int, list[int]] = {}
    for n in tree.nodes.values():
        for p in dict.fromkeys(x for x in (n.parent, *n.also) if x is not None):
            kids.setdefault(at[p], []).append(at[n.name])
    waits = {i: 0 for i in range(len(names))}
    for k in kids.values():
        for c in k:
            waits[c] += 1
    ready, order = [i for i in waits if not waits[i]], []
    while ready:
        i = ready.pop()
        order.append(i)
        for c in kids.get(i, ()):
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    crossed = {p for n in tree.nodes.values() for p in n.also}
    bridge = np.array([bool(tree.nodes[n].also) or n in crossed for n in names])
    return Plan(
        names, at[tree.root], [i for i in order if i in kids], {i: np.array(sorted(k)) for i, k in kids.items()}, [np.array(tree.nodes[n].mu, dtype=float) for n in names],
        np.array([tree.nodes[n].kappa for n in names]), {i: tree.shrinkage(names[i]) for i in kids}, np.array([tree.nodes[n].depth for n in names]), bridge)


def _dots(x: np.ndarray, mus: list[np.ndarray]) -> np.ndarray:
    """Inner products with directions, each over as many leading components as it has; the rows are scaled to length one there."""
    out = np.zeros((len(x), len(mus)))
    for d in {len(m) for m in mus}:
        at = [k for k, m in enumerate(mus) if len(m) == d]
        if d:
            part = x[:, :d]
            if d < x.shape[1]:
                part = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300)
            out[:, at] = part @ np.stack([mus[k] for k in at]).T
    return np.round(out, DIGITS)


def steps(c: np.ndarray, kappa: np.ndarray, margin: float) -> np.ndarray:
    """Log shares of children within the margin of the best, from cosines and the children's mean concentration; -inf for the others."""
    best = c.max(axis=1, keepdims=True)
    f = max(float(kappa.mean()), 1e-9) * (c - best)
    f = np.where(np.round(best - c, DIGITS) <= margin, f, -np.inf)
    return f - np.log(np.exp(f).sum(axis=1, keepdims=True))


def trace(x: np.ndarray, plan: Plan, s: Settings, training: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, node, weight and whether it is a residual hit (its weight is then the best child's share)."""
    n, m = len(x), len(plan.names)
    logp = np.full((n, m), -np.inf)
    logp[:, plan.root] = 0.0
    hits = []
    for node in plan.inner:
        rows = np.flatnonzero(logp[:, node] > -np.inf)
        if not len(rows):
            continue
        kids = plan.kids[node]
        c = _dots(x[rows], [plan.mu[k] for k in kids])
        if len(plan.mu[node]):
            own = _dots(x[rows], [plan.mu[node]])[:, 0]
            stay = c.max(axis=1) < np.round(plan.shrink[node] * own, DIGITS)
            if training and s.residuals and plan.depth[node] >= 1 and stay.any():
                f = max(float(plan.kappa[kids].mean()), 1e-9) * (c[stay] - c[stay].max(axis=1, keepdims=True))
                hits.append((rows[stay], np.full(stay.sum(), node), 1 / np.exp(f).sum(axis=1)))
            rows, c = rows[~stay], c[~stay]
        if len(rows):
            new = logp[rows, node][:, None] + steps(c, plan.kappa[kids], s.margin)
            new = np.where(new >= np.log(s.path_floor), new, -np.inf)
            logp[np.ix_(rows, kids)] = np.logaddexp(logp[np.ix_(rows, kids)], new)
    reached = logp > -np.inf
    leaf = np.ones(m, dtype=bool)
    leaf[plan.inner] = False
    found = reached & leaf
    ended = np.zeros_like(found)
    for node in plan.inner:
        if not plan.bridge[node]:
            ended[:, node] = reached[:, node] & ~reached[:, plan.kids[node]].any(axis=1)
    if not s.residuals:
        ended &= ~found.any(axis=1, keepdims=True)
    found |= ended
    nothing = ~found.any(axis=1)
    found[nothing, plan.root], logp[nothing, plan.root] = True, 0.0
    score = np.where(found, logp, -np.inf)
    share = np.exp(score - score.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    kept = np.where(share >= s.share_floor, share, 0.0)
    none = ~kept.any(axis=1)
    first = np.round(share, 12).argmax(axis=1)
    kept[none, first[none]] = share[none, first[none]]
    if not training and s.assignments < m:
        place = np.argsort(np.argsort(-np.round(kept, 12), axis=1, kind="stable"), axis=1)
        kept[place >= s.assignments] = 0.0
    if not s.residuals:  # who reached no leaf is the root's
        lost = ~(kept[:, leaf] > 0).any(axis=1)
        kept[lost] = 0.0
        kept[lost, plan.root] = 1.0
    kept /= kept.sum(axis=1, keepdims=True)
    row, node = np.nonzero(kept)
    parts = [(row, node, kept[row, node], np.zeros(len(row), dtype=bool)), *((r, k, w, np.ones(len(r), dtype=bool)) for r, k, w in hits)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def walk(queries: DataFrame, tree: Taxonomy, s: Settings, training: bool = False, vectors: bool = False) -> DataFrame:
    """vec_id, node, weight, residual: memberships, whose weights sum to one for every query, and in training residual hits.

    In training every candidate with the floor's share of the query counts; otherwise `assignments` of them at most.
    vectors: each row has the query's v as well.
    """
    plan = plan_of(tree)
    rows = queries.select("vec_id", "v")
    block = max(1, CELLS // max(1, len(plan.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(plan.names, pa.string())
        for b in batches:
            for at in range(0, len(b), block):
                some = b.slice(at, block)
                x = np.asarray(some.column("v").flatten(), dtype=float).reshape(len(some), -1)
                row, node, weight, residual = trace(x, plan, s, training)
                out = [some.column("vec_id").take(pa.array(row)), names.take(pa.array(node)), pa.array(weight, pa.float64()), pa.array(residual, pa.bool_())]
                more = [some.column("v").take(pa.array(row))] if vectors else []
                yield pa.RecordBatch.from_arrays(out + more, ["vec_id", "node", "weight", "residual", *(["v"] if vectors else [])])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, node string, weight double, residual boolean" + (f", v {kind['v']}" if vectors else ""))


def route(queries: DataFrame, tree: Taxonomy, s: Settings, training: bool = False) -> DataFrame:
    """The memberships of walk(): vec_id, node, weight."""
    return walk(queries, tree, s, training).filter("NOT residual").select("vec_id", "node", "weight")


def residual_hits(queries: DataFrame, tree: Taxonomy, s: Settings) -> DataFrame:
    """Where the gate held a query back in training: vec_id, node, confidence."""
    return walk(queries, tree, s, True).filter("residual").selectExpr("vec_id", "node", "weight AS confidence")
