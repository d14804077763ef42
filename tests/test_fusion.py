"""Fusing nodes against a plain graph."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyrank.operators import fusion as U


def reachable(edges, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for p, c in edges:
            if p == x and c not in seen:
                seen.add(c)
                todo.append(c)
    return seen


def plain(edges, into):
    kind = {}
    for p, c, k in edges:
        p, c = into.get(p, p), into.get(c, c)
        if p != c:
            kind[p, c] = "TREE" if "TREE" in (k, kind.get((p, c))) else "CROSS"
    depth, level, d = {"root": 0}, {"root"}, 0
    while level:
        d += 1
        level = {c for p, c in kind if p in level} - set(depth)
        depth |= dict.fromkeys(level, d)
    kind = {(p, c): k for (p, c), k in kind.items() if p not in reachable(kind, c) or depth[p] < depth[c]}
    idle = {(p, c) for p, c in kind if c in into.values() and any(o in reachable(kind, p) for o, x in kind if x == c and o != p)}
    return sorted((p, c, k) for (p, c), k in kind.items() if (p, c) not in idle)


def some_dag(seed, n=14):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(i)}" if i > 2 else "root", f"n{i}", "TREE") for i in range(n)]
    edges += [(f"n{i}", f"n{j}", "CROSS") for i in range(n) for j in range(i + 1, n) if rng.random() < 0.12]
    names = [f"n{i}" for i in range(n)]
    rng.shuffle(names)
    return sorted(set(edges)), {names[0]: names[1], names[2]: names[1], names[3]: names[4]}


@pytest.mark.parametrize("seed", range(4))
def test_contraction_equals_a_plain_graph(spark, seed):
    edges, into = some_dag(seed)
    got = U.contract(spark.createDataFrame(edges, "p string, c string, kind string"), spark.createDataFrame(list(into.items()), "node string, target string")).collect()
    got = sorted(map(tuple, got))
    assert got == plain(edges, into)
    pairs = [(p, c) for p, c, _ in got]
    assert all(c not in reachable(pairs, c) for c in {c for _, c in pairs})
    assert reachable(pairs, "root") == {into.get(c, c) for _, c, _ in edges} - {"root"}


def test_members_of_a_fused_node_go_to_its_best_child_and_keep_their_mass(spark):
    edges = [("root", "a", "TREE"), ("root", "b", "TREE"), ("a", "x", "TREE"), ("b", "y", "TREE"), ("root", "c", "TREE"), ("root", "d", "TREE")]
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    fits = [("a", 3.0, x, 2.0), ("b", 1.0, y, 6.0), ("x", 3.0, x, 4.0), ("y", 0.0, y, 5.0), ("c", 1.0, x, 1.0), ("d", 1.0, y, 3.0)]
    members = [(1, "a", 0.5, y), (1, "b", 0.25, y), (1, "y", 0.25, y), (2, "b", 1.0, x), (3, "c", 0.5, x), (3, "d", 0.5, x), (4, "x", 1.0, y), (5, "a", 1.0, [1.0, 1.0, 0.0])]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    e, m, f = U.fuse(df(edges, "p string, c string, kind string"), df(members, "vec_id long, node string, weight double, v array<double>"),
                     df(fits, "node string, n double, mu array<double>, kappa double"), df([("b", "a"), ("d", "c")], "node string, target string"))
    assert sorted(map(tuple, e.collect())) == [("a", "x", "TREE"), ("a", "y", "TREE"), ("root", "a", "TREE"), ("root", "c", "TREE")]
    # at a tie the first name; leaves that are fused keep theirs
    assert sorted((r.vec_id, r.node, r.weight) for r in m.collect()) == [(1, "y", 1.0), (2, "x", 1.0), (3, "c", 1.0), (4, "x", 1.0), (5, "x", 1.0)]
    got = {r.node: r for r in f.collect()}
    assert set(got) == {"a", "x", "y", "c"} and got["a"].n == 4 and got["a"].kappa == pytest.approx((3 * 2 + 6) / 4) and got["c"].kappa == 2.0
    assert np.allclose(got["a"].mu, np.array([3, 1, 0]) / np.sqrt(10))


def test_nothing_to_fuse(spark):
    edges = spark.createDataFrame([("root", "a", "TREE"), ("a", "b", "CROSS")], "p string, c string, kind string")
    none = spark.createDataFrame([], "node string, target string")
    assert sorted(map(tuple, U.contract(edges, none).collect())) == [("a", "b", "CROSS"), ("root", "a", "TREE")]
