"""Routing against a plain walk, proposals against recomputation, splits and their gates, leading directions."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyrank.operators import mixtures as X
from canopyrank.operators import moments as M
from canopyrank.operators import proposals as P
from canopyrank.operators import routing as R
from canopyrank.operators import taxonomy as T
from canopyrank.operators.topology import Node, Settings, Taxonomy


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def tree_of(rng, d=8, cross=False, cut=False):
    """Three levels; with cross links, and with directions over fewer components further up."""
    t = {"root": Node("root", None, 0)}
    for a in range(3):
        t[f"a{a}"] = Node(f"a{a}", "root", 1, tuple(unit(rng.normal(size=d // 2 if cut else d))), float(rng.uniform(1, 9)), float(rng.integers(0, 3)))
        for b in range(2 + a % 2):
            n = f"a{a}b{b}"
            t[n] = Node(n, f"a{a}", 2, tuple(unit(rng.normal(size=d))), float(rng.uniform(1, 9)), float(rng.integers(0, 3)))
            for c in range(2 if b == 0 else 0):
                t[f"{n}c{c}"] = Node(f"{n}c{c}", n, 3, tuple(unit(rng.normal(size=d))), float(rng.uniform(1, 9)), 1.0)
    if cross:
        t["a0b1"] = replace(t["a0b1"], also=("a1",))
        t["a2b0c0"] = replace(t["a2b0c0"], also=("a0b0",))
    return Taxonomy(t)


def plain_walk(x, tree, s, training):
    """Path by path, as long as no path runs under the floor before paths meet."""
    log, hits = {}, {}

    def cos(mu):
        y = x[: len(mu)]
        return round(float(np.dot(y / np.linalg.norm(y) if len(mu) < len(x) else y, mu)), 9)

    def go(name, logp):
        log[name] = np.logaddexp(log.get(name, -math.inf), logp)
        kids = tree.children(name)
        if not kids:
            return
        c, kbar, node = [cos(k.mu) for k in kids], sum(k.kappa for k in kids) / len(kids), tree.nodes[name]
        if node.mu and max(c) < round(tree.shrinkage(name) * cos(node.mu), 9):
            if training and s.residuals and node.depth >= 1:
                hits[name] = 1 / sum(math.exp(kbar * (y - max(c))) for y in c)
            return
        beam = [(k, y) for k, y in zip(kids, c) if round(max(c) - y, 9) <= s.margin]
        total = sum(math.exp(kbar * (y - max(c))) for _, y in beam)
        for k, y in beam:
            new = logp + kbar * (y - max(c)) - math.log(total)
            if new >= math.log(s.path_floor):
                go(k.name, new)

    go("root", 0.0)
    leaves = set(tree.leaves())
    crossed = {p for n in tree.nodes.values() for p in n.also}
    found = {n: v for n, v in log.items() if n in leaves}
    if s.residuals or not found:
        for n in log:
            if n not in leaves and not tree.nodes[n].also and n not in crossed and not any(k.name in log for k in tree.children(n)):
                found[n] = log[n]
    found = found or {"root": 0.0}
    total = sum(math.exp(v) for v in found.values())
    share = {n: math.exp(v) / total for n, v in found.items()}
    order = sorted(share, key=lambda n: (-round(share[n], 12), n))
    kept = [n for n in order if share[n] >= s.share_floor] or order[:1]
    kept = kept if training else kept[: s.assignments]
    if not s.residuals and not any(n in leaves for n in kept):
        return {"root": 1.0}, hits
    total = sum(share[n] for n in kept)
    return {n: share[n] / total for n in kept}, hits


@pytest.mark.parametrize("case", [dict(), dict(cross=True), dict(cut=True)])
@pytest.mark.parametrize("training,residuals", [(True, True), (False, True), (True, False)])
def test_walk_equals_a_plain_one(spark, case, training, residuals):
    rng = np.random.default_rng(7)
    tree, s = tree_of(rng, **case), Settings(margin=0.4, residuals=residuals, assignments=2, path_floor=1e-9)
    x = unit(rng.normal(size=(150, 8)))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    rows = R.walk(q, tree, s, training).collect()
    got = {i: ({}, {}) for i in range(len(x))}
    for r in rows:
        got[r.vec_id][r.residual][r.node] = r.weight
    for i, v in enumerate(x):
        for one, two in zip(got[i], plain_walk(v, tree, s, training)):
            assert one == pytest.approx(two, abs=1e-9), i
    assert all(abs(sum(g[0].values()) - 1) < 1e-9 for g in got.values())
    assert any(g[1] for g in got.values()) == (training and residuals) and any(len(g[0]) > 2 for g in got.values()) == training


def test_no_query_is_lost_where_all_paths_fall_under_the_floor(spark):
    nodes, level = {"r": Node("r", None, 0)}, ["r"]
    mu = tuple(np.eye(4)[0])
    for d in range(1, 8):
        level = [f"{p}{k}" for p in level for k in range(4)]
        nodes |= {n: Node(n, n[:-1], d, mu, 5.0) for n in level}
    q = spark.createDataFrame([(i, [0.6, 0.8, 0.0, 0.0]) for i in range(3)], "vec_id long, v array<double>")
    got = R.route(q, Taxonomy(nodes), Settings()).groupBy("vec_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert sorted((r.vec_id, round(r.w, 9)) for r in got) == [(0, 1.0), (1, 1.0), (2, 1.0)] and all(r.n == 1 for r in got)
    alone = R.route(q, Taxonomy({"r": Node("r", None, 0)}), Settings()).collect()
    assert [(r.node, r.weight) for r in alone] == [("r", 1.0)] * 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, node string, weight double, v array<double>")


def crowd(rng, centres, sizes, d, noise=0.15):
    c = np.linalg.qr(rng.normal(size=(d, d)))[0][: max(centres) + 1]
    return np.concatenate([unit(c[k] + noise * rng.normal(size=(n, d))) for k, n in zip(centres, sizes)])


@pytest.fixture(scope="module")
def grown(spark):
    """Members of two depth-1 nodes, one of which mixes three clusters, with shares; and small leaves below the other."""
    rng = np.random.default_rng(3)
    x = crowd(rng, (0, 1, 2, 3, 3, 3, 4), (40, 40, 40, 60, 60, 6, 30), 12)
    node = ["a"] * 120 + ["b.0"] * 60 + ["b.1"] * 60 + ["b.2"] * 6 + ["c.0"] * 30
    rows = [(i, n, 0.75 if i % 3 == 0 else 1.0, v.tolist()) for i, (n, v) in enumerate(zip(node, x))]
    rows += [(i, "b.0", 0.25, v) for i, n, w, v in rows if w < 1]
    members = frame(spark, rows)
    nodes = {"root": Node("root", None, 0), **{k: Node(k, "root", 1) for k in "abc"}, **{k: Node(k, k[0], 2) for k in ("b.0", "b.1", "b.2", "c.0")}}
    cells = P.Cells.read(members)
    return members, P.refit(Taxonomy(nodes), cells), cells, rows


def objective(rows):
    """From the members alone."""
    names = sorted({r[1] for r in rows})
    n = np.array([sum(r[2] for r in rows if r[1] == k) for k in names])
    t = np.stack([sum(r[2] * np.array(r[3]) for r in rows if r[1] == k) for k in names])
    return X.separation_of(n, t)


def mass(members):
    return {r.vec_id: round(r.w, 9) for r in members.groupBy("vec_id").agg(F.sum("weight").alias("w")).collect()}


def test_gains_equal_recomputation_and_mass_is_kept(grown):
    members, tree, cells, rows = grown
    s = Settings(epsilon=0.02, least=10)
    assert cells.objective() == pytest.approx(objective(rows))
    now, before = cells, objective(rows)
    t1, c1, m1, log = P.split_pass(members, tree, now, s)
    split = [r for r in log if r.kind == "split" and r.accepted]
    assert [r.site for r in split] == ["a"] and len(t1.children("a")) == 3 and t1.leaves() == ["a.0", "a.1", "a.2", "b.0", "b.1", "b.2", "c.0"]
    after = [tuple(r) for r in m1.select("vec_id", "node", "weight", "v").collect()]
    assert sum(r.gain for r in log if r.accepted) == pytest.approx(objective(after) - before) and c1.objective() == pytest.approx(objective(after))
    assert mass(m1) == mass(members)
    t2, c2, m2, log = P.prune_pass(m1, t1, c1, s)
    assert [(r.site, r.accepted) for r in log] == [("b.2", True)] and "b.2" not in t2.nodes
    rest = [tuple(r) for r in m2.select("vec_id", "node", "weight", "v").collect()]
    assert log[0].gain == pytest.approx(objective(rest) - objective(after)) and mass(m2) == mass(members)
    t3, c3, into, log = P.merge_pass(t2, c2, s)
    assert into == {"b.1": "b.0"} and [r.kind for r in log if r.accepted] == ["merge"] or into
    m3 = P.renamed(m2, into)
    merged = [tuple(r) for r in m3.select("vec_id", "node", "weight", "v").collect()]
    assert sum(r.gain for r in log if r.accepted) == pytest.approx(objective(merged) - objective(rest)) and mass(m3) == mass(members)
    assert m3.groupBy("vec_id", "node").count().filter("count > 1").count() == 0
    t4, c4, into, log = P.collapse_pass(t3, c3, s)
    assert into.get("c.0") == "c" and "c" in t4.leaves()
    m4 = P.renamed(m3, into)
    assert c4.objective() == pytest.approx(objective([tuple(r) for r in m4.select("vec_id", "node", "weight", "v").collect()])) and mass(m4) == mass(members)
    whole = P.optimise(m1, t1, c1, s)
    assert sorted(whole[0].nodes) == sorted(t4.nodes) and mass(whole[2]) == mass(members)


def test_a_rejected_proposal_changes_nothing(grown):
    members, tree, cells, _ = grown
    halves = {"c.0": [Node(f"c.0.{j}", "c.0", 3, tuple(np.eye(12)[j]), 2.0) for j in range(2)]}
    change = {"c.0": None, **P.outcomes(members, halves, Settings())["c.0"]}
    same, record = P.settle(cells, tree, "split", "c.0", change, 1e9)
    assert same is cells and not record.accepted and record.gain == pytest.approx(cells.put(change).objective() - cells.objective())
    share = cells.share(tree, "c.0")
    assert record.threshold == pytest.approx(1e9 * share) and 0 < share < 1 and cells.share(tree, "root") == 1.0
    m = cells.of["c.0"][0]
    assert share == pytest.approx(m * (m - 1) / sum(n * (n - 1) for n, _ in cells.of.values()))


def test_redundant_leaves_of_different_parents_become_one_with_both(spark):
    rng = np.random.default_rng(5)
    x = crowd(rng, (0, 0, 1, 2), (30, 30, 30, 30), 10, noise=0.03)
    rows = [(i, f"{'aabb'[i // 30] if i // 30 != 1 else 'b'}.{i // 30}", 1.0, v.tolist()) for i, v in enumerate(x)]
    members = frame(spark, rows)
    cells = P.Cells.read(members)
    nodes = {"root": Node("root", None, 0), "a": Node("a", "root", 1), "b": Node("b", "root", 1), **{k: Node(k, k[0], 2) for k in cells.of}}
    tree, after, into, log = P.merge_pass(P.refit(Taxonomy(nodes), cells), cells, Settings(least=5))
    assert into == {"b.1": "a.0"} and tree.nodes["a.0"].also == ("b",) and [k.name for k in tree.children("b")] == ["a.0", "b.2", "b.3"]
    assert [r.kind for r in log if r.accepted] == ["redundant"] and after.n == cells.n


@pytest.mark.parametrize("gate", ["mass", "ess", "depth", "diffuse", "open"])
def test_every_gate_before_a_split(spark, gate):
    s = Settings(least=10, max_depth=3)
    n = {"mass": 19, "ess": 10}.get(gate, 40)
    w = {"ess": 2.0}.get(gate, 1.0)
    members = frame(spark, [(i, "x", w, [1.0, 0.0]) for i in range(n)])
    node = Node("x", "root", 3 if gate == "depth" else 2, (1.0, 0.0), 0.1 if gate == "diffuse" else 5.0)
    tree = Taxonomy({"root": Node("root", None, 0), "x": node})
    assert [r.gate for r in P.gates(members, tree, s).collect()] == [gate]
    if gate == "diffuse":
        assert [r.gate for r in P.gates(members, tree, s, viable=["x"]).collect()] == ["open"]


def test_gates_of_the_split_itself():
    rng = np.random.default_rng(2)
    two = crowd(rng, (0, 1), (60, 60), 16)
    gate, size, total, sep = X.split(X.Held(two), 20, 4, 0.04)
    assert gate == "split" and sorted(size) == [60, 60] and sep > 0.5
    assert np.allclose(sorted(total.tolist()), sorted([two[:60].sum(axis=0).tolist(), two[60:].sum(axis=0).tolist()]))
    assert X.split(X.Held(crowd(rng, (0, 1), (60, 8), 16)), 20, 4, 0.04)[0] in ("floor", "collapsed")
    assert X.split(X.Held(np.repeat(np.eye(16)[:1], 50, axis=0)), 20, 4, 0.04)[0] == "floor"  # equal members go to one part
    assert X.split(X.Held(unit(rng.normal(size=(200, 16)))), 20, 4, 0.5)[0] == "separation"
    assert X.split(X.Held(two[:30]), 20, 4, 0.04)[0] == "collapsed"  # too few for two parts
    # parts that the projected mixture proposes but routing would not sustain
    weight = np.where(np.arange(120) < 60, 1.0, 0.3)
    assert X.split(X.Held(two, weight), 20, 4, 0.04)[0] == "floor" and X.split(X.Held(two, weight), 15, 4, 0.04)[0] == "split"


def test_residual_queries_make_a_diffuse_node_viable(spark):
    rng = np.random.default_rng(6)
    x = crowd(rng, (0, 1), (40, 40), 8)
    members = frame(spark, [(i, "ab"[i // 40], 1.0, v.tolist()) for i, v in enumerate(x)])
    tree = Taxonomy({"root": Node("root", None, 0), **{k: Node(k, "root", 1) for k in "ab"}})
    hits = lambda ids: spark.createDataFrame([(i, "a", 0.5) for i in ids], "vec_id long, node string, confidence double")
    run = lambda ids: P.viable_residuals(hits(ids), members.select("vec_id", "v"), tree, P.Cells.read(members), Settings(least=10))
    assert run(range(20)) == {"a"} and run(range(5)) == set() and run(range(40, 60)) == set()


def test_leading_directions_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(9)
    x = {n: unit(rng.normal(size=(k, 10)) * np.linspace(3, 0.5, 10)) for n, k in (("p", 300), ("q", 40), ("one", 1))}
    w = {n: rng.uniform(0.2, 2, size=len(v)) for n, v in x.items()}
    ids = iter(range(1000))
    m = spark.createDataFrame([(next(ids), n, float(w[n][i]), v.tolist()) for n in x for i, v in enumerate(x[n])], "vec_id long, node string, weight double, v array<double>").repartition(5)
    moments = M.second_moments(m)
    basis = {r.node: r for r in M.directions(moments, 4).collect()}
    for r in moments.collect():
        v, u = x[r.node], w[r.node]
        assert r.n == pytest.approx(u.sum()) and np.allclose(r.total, u @ v) and np.allclose(r.moment, (v * u[:, None]).T @ v)
    for n in ("p", "q"):
        mean = w[n] @ x[n] / w[n].sum()
        right = np.linalg.svd((x[n] - mean) * np.sqrt(w[n])[:, None])[2][:4]
        got = np.array(basis[n].directions)
        assert np.allclose(np.abs((got * right).sum(axis=1)), 1, atol=1e-6) and (got[np.arange(4), np.abs(got).argmax(axis=1)] > 0).all()
    y = {r.vec_id: r.y for r in M.projected(m, M.directions(moments, 4)).collect()}
    want = X.project(x["p"], (np.array(basis["p"].mean), np.array(basis["p"].directions)))
    assert len(y) == 341 and all(np.allclose(y[i], want[i]) for i in range(300)) and np.allclose(y[340], 0)


def test_spread_gives_the_sums_of_held(spark):
    rng = np.random.default_rng(1)
    x, w = crowd(rng, (0, 1, 2), (70, 50, 60), 9), rng.uniform(0.1, 1, size=180)
    df = spark.createDataFrame([(i, v.tolist(), float(u)) for i, (v, u) in enumerate(zip(x, w))], "vec_id long, v array<double>, weight double").repartition(4)
    one, two = X.Held(x, w), X.Spread(df)
    assert two.count == 180 and two.n == pytest.approx(one.n) and np.allclose(one.whole, two.whole)
    basis = X.leading(*one.moments(), 5)
    assert all(np.allclose(a, b) for a, b in zip(basis, X.leading(*two.moments(), 5)))
    a, b = X.split(one, 5.0, 4, 0.02), X.split(two, 5.0, 4, 0.02)
    assert a[0] == b[0] == "split" and np.allclose(a[1], b[1]) and np.allclose(a[2], b[2]) and a[3] == pytest.approx(b[3])


def test_evolution_keeps_every_query_and_finds_what_shared_members_hold(spark):
    """A mixed category splits although part of its members are shared with another node."""
    rng = np.random.default_rng(11)
    x = crowd(rng, (0, 1, 2, 3), (50, 50, 50, 50), 16)
    q = spark.createDataFrame([(i, i // 100, v.tolist()) for i, v in enumerate(x)], "vec_id long, category int, v array<double>")
    tree, members, history = T.evolve(q, Settings(least=10, rounds=4, margin=2.0))
    assert len(tree.leaves()) == 4 and history[-1]["edits"] == 0 and history[0]["accepted"] == 2
    assert set(mass(members.withColumn("v", F.lit(0))).values()) == {1.0} and members.select("vec_id").distinct().count() == 200
