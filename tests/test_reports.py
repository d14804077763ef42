"""Level-by-level fits, the routing report, names of nodes, the catalogue and the keyed store, against plain loops and broken-off runs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyrank import storage
from canopyrank.operators import fitting, labels, mixtures
from canopyrank.operators import routing_report as O
from canopyrank.sources import catalogue, sinks, store

TREE = [("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("r", "void")]


def unit(x):
    return x / np.linalg.norm(x)


def plain_fit(members, depth, parents, d, old):
    """A node's region is found by walking down, its members one by one."""
    kids = defaultdict(list)
    for p, c in TREE:
        kids[p].append(c)

    def below(n):
        return {n}.union(*[below(c) for c in kids[n]])

    out = {}
    for n in sorted(depth, key=lambda k: (depth[k], k)):
        rows = [(w, np.array(v)) for node, _, w, v in members if node in below(n)]
        mass, ps = sum(w for w, _ in rows), parents[n]
        axis = np.eye(d)[0]
        prior = max(1.0, np.mean([out[p]["kappa"] for p in ps]) if ps else 10.0)
        m0 = unit(sum(out[p]["mu"] for p in ps)) if ps else axis
        if mass <= 1e-4:
            out[n] = dict(n=mass, mu=axis, kappa=1e-3, alpha=1.0, m=axis, k=1.0, nu=d + 2.0, lam=np.full(d, 1 / d))
            continue
        total = sum(w * v for w, v in rows)
        mean, mu = total / mass, unit(total)
        if n in old and np.dot(old[n], mu) >= 0.9975:
            mu = np.array(old[n])
        x = d / mass
        alpha = 1.0 if mass < 2 else 0.0 if x <= 2 else 1.0 if x >= 10 else (x - 2) / 8
        raw = mixtures.kappa_of(np.linalg.norm(total) / mass, math.floor(round(mass, 6)), d)
        kappa = prior if mass < 2 else (1 - alpha) * raw + alpha * prior
        lam = 1 / (prior * d) + sum(w * (v - mean) ** 2 for w, v in rows) + mass / (1 + mass) * (mean - m0) ** 2
        out[n] = dict(n=mass, mu=mu, kappa=kappa, alpha=alpha, m=(m0 + mass * mean) / (1 + mass), k=1 + mass, nu=d + 2 + mass, lam=lam)
    return out


@pytest.mark.parametrize("hold", [False, True])
def test_level_fit_equals_a_plain_loop(spark, hold):
    rng, d = np.random.default_rng(4), 5
    members = [(n, i, float(w), unit(rng.normal(size=d) + 2 * np.eye(d)[k]).tolist()) for k, (n, size) in enumerate((("x", 30), ("y", 4), ("z", 1), ("a", 2), ("r", 1))) for i, w in enumerate(rng.uniform(0.2, 1, size=size))]
    depth = {"r": 0, "a": 1, "b": 1, "void": 1, "x": 2, "y": 2, "z": 2}
    parents = {n: [p for p, c in TREE if c == n] for n in depth}
    fit = lambda prev: fitting.fit_levels(
        spark.createDataFrame(members, "node string, vec_id long, weight double, v array<double>").repartition(3), spark.createDataFrame(list(depth.items()), "node string, depth int"), spark.createDataFrame(TREE, "p string, c string"), d, prev).collect()
    old = {}
    if hold:
        base = plain_fit(members, depth, parents, d, {})
        old = {"x": unit(base["x"]["mu"] + 0.01).tolist(), "a": (-base["a"]["mu"]).tolist()}
    got = fit(spark.createDataFrame([(k, v) for k, v in old.items()], "node string, mu array<double>") if hold else None)
    want = plain_fit(members, depth, parents, d, old)
    assert {r.node for r in got} == set(depth)
    for r in got:
        w = want[r.node]
        assert np.allclose([r.n, r.kappa, r.alpha, r.niw_kappa, r.niw_nu], [w["n"], w["kappa"], w["alpha"], w["k"], w["nu"]]), r.node
        assert np.allclose(r.mu, w["mu"]) and np.allclose(r.niw_m, w["m"]) and np.allclose(r.niw_lambda, w["lam"]), r.node


def test_report_of_the_routing_table(spark):
    """m1 to A and B, p1 to B, m2 to B, p2 nowhere."""
    profiles = spark.createDataFrame([("A", "math", 1.0, 1), ("B", "physics", 1.0, 1)], "node string, domain string, purity double, depth int")
    routes = spark.createDataFrame([("m1", "A", 0.9), ("m1", "B", 0.1), ("p1", "B", 0.8), ("m2", "B", 0.7), ("p2", "elsewhere", 1.0)], "vec_id string, node string, weight double")
    truth = spark.createDataFrame([("m1", "math"), ("m2", "math"), ("p1", "physics"), ("p2", "physics")], "vec_id string, category string")
    r = O.report(routes, profiles, truth).first()
    assert (r.queries, r.top1, r.any_match, r.no_match, r.purity, r.depth, r.mean_matches, r.median_matches, r.multi_leaf) == (4, 0.5, 0.5, 0.25, 1.0, 1.0, 1.0, 1.0, 0.25)
    assert r.macro_f1 == pytest.approx((2 / 3 + 0.5) / 2) and r.depth_corr == 0 and r.posterior == pytest.approx((1 + 0.8 + 0.7) / 3)
    z, p = 1.96, 0.5
    mid, half = p + z * z / 8, z * math.sqrt(p * (1 - p) / 4 + z * z / 64)
    assert (r.low, r.high) == pytest.approx(((mid - half) / (1 + z * z / 4), (mid + half) / (1 + z * z / 4)))
    found = O.matches(routes, profiles, truth)
    by = {x.domain: (x.support, x.prec, x.recall, x.f1) for x in O.per_domain(found).collect()}
    assert by["math"] == pytest.approx((2, 1.0, 0.5, 2 / 3)) and by["physics"] == pytest.approx((2, 0.5, 0.5, 0.5))
    e = O.calibration_error(found).first()
    assert e.ece == pytest.approx((abs(1 - 0.9) + abs(1 - 0.8) + abs(0 - 0.7)) / 3) and e.bins == 3
    b = [(1 - 0.9) ** 2 + 0.1**2, (1 - 0.8) ** 2, 1 + 0.7**2, 1.0]
    assert O.brier(routes, profiles, truth).first().brier == pytest.approx(sum(b) / 4)


def test_report_of_no_queries_is_zero(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    r = O.report(none("vec_id long, node string, weight double"), none("node string, domain string, purity double, depth int"), none("vec_id long, category string")).first()
    assert all(x == 0 for x in r)
    assert O.brier(none("vec_id long, node string, weight double"), none("node string, domain string, purity double, depth int"), none("vec_id long, category string")).first()[0] == 0


def test_profiles_take_the_commonest_category(spark):
    m = spark.createDataFrame([(1, "A", 1.0), (2, "A", 0.5), (3, "A", 0.5), (4, "B", 0.4)], "vec_id long, node string, weight double")
    c = spark.createDataFrame([(1, "q"), (2, "p"), (3, "p"), (4, "p")], "vec_id long, category string")
    got = O.leaf_profiles(m, c, spark.createDataFrame([("A", 2), ("B", 1)], "node string, depth int"), 0.5).collect()
    assert [tuple(r) for r in got] == [("A", "p", 0.5, 2)]


def test_names_equal_a_plain_count(spark):
    texts = [("a/1", "Alpha alpha beta common shared ñandú"), ("a/1", None), ("a/2", "gamma gamma beta common shared it"), ("b/1", "delta common common other"), ("b/2", ""), ("b/2", "delta epsilon other other x1y")]
    nodes = [("a/1", "a", 2), ("a/2", "a", 2), ("a/3", "a", 2), ("b/1", "b", 2), ("b/2", "b", 2), ("a", "root", 1), ("b", "root", 1), ("root", None, 0)]
    parent = {n: p for n, p, _ in nodes}
    count = defaultdict(Counter)
    for n, t in texts:
        words = [w for w in re.split(r"[^a-zñú]+", (t or "").lower()) if len(w) >= 3]
        while n:
            count[n].update(words)
            n = parent[n]
    want, taken = [], defaultdict(set)
    for depth in (2, 1, 0):
        for n, p, d in nodes:
            if d == depth and count[n]:
                group = [k for k, q, _ in nodes if q == p and count[k]]
                mean = sum(sum(count[k].values()) for k in group) / len(group)
                score = {t: c / sum(count[n].values()) * math.log(1 + mean / sum(count[k][t] for k in group)) for t, c in count[n].items() if t not in taken[n]}
                best = sorted(score, key=lambda t: (-round(score[t], 12), t))[:2]
                want += [(n, depth, i + 1, t, pytest.approx(score[t])) for i, t in enumerate(best)]
                for q in (p, parent.get(p)):
                    taken[q] |= set(best) | (taken[n] if q == p else set())
    got = labels.top_terms(spark.createDataFrame(texts, "node string, text string"), spark.createDataFrame(nodes, "node string, parent string, depth int"), top=2).select("node", "depth", "place", "term", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[:4])


def edges(spark, n):
    return spark.range(n).selectExpr("CAST(id AS STRING) AS p", "CAST(id + 1 AS STRING) AS c")


def test_catalogue_lists_renames_notes_and_deletes(spark, tmp_path):
    c = catalogue.Catalogue(spark, f"file://{tmp_path}/cat")
    assert c.list() == []
    one = c.save("s", {"edges": edges(spark, 3), "nodes": edges(spark, 4)}, "first")
    two = c.save("s", {"edges": edges(spark, 5)})
    assert c.pin("s") == two != one and c.load("s", "edges").count() == 5 and c.load("s", "nodes", one).count() == 4
    c.save("t", {"edges": edges(spark, 1)})
    c.rename("s", "u")
    c.update("u", "noted")
    assert [(x["name"], x["version"], x["note"], x["tables"]) for x in c.list()][1:] == [("u", two, "noted", ["edges"])] and c.list()[0]["name"] == "t"
    for bad in (lambda: c.rename("u", "t"), lambda: c.save("v", {"a/b": edges(spark, 1)}), lambda: c.save("", {"a": edges(spark, 1)})):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: c.pin("s"), lambda: c.delete("s"), lambda: c.update("s", ""), lambda: c.rename("s", "w"), lambda: c.load("t", "nodes")):
        with pytest.raises(KeyError):
            bad()
    c.delete("t")
    assert c.load("t", "edges", one).count() == 3  # a pinned version stays
    assert len(c.vacuum()) == 2 and c.load("u", "edges").count() == 5 and storage.files(spark, f"{c.root}/versions") == [two]


def test_a_run_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    c = catalogue.Catalogue(spark, f"file://{tmp_path}/cat")
    old = c.save("s", {"edges": edges(spark, 3)})
    monkeypatch.setattr(catalogue, "move", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # after the tables are written, before they are published
        c.save("s", {"edges": edges(spark, 9)})
    monkeypatch.undo()
    assert c.pin("s") == old and c.load("s", "edges").count() == 3 and len(storage.files(spark, f"{c.root}/versions")) == 2
    c.vacuum()
    assert storage.files(spark, f"{c.root}/versions") == [old] and len(storage.files(spark, f"{c.root}/manifests")) == 1


def test_changes_of_two_runs_are_both_kept(spark, tmp_path, monkeypatch):
    c, other = (catalogue.Catalogue(spark, f"file://{tmp_path}/cat") for _ in range(2))
    c.save("a", {"edges": edges(spark, 1)})
    write, once = catalogue.write_text, []

    def meanwhile(*args):
        if not once:
            once.append(1)
            other.update("a", "by the other")  # takes the number that this run has read
        write(*args)

    monkeypatch.setattr(catalogue, "write_text", meanwhile)
    c.save("b", {"edges": edges(spark, 2)})
    assert [(x["name"], x["note"]) for x in c.list()] == [("a", "by the other"), ("b", "")]


def test_upsert_that_breaks_off_leaves_a_table(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    got = lambda: sorted(map(tuple, store.read(spark, root).collect()))
    store.upsert(rows((1, "a"), (2, "b")), root, ["k"])
    store.upsert(rows((2, "c"), (3, "d")), root, ["k"])
    assert got() == [(1, "a"), (2, "c"), (3, "d")]
    for last in (1, 2):  # stop before the first or the second move
        seen, move = [], store.move

        def stop(*a):
            seen.append(a)
            if len(seen) == last:
                raise KeyboardInterrupt
            move(*a)

        monkeypatch.setattr(store, "move", stop)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(rows((1, "z")), root, ["k"])
        monkeypatch.setattr(store, "move", move)
        assert got() == [(1, "a"), (2, "c"), (3, "d")]
    store.upsert(rows((1, "z")), root, ["k"])
    assert got() == [(1, "z"), (2, "c"), (3, "d")] and not storage.exists(spark, f"{root}.old")


def test_a_long_leaderboard_is_refused(spark, monkeypatch):
    board = spark.range(5).selectExpr("CAST(id AS STRING) AS model", "CAST(id AS DOUBLE) AS score")
    assert sinks.latex_leaderboard(board).count("&") == 12
    monkeypatch.setattr(sinks, "MOST_MODELS", 4)
    with pytest.raises(ValueError):
        sinks.latex_leaderboard(board)
