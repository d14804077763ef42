"""Chains, collapsing and keyed stores on small tables."""

from canopyrank.operators import graph
from canopyrank.sources import store


def test_chains_are_runs_of_single_children(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "a1"), ("a1", "a2"), ("a2", "a3"), ("b", "b1"), ("b1", "b2"), ("b1", "b3")], "p string, c string")
    assert {(r["head"], r["length"]) for r in graph.chains(e, 1).collect()} == {("a", 3), ("b", 1)}
    assert [tuple(r) for r in graph.chains(e, 3).collect()] == [("a", 3)]


def test_sole_children_are_folded_into_their_parents(spark):
    rows = [("root", "a"), ("root", "b"), ("a", "x"), ("x", "y"), ("y", "y1"), ("y", "y2"), ("b", "s"), ("b", "t"), ("t", "u"), ("s", "u")]
    got = graph.collapse(spark.createDataFrame(rows, "p string, c string"), 1)
    # x and y fold into a; u has two parents and stays
    assert {tuple(r) for r in got.collect()} == {("root", "a"), ("root", "b"), ("a", "y1"), ("a", "y2"), ("b", "s"), ("b", "t"), ("t", "u"), ("s", "u")}


def test_upserts_replace_by_key_and_a_cleared_snapshot_is_gone(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    store.upsert(rows((1, "a"), (None, "n")), root, ["k"])
    store.upsert(rows((1, "b"), (2, "c")), root, ["k"])
    assert {tuple(r) for r in store.read(spark, root).collect()} == {(1, "b"), (2, "c"), (None, "n")}
    snaps = str(tmp_path / "s")
    store.write_snapshots(spark.createDataFrame([("x", 1), ("y", 2)], "snapshot_id string, v long"), snaps)
    store.clear(spark, snaps, "x")
    assert [r.v for r in store.read(spark, snaps).collect()] == [2]
