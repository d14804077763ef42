"""Tasks of wide steps hold a bounded number of rows, and steps that once read or held too much against plain ones."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyrank import storage
from canopyrank.operators import graph, labels, mixtures, proposals, ratings, taxonomy
from canopyrank.plans import registry
from tests.test_graph import plain

PARTS = [(i, f"part {i}", f"Brand#{i % 3}", "SMALL" if i % 2 else "LARGE", i % 50, 900.0 + i) for i in range(40)]
LINES = [(o, (o * 7 + n) % 40, n, float(n)) for o in range(300) for n in range(1, 2 + o % 6)]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("shop"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", ["grf20_pass_through_chains", "win09_deepest_node", "agg20_region_mass", "clu20_child_creation", "agg21_region_weights"])
def test_partitions_grow_with_the_rows(spark, shop, monkeypatch, name):
    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    plan = registry.queries()[name](spark, shop)._jdf.queryExecution().toString()
    assert max(int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)) >= len(LINES) // 50 + 1


def test_numbered_chains_equal_following_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(k)) for g, k in zip(rng.integers(0, 30, 220), rng.integers(-3, 9, 220))]
    edges = {(f"o{g}" if k == 1 else f"o{g}l{k - 1}", f"o{g}l{k}") for g, k in rows}
    steps = spark.createDataFrame([*rows, *rows[:20], (31, None)], "group long, k int")
    for least in (1, 3):
        got = [(f"o{r.group}" + ("" if r.k is None else f"l{r.k}"), r.length) for r in graph.numbered_chains(steps, 1, least).collect()]
        assert sorted(got) == plain(edges, least)


def test_a_log_is_packed_in_order_and_rated_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ratings, "TASK_ROWS", 100)
    rng = np.random.default_rng(4)
    n = 700
    log = pd.DataFrame({"domain": rng.choice(["d", "e", "global"], n), "ts": rng.integers(0, 90, n), "event_id": rng.permutation(n), "a": rng.choice(list("xyz"), n), "b": rng.choice(list("uvw"), n), "wa": rng.integers(0, 2, n) * 1.0, "wb": rng.integers(0, 2, n) * 1.0, "conf": rng.random(n)})
    df = spark.createDataFrame(log)
    assert ratings.packed(ratings.with_anchor(df)).count() < 200
    got = {(r.domain, r.agent): (r.mu, r.sigma) for r in ratings.ratings(df).collect()}
    want = {}
    log = log.sort_values(["ts", "event_id"])
    for d in ("d", "e", "global"):
        some = log if d == "global" else log[log["domain"] == d]
        share = np.where((some["domain"] == d), 1.0, ratings.GLOBAL_SHARE)
        want |= {(d, k): v for k, v in ratings.rate_log(zip(some["a"], some["b"], some["wa"] - some["wb"], some["conf"] * share)).items()}
    assert got == want


def by_item(truth, one, two, rounds):
    """Every item swapped and ranked for itself."""
    def rho(m):
        r, t = pd.Series(m).rank().to_numpy(), pd.Series(truth).rank().to_numpy()
        return np.corrcoef(r, t)[0, 1] if len(set(m)) > 1 else 0.0

    base, random = rho(one) - rho(two), np.random.default_rng(42)
    swaps = [random.random(len(truth)) < 0.5 for _ in range(rounds)]
    return base, [abs(rho(np.where(s, one, two)) - rho(np.where(s, two, one))) >= abs(base) - 1e-12 for s in swaps]


def test_swaps_by_cell_equal_swaps_by_item_and_rounds_can_be_shared_out(spark):
    truth, one, two = np.random.default_rng(8).integers(0, 5, (3, 80)).astype(float)
    base, hits = by_item(truth, one, two, 120)
    assert ratings.permutation_hits(truth, one, two, 120) == (pytest.approx(base), sum(hits))
    assert [ratings.permutation_hits(truth, one, two, 40, first=f)[1] for f in (0, 40, 80)] == [sum(hits[f : f + 40]) for f in (0, 40, 80)]
    items = spark.createDataFrame(pd.DataFrame({"k": "g", "t": truth, "x": one, "y": two}))
    order = np.lexsort((two, one, truth))
    got = ratings.permutation_test(items, "k", "t", "x", "y", 120).collect()
    assert [(r.delta, r.p) for r in got] == [ratings.permutation_p(truth[order], one[order], two[order], 120)]


def test_texts_are_counted_once_for_all_levels(spark, monkeypatch):
    tags, write = [], labels.materialise
    monkeypatch.setattr(labels, "materialise", lambda df, tag: tags.append(tag) or write(df, tag))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        seen.add(1)
        return t

    texts = spark.createDataFrame([("a", "one two three"), ("b", "two two four")], "node string, text string").coalesce(1)
    nodes = spark.createDataFrame([("a", "r", 1), ("b", "r", 1), ("r", None, 0)], "node string, parent string, depth int")
    assert labels.top_terms(texts.select("node", read.asNondeterministic()("text").alias("text")), nodes).count() > 0
    assert "counts" in tags and seen.value == 2


def test_cells_are_summed_by_task_before_rows_are_shuffled(spark):
    rng = np.random.default_rng(9)
    x, w, node = rng.normal(size=(400, 6)), rng.random(400), rng.choice(list("abc"), 400)
    members = spark.createDataFrame([(n, v.tolist(), float(u)) for n, v, u in zip(node, x, w)], "node string, v array<double>, weight double")
    got = proposals.cell_sums(members.repartition(3))
    assert set(got) == set("abc")
    for n, (mass, total) in got.items():
        assert np.isclose(mass, w[node == n].sum()) and np.allclose(total, w[node == n] @ x[node == n])
    assert proposals.cell_sums(members.filter("node = 'z'")) == {}


def test_evolution_derives_the_queries_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        read.add(1)
        return k

    x = np.random.default_rng(2).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, i % 2, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "vec_id long, category int, v array<double>")
    taxonomy.evolve(rows.select(seen.asNondeterministic()("vec_id").alias("vec_id"), "category", "v"), taxonomy.Settings(rounds=1, least=10))
    assert read.value == 60


def of_two(n, d=6):
    """n members of a node that mixes two clusters, and what they are in."""
    rng = np.random.default_rng(12)
    x = np.eye(d)[np.arange(n) % 2] + 0.1 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_node_of_many_members_takes_few_jobs(spark):
    n = 40_000
    x = of_two(n)
    members = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "node": "n", "v": x.tolist()}), "vec_id long, node string, v array<double>")
    spark.sparkContext.setJobGroup("large node", "large node")
    try:
        gate, parts, _ = proposals.split_parts(members, taxonomy.Settings(least=10))["n"]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert gate == "split" and len(spark.sparkContext.statusTracker().getJobIdsForGroup("large node")) < 20
    assert sorted(m for m, _ in parts) == [n / 2, n / 2] and np.allclose(sum(t for _, t in parts), x.sum(axis=0))


def test_a_mixture_is_fitted_once_for_a_node(spark, monkeypatch):
    seen, split = spark.sparkContext.accumulator(0), proposals.split

    def counted(*args):
        seen.add(1)
        return split(*args)

    monkeypatch.setattr(proposals, "split", counted)
    x = of_two(210)
    members = spark.createDataFrame([(i, f"n{i % 7}" if i < 140 else "n7", v.tolist()) for i, v in enumerate(x)], "vec_id long, node string, v array<double>")
    assert len(proposals.split_parts(members, taxonomy.Settings(least=5))) == 8 and seen.value == 8


def test_members_in_a_file_split_as_those_in_memory(monkeypatch):
    x, w = of_two(700), np.random.default_rng(1).uniform(0.2, 1, 700)
    one = mixtures.split(mixtures.Held(x, w), 10, 4, 0.02)
    monkeypatch.setattr(mixtures, "HELD", 100)
    monkeypatch.setattr(mixtures, "BLOCK", 64)
    room = mixtures.room(*x.shape)
    room[:] = x
    assert isinstance(room.base, np.memmap)
    two = mixtures.split(mixtures.Held(room, w), 10, 4, 0.02)
    assert one[0] == two[0] == "split" and np.allclose(one[1], two[1]) and np.allclose(one[2], two[2]) and np.isclose(one[3], two[3])


def test_nodes_are_shared_out_evenly():
    counts = {"a": 100, "b": 60, "c": 50, "d": 40, **{f"s{i}": 1 for i in range(40)}}
    load = {}
    for node, k in proposals.shelves(counts, 3).items():
        load[k] = load.get(k, 0) + counts[node]
    assert sorted(load) == [0, 1, 2] and max(load.values()) <= 1.2 * sum(counts.values()) / 3


def test_a_walk_carries_each_rows_own_vector(spark):
    x = of_two(90)
    q = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, category int, v array<double>")
    found, cells, hits = taxonomy.routed(q, taxonomy.bootstrap(q), taxonomy.Settings())
    rows = found.collect()
    assert {r.vec_id for r in rows} == set(range(90)) and all(np.array_equal(r.v, x[r.vec_id]) for r in rows) and not hits
    for node, (mass, total) in cells.of.items():
        mine = [r for r in rows if r.node == node]
        assert np.isclose(mass, sum(r.weight for r in mine)) and np.allclose(total, sum(r.weight * np.array(r.v) for r in mine))
