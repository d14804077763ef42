"""Queries that once read a part of their input, against the whole of it."""

import hashlib
import os
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from canopyrank.operators import ratings, taxonomy
from canopyrank.plans import rating_plans, registry
from canopyrank.session import TABLES

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(data):
    return sorted(map(repr, map(tuple, data)))


@needs_tables
@pytest.mark.parametrize("name", ["fn21_strip_fence", "sta01_spearman", "sta02_kendall_tau_b", "sta03_kendall_tau_a", "sta04_pairwise_accuracy", "sta08_wilcoxon", "sta11_pearson", "top04_top_k_jaccard"])
def test_query_takes_the_whole_input(spark, name):
    import duckdb

    c, sql = duckdb.connect(), registry.oracle_sql()[name]
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = registry.queries()[name](spark, SF), c.sql(sql)
    cols = sorted(df.columns)
    assert rows(df.select(*cols).collect()) == rows(want.project(",".join(f'"{x}"' for x in cols)).fetchall())


def test_fence_is_stripped_from_the_whole_text(spark, tmp_path):
    text = "x" * 50 + "\n```\ninner\n```\n" + "y" * 50
    spark.createDataFrame([(1, f" \n{text}\n "), (2, "x" * 50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.h for r in registry.queries()["fn21_strip_fence"](spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.md5(text.encode()).hexdigest(), 2: hashlib.md5(b"x" * 50).hexdigest()}


@needs_tables
def test_permutation_test_is_given_every_part(spark):
    assert rating_plans.two_scores(spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_pairs_are_counted_as_if_they_were_formed(spark):
    data = [(k, i, float(i * 7 % 5), float(i * i % 11 % 4)) for k, n in (("a", 23), ("b", 2), ("c", 1)) for i in range(n)] + [("d", i, 1.0, float(i)) for i in range(3)]
    want, by = {}, defaultdict(list)
    for k, _, x, y in data:
        by[k].append((x, y))
    for k, v in by.items():
        s = [(a[0] - b[0], a[1] - b[1]) for a, b in combinations(v, 2)]
        if s:
            want[k] = (len(s), sum(x != 0 for x, _ in s), sum(y != 0 for _, y in s), sum(x == y == 0 for x, y in s), sum(x * y > 0 for x, y in s), sum(x * y < 0 for x, y in s))
    got = rating_plans.pair_counts(spark.createDataFrame(data, "k string, id long, x double, y double")).collect()
    assert {r.k: (r.n, r.nx, r.ny, r.both, r.up, r.down) for r in got} == want


def clusters(spark, n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = np.linalg.qr(rng.normal(size=(d, d)))[0][np.arange(n) % 3] + 0.1 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, "n", v.tolist()) for i, v in enumerate(x)], "vec_id long, node string, v array<double>")


def test_split_takes_every_member(spark):
    x, members = clusters(spark, 5000)
    got = taxonomy.splits(members, taxonomy.Settings(least=10))["n"]
    want = sorted((x[np.arange(5000) % 3 == j].sum(axis=0) for j in range(3)), key=tuple)
    assert np.allclose(sorted((m for m, _ in got), key=tuple), [t / np.linalg.norm(t) for t in want], atol=1e-9)


def test_spread_members_split_as_held_ones(spark):
    _, members = clusters(spark, 600)
    both = members.union(members.selectExpr("vec_id", "'m'", "v").filter("vec_id < 90"))
    held, spread = (taxonomy.splits(both, taxonomy.Settings(least=10), most) for most in (1000, 100))
    assert set(held) == set(spread) == {"m", "n"}
    for node in held:
        assert np.allclose([m for m, _ in held[node]], [m for m, _ in spread[node]]) and np.allclose([k for _, k in held[node]], [k for _, k in spread[node]])


def test_evolution_is_registered_with_the_default_rounds(monkeypatch):
    seen = []
    monkeypatch.setattr(taxonomy, "evolve", lambda q, s: seen.append(s.rounds) or 1 / 0)
    monkeypatch.setattr("canopyrank.plans.construction_plans._queries", lambda spark, sf: None)
    with pytest.raises(ZeroDivisionError):
        registry.queries()["clu33_evolution"](None, "")
    assert seen == [taxonomy.Settings().rounds]


def test_permutation_test_is_registered_with_the_default_swaps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ratings, "permutation_test", lambda items, key, truth, one, two, rounds=10_000: seen.append(rounds))
    monkeypatch.setattr("canopyrank.plans.tournament_plans.two_scores", lambda spark, sf: spark.range(1))
    registry.queries()["sta07_permutation_test"](spark, "")
    assert seen == [10_000]


def test_swaps_drawn_in_blocks_give_the_same_p(monkeypatch):
    t, one, two = np.random.default_rng(1).random((3, 30))
    whole = ratings.permutation_p(t, one, two, 501)
    monkeypatch.setattr(ratings, "SWAPS", 100)
    assert ratings.permutation_p(t, one, two, 501) == whole
