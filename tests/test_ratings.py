"""Closed forms of ratings, graph operators and scalars."""

import math

import numpy as np

from pyspark.sql import functions as F

from canopyrank.functions import scalars
from canopyrank.operators import graph, ratings


def test_unknown_agents_start_from_the_default_and_a_win_moves_them_apart():
    got = ratings.rate_log([("x", "y", 1.0)])
    assert got["x"][0] > 25 > got["y"][0]
    assert got["x"][1] < ratings.SIGMA and got["y"][1] < ratings.SIGMA


def test_tie_between_equals_changes_no_mean():
    a, b = ratings.rate((25.0, 8.0), (25.0, 8.0), 0.0)
    assert math.isclose(a[0], 25.0) and math.isclose(b[0], 25.0)


def test_bradley_terry_recovers_odds():
    w = np.array([[0, 30.0], [10.0, 0]])
    s, se = ratings.bradley_terry(w, np.zeros((2, 2)))
    assert math.isclose(s[0] - s[1], math.log(3), abs_tol=1e-6)
    assert math.isclose(s.sum(), 0, abs_tol=1e-9) and (se >= 0.01).all()


def test_orientation_of_a_pair_does_not_matter(spark):
    one = spark.createDataFrame([("d", "a", "b", 3.0, 1.0, 2.0)], "domain string, a string, b string, wins_a double, wins_b double, ties double")
    two = spark.createDataFrame([("d", "b", "a", 1.0, 3.0, 2.0)], one.schema)
    f = lambda df: {r.model: round(r.score, 9) for r in ratings.fit_pairs(df, "domain").collect()}
    assert f(one) == f(two)


def test_cycle_is_one_component_and_the_loser_another(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")], "p string, c string")
    got = {r.node: r.scc for r in graph.strongly_connected(e).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_closure_has_no_bound_on_depth_and_circles_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "p string, c string")
    got = {(r.node, r.anc): r.d for r in graph.closure(chain).collect()}
    assert got == {(f"n{i}", f"n{j}"): i - j for i in range(41) for j in range(i + 1)}
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 15}") for i in range(15)], "p string, c string")
    assert graph.closure(ring).count() == 225 and {r.scc for r in graph.strongly_connected(ring).collect()} == {"n0"}


def test_confidence_moves_a_share_of_the_way_and_the_global_domain_less(spark):
    full, half = ratings.rate((25.0, 8.0), (20.0, 7.0), 1.0), ratings.rate((25.0, 8.0), (20.0, 7.0), 1.0, 0.5)
    for f, h, r in zip(full, half, ((25.0, 8.0), (20.0, 7.0))):
        assert all(math.isclose(y, o + (x - o) / 2) for x, y, o in zip(f, h, r))
    log = [("d", 1, 1, "x", "y", 1.0, 0.0, 0.5), ("e", 2, 2, "y", "z", 0.0, 1.0, 1.0), ("d", 3, 3, "x", "z", 0.0, 0.0, 1.0)]
    got = ratings.ratings(spark.createDataFrame(log, "domain string, ts long, event_id long, a string, b string, wa double, wb double, conf double"))
    by = {(r.domain, r.agent): (r.mu, r.sigma) for r in got.collect()}
    want = ratings.rate_log((a, b, wa - wb, c * ratings.GLOBAL_SHARE) for _, _, _, a, b, wa, wb, c in log)
    assert {k[1]: v for k, v in by.items() if k[0] == "global"} == want
    assert {k[1]: v for k, v in by.items() if k[0] == "d"} == ratings.rate_log([("x", "y", 1.0, 0.5), ("x", "z", 0.0, 1.0)])


def test_letters_as_the_arena_reads_them(spark):
    cases = {"The correct option is b": "B", "(B) because A is wrong": "B", "c. it is A": "C", "**c** it is A": "A", "answer: d!": "D", "answer is unclear, so I": "I", "nothing here": "?", "take E or F": "F", "": "?"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.l for r in df.select("t", scalars.answer_letter(F.col("t")).alias("l")).collect()} == cases


def test_transitive_edge_goes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "p string, c string")
    assert sorted(map(tuple, graph.reduce_edges(e).collect())) == [("a", "b"), ("b", "c")]


def test_lowest_common_ancestor_is_the_deepest(spark):
    e = spark.createDataFrame([("root", "x"), ("x", "y"), ("y", "p"), ("y", "q")], "p string, c string")
    reach = graph.closure(e)
    pair = spark.createDataFrame([("p", "q")], "x string, y string")
    got = graph.lowest_common(pair, reach.select("node", "anc"), graph.depths(e)).first()
    assert (got.lca, got.depth) == ("y", 2)


def test_pairs_join_into_groups_named_by_the_smallest(spark):
    p = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (2, 9)], "x long, y long")
    got = {r.n: r.g for r in graph.merge_groups(p, "x", "y", "n", "g").collect()}
    assert got == {2: 2, 3: 2, 5: 2, 9: 2, 7: 7, 8: 7}


def test_permutation_of_equal_scores_is_never_significant_and_of_opposite_ones_is():
    t = np.arange(12.0)
    assert ratings.permutation_p(t, t, t, 200) == (0.0, 1.0)
    delta, p = ratings.permutation_p(t, t, -t, 2000)
    assert math.isclose(delta, 2.0) and p < 0.01
