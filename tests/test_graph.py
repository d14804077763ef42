"""Runs of single children, against following them one by one."""

import random
from collections import defaultdict

import pytest

from canopyrank.operators import graph as G


def plain(edges, least):
    kids, ups = defaultdict(set), defaultdict(set)
    for p, c in edges:
        kids[p].add(c)
    single = {p: min(c) for p, c in kids.items() if len(c) == 1}
    for p, c in single.items():
        if c in single:
            ups[c].add(p)
    out = []
    for p in single:
        if not ups[p]:
            seen, at = [], p
            while at in single and at not in seen:
                seen.append(at)
                at = single[at]
            out += [(p, len(seen))] if len(seen) >= least else []
    return sorted(out)


CASES = {
    "one long run": [(f"n{i}", f"n{i + 1}") for i in range(37)],
    "runs that meet": [("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("y", "z"), ("y", "w")],
    "into a circle": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("y", "z")],
    "none": [("a", "b"), ("a", "c")],
}


@pytest.mark.parametrize("case", CASES)
def test_chains_equal_following_them(spark, case):
    e = spark.createDataFrame(CASES[case] + CASES[case][:1], "p string, c string")
    for least in (1, 3):
        assert sorted(map(tuple, G.chains(e, least).collect())) == plain(CASES[case], least)


def test_chains_of_a_random_forest(spark):
    rng = random.Random(2)
    edges = [(f"n{max(0, i - rng.choice((1, 1, 1, 2, 5)))}", f"n{i}") for i in range(1, 120)]
    assert sorted(map(tuple, G.chains(spark.createDataFrame(edges, "p string, c string"), 2).collect())) == plain(edges, 2)
