"""Order of strong components, and pairs that still need matches, against plain loops."""

import random

import numpy as np

from canopyrank.operators import graph, ratings


def test_components_follow_all_that_lead_to_them(spark):
    draw = random.Random(3)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)]
    edges = {*chain, ("n04", "n02"), ("n09", "n08"), *(tuple(sorted((f"n{draw.randrange(15):02}", f"m{draw.randrange(5)}"), reverse=True)) for _ in range(12))}
    names = sorted({x for e in edges for x in e})
    reach = {x: {x} for x in names}
    while True:
        more = {x: reach[x].union(*(reach[c] for p, c in edges if p == x)) for x in names}
        if more == reach:
            break
        reach = more
    scc = {x: min(y for y in names if y in reach[x] and x in reach[y]) for x in names}
    between = {(scc[p], scc[c]) for p, c in edges if scc[p] != scc[c]}

    def level(s):
        return max((level(p) + 1 for p, c in between if c == s), default=0)

    got = graph.component_order(spark.createDataFrame(sorted(edges), "p string, c string")).collect()
    assert sorted((r.node, r.scc, r.level) for r in got) == [(x, scc[x], level(scc[x])) for x in names]
    assert len(set(scc.values())) < len(names) and max(r.level for r in got) > 5


def test_convergence_debt_counts_unsettled_pairs(spark):
    draw = random.Random(5)
    rows, budget = [], 60
    for domain in ("x", "y", "z"):
        for i in range(7):
            for j in range(i + 1, 7):
                n = draw.choice([0, 1, 2, 40, 59, 60, 61])  # none: no row
                if n:
                    a = sum(draw.random() < 1 / (1 + np.exp(2.0 * (i - j))) for _ in range(n))
                    rows.append((domain, f"M{i}", f"M{j}", float(a), float(n - a), 0.0, n))
    stats = spark.createDataFrame(rows, "domain string, a string, b string, wins_a double, wins_b double, ties double, n long")
    kinds, want = set(), {}
    for domain in ("x", "y", "z"):
        mine = {(r[1], r[2]): r for r in rows if r[0] == domain}
        names = sorted({m for p in mine for m in p})
        wins = np.zeros((len(names),) * 2)
        for (a, b), r in mine.items():
            wins[names.index(a), names.index(b)], wins[names.index(b), names.index(a)] = r[3], r[4]
        s, se = ratings.bradley_terry(wins, np.zeros_like(wins))
        debt = 0
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                n = mine[names[i], names[j]][6] if (names[i], names[j]) in mine else 0
                kind = "spent" if n >= budget else "few" if n < 2 else "near" if abs(s[i] - s[j]) < 3 * (se[i] + se[j]) else "apart"
                kinds.add(kind)
                debt += kind in ("few", "near")
        want[domain] = (len(names) * (len(names) - 1) // 2, debt)
    assert kinds == {"spent", "few", "near", "apart"}
    assert {r.domain: (r.pairs, r.debt) for r in ratings.convergence_debt(stats, "domain", budget).collect()} == want
