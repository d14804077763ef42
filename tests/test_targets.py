"""Which leaves are compared in next, against a plain sort."""

import random
from itertools import combinations

import numpy as np
import pytest

from canopyrank.operators import ratings as R


def plain(stats, leaves, budget, least, most):
    models = sorted({m for s in stats for m in s[1:3]})
    out = []
    for leaf, queries in leaves:
        mine = {(a, b): rest for k, a, b, *rest in stats if k == leaf}
        seen = sorted({m for p in mine for m in p})
        w, t = np.zeros((len(seen),) * 2), np.zeros((len(seen),) * 2)
        for (a, b), (x, y, z, _) in mine.items():
            i, j = seen.index(a), seen.index(b)
            w[i, j], w[j, i], t[i, j], t[j, i] = x, y, z, z
        score, se = R.bradley_terry(w, t) if seen else ((), ())
        debt = 0
        for a, b in combinations(models, 2):
            n = mine[a, b][3] if (a, b) in mine else 0
            if a not in seen or b not in seen:
                debt += 1
            elif n < budget:
                i, j = seen.index(a), seen.index(b)
                debt += n < 2 or abs(score[i] - score[j]) < 3 * (se[i] + se[j])
        if queries >= least and debt:
            out.append((leaf, not mine, int(debt), float(np.mean(se)) if seen else 10.0, queries))
    out.sort(key=lambda r: (-r[1], -r[2], -round(r[3], 9), -r[4], r[0]))
    return [(*r, k + 1) for k, r in enumerate(out[:most])]


def test_targets_equal_a_plain_sort(spark):
    rng = random.Random(3)
    stats, leaves = [], [(f"l{k}", rng.choice([2, 5, 9, 9])) for k in range(24)]
    for leaf, _ in leaves[:20]:
        for a, b in combinations("pqrs", 2):
            if rng.random() < 0.7:
                x, y, z = (float(rng.randrange(0, 12)) for _ in range(3))
                stats.append((leaf, a, b, x, y, z, int(x + y + z)))
    stats += [("done", a, b, 50.0, 50.0, 0.0, 100) for a, b in combinations("pqrs", 2)]
    leaves += [("done", 9)]
    df = spark.createDataFrame(stats, "leaf string, a string, b string, wins_a double, wins_b double, ties double, n long")
    got = R.target_nodes(df, spark.createDataFrame(leaves, "leaf string, queries long"), "leaf", 30, 5, most=12).select("leaf", "fresh", "debt", "mean_se", "queries", "place").collect()
    want = plain(stats, leaves, 30, 5, 12)
    assert [tuple(r)[:3] + tuple(r)[4:] for r in sorted(got, key=lambda r: r.place)] == [r[:3] + r[4:] for r in want] and len(want) == 12
    assert [r.mean_se for r in sorted(got, key=lambda r: r.place)] == pytest.approx([r[3] for r in want])
    assert want[0][1] and all(r[0] != "done" for r in want)
