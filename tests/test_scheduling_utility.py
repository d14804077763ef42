"""The utility scheduler against plain loops."""

import math
import random
import statistics
from itertools import combinations

import pytest

from canopyrank.operators import scheduling as T

STATS = "leaf string, a string, b string, wins_a double, wins_b double, ties double, n long"
BUDGET = 40


def made(seed):
    """Models of very different strength in some leaves, near equal ones in others; some pairs unseen, M4 with M5 in all."""
    rng = random.Random(seed)
    out = []
    for k in range(8):
        for a, b in combinations(range(6), 2):
            if (a, b) == (4, 5) or rng.random() < 0.3 or (k == 3 and b == 5) or (k == 6 and b > 1):
                continue
            n = rng.choice([1, 3, 12, 39, 40, 60])
            p = 0.97 if k % 2 else 0.5
            w = sum(rng.random() < p for _ in range(n))
            t = rng.randint(0, n - w) if k != 5 else n - w
            out.append((f"l{k}", f"M{a}", f"M{b}", float(w), float(n - w - t), float(t), n))
    return out


def plain_states(stats):
    pts = {}
    for leaf, a, b, w, l, t, _ in stats:
        for m, x, y in ((a, w, l), (b, l, w)):
            p = pts.setdefault((leaf, m), [1.0, 1.0])
            p[0] += x + t / 2
            p[1] += y + t / 2
    return {k: (math.log(x / y), math.sqrt(1 / x + 1 / y)) for k, (x, y) in pts.items()}


def plain_utility(mine, models, row, a, b):
    n, ties, total = (row[6], row[5], sum(row[3:6])) if row else (0, 0, 0)
    if a not in mine or b not in mine:
        return math.log(2) + 1 + (10 - min(n, 10)) * 0.1
    if total and ties / total >= 0.55:
        return 0.0
    scores = sorted(s for s, _ in mine.values())
    (si, ei), (sj, ej) = mine[a], mine[b]
    settled = sum(abs(x - y) >= 3 * (p + q) for (x, p), (y, q) in combinations(mine.values(), 2))
    ripe = 0.35 * max(0, 1 - statistics.fmean(e for _, e in mine.values()) / 10) + 0.65 * settled / math.comb(len(models), 2)
    alpha = 0.2 + 0.8 * math.exp(-2.5 * ripe)
    mid, gap, err, k = (si + sj) / 2, abs(si - sj), ei + ej, len(scores)
    structure = 1.0 if k < 3 else 0.6 * sum(min(si, sj) <= s <= max(si, sj) for s in scores) / k + 0.4 * math.exp(-0.5 * ((mid - scores[k // 2]) / err) ** 2)
    h = max(1.06 * max(statistics.pstdev(scores), 1e-6) * k**-0.2, 1e-4)
    dense = lambda at: sum(math.exp(-0.5 * ((s - at) / h) ** 2) for s in scores)
    if gap >= 4 * err:
        weight = 0.0
    elif gap < 0.15 * err:
        weight = gap / (0.15 * err)
    else:
        weight = 1.0 if k < 3 else max(0.1, 1 - dense(mid) / max(map(dense, scores)))
    p = 1 / (1 + math.exp(sj - si))
    resolve = -(p * math.log(p) + (1 - p) * math.log(1 - p)) * (ei**2 + ej**2) * weight
    return (alpha * structure + (1 - alpha) * resolve) * (1 - 0.3 * min(n / BUDGET, 1))


def plain_candidates(stats):
    states = plain_states(stats)
    models, met = sorted({m for _, m in states}), {(s[1], s[2]) for s in stats}
    by = {s[:3]: s for s in stats}
    out = []
    for leaf in sorted({k for k, _ in states}):
        mine = {m: v for (k, m), v in states.items() if k == leaf}
        for a, b in combinations(models, 2):
            row = by.get((leaf, a, b))
            if not row or row[6] < BUDGET:
                out.append((leaf, a, b, row[6] if row else 0, (a, b) not in met, plain_utility(mine, models, row, a, b)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_utilities_equal_a_plain_loop(spark, seed):
    stats = made(seed)
    df = spark.createDataFrame(stats, STATS)
    got = {tuple(r)[:5]: r.utility for r in T.pair_utilities(df, T.counted_states(df, "leaf"), "leaf", BUDGET).collect()}
    want = plain_candidates(stats)
    assert set(got) == {x[:5] for x in want} and any(x[4] for x in want) and any(x[5] == 0 for x in want)
    for x in want:
        assert got[x[:5]] == pytest.approx(x[5], abs=1e-8)


@pytest.mark.parametrize("batch", [5, 30, 1000])
def test_batches_keep_shares_and_are_filled(spark, batch):
    share, cap = 2, 4
    c = [(k, a, b, n, f, round(u, 9)) for k, a, b, n, f, u in plain_candidates(made(3))]
    got = [tuple(r) for r in T.allot(spark.createDataFrame(c, "leaf string, a string, b string, n long, fresh boolean, utility double"), "leaf", batch, share, cap).orderBy("place").collect()]
    order, turns = sorted(c, key=lambda x: (-x[5], x[0], x[1], x[2])), {}
    lap = {}
    for k, a, b, *_ in order:
        up = lambda *t: turns.__setitem__(t, turns.get(t, -1) + 1) or turns[t]
        lap[k, a, b] = max(up("pair", a, b) // share, *(up("leaf", k, m) for m in (a, b)), *(up("all", m) // cap for m in (a, b)))
    want = sorted(c, key=lambda x: (not x[4], lap[x[:3]], -x[5], *x[:3]))[:batch]
    assert got == [(*x[:3], x[5], lap[x[:3]], i + 1) for i, x in enumerate(want)]
    first = [g for g in got if g[4] == 0]
    for k in {g[0] for g in first}:
        models = [m for g in first if g[0] == k for m in g[1:3]]
        assert len(models) == len(set(models))
    for m in {m for g in first for m in g[1:3]}:
        assert sum(m in g[1:3] for g in first) <= cap


def test_no_statistics_give_no_candidates(spark):
    df = spark.createDataFrame([], STATS)
    u = T.pair_utilities(df, T.counted_states(df, "leaf"), "leaf", BUDGET)
    assert u.count() == 0 and T.allot(u, "leaf", 10, 2, 4).count() == 0
