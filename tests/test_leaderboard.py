"""The pooled leaderboard against plain loops."""

import hashlib
import math
import random
from collections import defaultdict
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from canopyrank.operators import leaderboard as L

SCHEMA = "leaf string, query_id long, a string, b string, wa double, wb double, tie double, checked boolean, agreed boolean"


def plain_weight(query, replicate):
    if query is None or query < 0:
        return 0
    h = hashlib.md5(f"42:{query}:{replicate // 8}".encode()).hexdigest()
    u, total, k = int(h[replicate % 8 * 4 :][:4], 16), 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if int(65536 * total) >= 65535 or u < int(65536 * total):
            return k
        k += 1


def plain_fit(models, points, rounds):
    s = dict.fromkeys(models, 0.0)
    for _ in range(rounds):
        new = {}
        for i in models:
            total = sum(points[i, j] for j in models)
            down = sum((points[i, j] + points[j, i]) / (math.exp(s[i]) + math.exp(s[j])) for j in models if j != i)
            new[i] = math.log(total / down) if total and down else s[i]
        mean = sum(new.values()) / len(new)
        s = {i: v - mean for i, v in new.items()}
    return s


def plain_board(matches, groups, least):
    by_leaf = defaultdict(list)
    for m in matches:
        by_leaf[m[0]].append(m)
    out = {}
    for group, leaves in groups.items():
        ok = [x for x in leaves if len(by_leaf[x]) >= least]
        models, used = set(), []
        for leaf in ok:
            checks = defaultdict(list)
            for _, _, a, b, *_, checked, agreed in by_leaf[leaf]:
                models |= {a, b}
                if checked:
                    checks[min(a, b), max(a, b)].append(agreed)
            if not any(len(c) >= least and sum(c) / len(c) < 0.5 for c in checks.values()):
                used += by_leaf[leaf]
        def points(weight, prior):
            p = defaultdict(float)
            for _, q, a, b, wa, wb, tie, *_ in used:
                p[a, b] += weight(q) * (wa + tie + prior)
                p[b, a] += weight(q) * (wb + tie + prior)
            return p

        score = plain_fit(models, points(lambda q: 1, 0.0), 200) if models else {}
        drawn = [plain_fit(models, points(lambda q: plain_weight(q, r), 1e-4), 100) for r in range(50)] if any(q is not None and q >= 0 for _, q, *_ in used) else None
        for k, m in enumerate(sorted(models, key=lambda m: (-round(score[m], 9), m))):
            se = min(10.0, max(1e-3, stdev(d[m] for d in drawn))) if drawn else 1.0
            out[group, m] = (score[m], se, score[m] - 2 * se, score[m] + 2 * se, k + 1, len(leaves), len(ok), sum(len(by_leaf[x]) for x in ok), len(ok) / len(leaves) >= 0.3)
    return out


@pytest.fixture(scope="module")
def log():
    rng, rows = random.Random(4), []
    for leaf, n in (("x/0", 60), ("x/1", 40), ("x/2", 3), ("y/0", 30), ("y/1", 2), ("y/2", 1), ("y/3", 1), ("z/0", 150), ("w/0", 12)):
        for _ in range(n):
            a, b = rng.sample("pqrst", 2)
            won = rng.choice([(1.0, 0.0, 0.0)] * (2 if a < b else 1) + [(0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])
            query = rng.choice([None, -1]) if leaf == "w/0" else rng.choice([None, -1, *range(12)])
            rows.append((leaf, query, a, b, *won, rng.random() < 0.9, rng.random() < (0.1 if leaf == "z/0" else 0.95)))
    return rows


def test_board_equals_a_plain_loop(spark, log):
    groups = {"root": sorted({r[0] for r in log}) + ["v/0"], "x": ["x/0", "x/1", "x/2"], "y": ["y/0", "y/1", "y/2", "y/3"], "z": ["z/0"], "w": ["w/0"], "v": ["v/0"]}
    leaves = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "group string, leaf string")
    got = L.pooled_leaderboard(L.leaf_pairs(spark.createDataFrame(log, SCHEMA).repartition(3)), leaves, least=5)
    assert got.columns == ["group", "model", "score", "se", "low", "high", "rank", "leaves", "eligible", "comparisons", "reliable"]
    got, want = {(r[0], r[1]): tuple(r[2:]) for r in got.collect()}, plain_board(log, groups, 5)
    assert set(got) == set(want) and ("v", "p") not in got
    for k in want:
        assert got[k][:4] == pytest.approx(want[k][:4], abs=1e-9) and got[k][4:] == want[k][4:], k
    # an inconsistent judge leaves its models without matches; without query ids nothing is drawn
    assert all(got[k][0] == 0 and got[k][1] == 1.0 for k in got if k[0] == "z") and all(got[k][1] == 1.0 for k in got if k[0] == "w")
    assert not got["y", "p"][8] and got["x", "p"][8] and min(v[1] for k, v in got.items() if k[0] == "root") >= 1e-3


def test_weights_are_poisson_and_the_same_everywhere(spark):
    rows = spark.range(-2, 3000).select("id", L.replicate_weights(F.col("id")).alias("w")).collect()
    assert all(r.w == [plain_weight(r.id, k) for k in range(50)] for r in rows[::97]) and sum(rows[0].w) == 0
    drawn = [x for r in rows for x in r.w if r.id >= 0]
    assert abs(sum(drawn) / len(drawn) - 1) < 0.02 and abs(drawn.count(0) / len(drawn) - math.exp(-1)) < 0.01
    assert [r.w for r in spark.sql("SELECT CAST(NULL AS LONG) AS id").select(L.replicate_weights(F.col("id")).alias("w")).collect()] == [[0] * 50]


def test_board_without_matches(spark):
    none = spark.createDataFrame([], SCHEMA)
    leaves = spark.createDataFrame([("g", "x")], "group string, leaf string")
    assert L.pooled_leaderboard(L.leaf_pairs(none), leaves).count() == 0
