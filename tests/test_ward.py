"""Ward's agglomeration against one merge at a time."""

import numpy as np
import pytest

from canopyrank.operators import ward as A


def plain(n, total):
    """The nearest pair of all, again and again."""
    n, total, size = np.array(n, dtype=float), np.array(total, dtype=float), len(n)
    row = lambda i: n[i] * n / (n[i] + n) * ((total[i] / n[i] - total / n[:, None]) ** 2).sum(axis=1)
    d = np.array([row(i) for i in range(size)]).reshape(size, size)
    d[np.tril_indices(size)] = np.inf
    out = []
    for _ in range(size - 1):
        i, j = np.unravel_index(np.round(d, 12).argmin(), d.shape)
        out.append((int(i), int(j), float(d[i, j])))
        n[i], total[i] = n[i] + n[j], total[i] + total[j]
        gone = np.isinf(d[i]) & np.isinf(d[:, i])  # those that were merged away
        d[j], d[:, j] = np.inf, np.inf
        new = np.where(gone | (np.arange(size) == j), np.inf, row(i))
        d[i, i + 1 :], d[:i, i] = new[i + 1 :], new[:i]
    return out


def vectors(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n,d,weights", [(500, 16, False), (90, 4, True), (2, 3, False), (1, 3, False)])
def test_the_same_merges(spark, n, d, weights):
    x = vectors(n, d, n)
    w = np.random.default_rng(1).integers(1, 9, size=n).astype(float) if weights else np.ones(n)
    got, want = A.merges(spark, w, x * w[:, None]), sorted(plain(w, x * w[:, None]), key=lambda m: (round(m[2], 12), m[0], m[1]))
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])


def test_equal_distances_end(spark):
    got = A.merges(spark, np.ones(6), np.eye(6))
    assert len(got) == 5 and {m[1] for m in got} == {1, 2, 3, 4, 5}
    assert len(A.merges(spark, np.ones(4), np.ones((4, 2)))) == 3


def test_clusters_of_cells(spark, monkeypatch):
    centre = np.eye(4)
    rows = [(k, (centre[k % 3] + 0.01 * k * centre[3]).tolist()) for k in range(9) for _ in range(2)] + [(None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "cell long, v array<double>")
    assert {r.cell: r.cluster for r in A.ward(df, "cell", 3).collect()} == {k: k % 3 for k in range(9)}
    assert {r.cluster for r in A.ward(df, "cell", 99).collect()} == set(range(9)) and A.ward(df.limit(0), "cell", 3).count() == 0
    monkeypatch.setattr(A, "MOST", 8)
    with pytest.raises(ValueError):
        A.ward(df, "cell", 3)
