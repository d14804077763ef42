"""Directional mixtures over the members of a node, held by one task or spread over many, and their leading directions.

A member is a row (vec_id, v) with an optional weight: its share in the node.
Both forms give the same sums; only those reach the driver.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A mean and, below it, directions as rows; members are projected as (x - mean) @ directions.T, scaled to length one.
Basis = tuple[np.ndarray, np.ndarray]
#: Members of a node whose vectors a task holds in memory: 67 MB at 64 dimensions, and as much for their projections. Those of a larger node lie in files of the task.
HELD = 1 << 17
#: Members that a step takes at a time, so that they stay in a processor's cache.
BLOCK = 1 << 12


def room(n: int, d: int) -> np.ndarray:
    """An array for n vectors: up to HELD in memory, otherwise in a file without a name, which goes with the array."""
    if n <= HELD:
        return np.empty((n, d))
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, float, "w+", shape=(n, d)).view(np.ndarray)


def kappa_of(r: float, n: float, d: int) -> float:
    """Concentration for a mean resultant length, with Newton steps, shrinkage and bounds."""
    r = min(max(r, 1e-9), 1 - 1e-9)
    k = r * (d - r * r) / (1 - r * r)
    for _ in range(5):
        nu = d / 2 - 1
        a = k / (nu + 0.5 + np.sqrt((nu + 1.5) ** 2 + k * k))
        k = max(1e-3, k - (a - r) / max(1 - a * a - (d - 1) / k * a, 1e-9))
    return float(min(1e4, max(1e-3, k * (n - 1) / (n + d - 2)))) if n > 1 else 1e-3


def fit_of(n: float, total: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean direction and concentration of so much mass with this sum."""
    size = float(np.linalg.norm(total))
    mu = total / size if size > 0 else np.eye(1, len(total))[0]
    return mu, kappa_of(size / max(n, 1e-12), n, len(total))


def shares(x: np.ndarray, mu: np.ndarray, kappa: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities of the parts for every row, and each row's log-likelihood."""
    nu = max(x.shape[1] / 2 - 1, 0.5)
    z = kappa / nu
    root = np.sqrt(1 + z * z)
    log_c = nu * np.log(kappa) - (nu + 1) * np.log(2 * np.pi) - (nu * (root + np.log(z / (1 + root))) - 0.5 * np.log(2 * np.pi * nu * root))
    # a row for each part: sums over the few parts run along the rows
    logp = (np.log(weight) + log_c)[:, None] + kappa[:, None] * (mu @ x.T)
    top = logp.max(axis=0)
    p = np.exp(logp - top)
    whole = p.sum(axis=0)
    return (p / whole).T, top + np.log(whole)


def leading(n: float, total: np.ndarray, moment: np.ndarray, k: int) -> Basis:
    """Mean and the k leading directions of members with these sums; a direction's largest component is positive."""
    mean = total / n
    values, vectors = np.linalg.eigh(moment / n - np.outer(mean, mean))
    rows = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return mean, rows * np.where(sign == 0, 1, sign)[:, None]


def project(x: np.ndarray, basis: Basis | None) -> np.ndarray:
    if basis is None:
        return x
    y = (x - basis[0]) @ basis[1].T
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return np.where(size > 1e-10, y / np.where(size > 1e-10, size, 1), y)


class Held:
    """A node's members as arrays, in order of their ids; y are their projections, where the mixture is fitted."""

    def __init__(self, x: np.ndarray, w: np.ndarray | None = None, basis: Basis | None = None):
        self.x = self.y = x
        self.w = np.ones(len(x)) if w is None else w
        if basis is not None:
            self.y = room(len(x), len(basis[1]))
            for at in self._blocks():
                self.y[at] = project(x[at], basis)
        self.count, self.n, self.d = len(x), float(self.w.sum()), self.y.shape[1]
        self.whole = self.w @ self.y

    def _blocks(self) -> list[slice]:
        return [slice(at, at + BLOCK) for at in range(0, max(1, len(self.x)), BLOCK)]

    def seen(self, basis: Basis) -> "Held":
        return Held(self.x, self.w, basis)

    def moments(self) -> tuple[float, np.ndarray, np.ndarray]:
        return self.n, self.w @ self.x, sum((self.x[at] * self.w[at][:, None]).T @ self.x[at] for at in self._blocks())

    def farthest(self, mu: np.ndarray) -> np.ndarray:
        return self.y[np.argmin(np.round((self.y @ mu.T).max(axis=1), 12))]

    def soft(self, parts: tuple) -> tuple[float, np.ndarray, np.ndarray]:
        like, size, total = 0.0, 0.0, 0.0
        for at in self._blocks():
            p, ll = shares(self.y[at], *parts)
            p = p * self.w[at][:, None]
            like, size, total = like + float(self.w[at] @ ll), size + p.sum(axis=0), total + p.T @ self.y[at]
        return like, size, total

    def hard(self, parts: tuple, raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Mass and sums of the members that a part takes, of the projections or (raw) of the members themselves."""
        of, k = self.x if raw else self.y, len(parts[0])
        size, total = np.zeros(k), 0.0
        for at in self._blocks():
            mine = np.where(shares(self.y[at], *parts)[0].argmax(axis=1) == np.arange(k)[:, None], self.w[at], 0.0)
            size, total = size + mine.sum(axis=1), total + mine @ of[at]
        return size, total


class Spread:
    """A node's members as a DataFrame (vec_id, v, perhaps weight): what Held gives, from sums over all tasks."""

    def __init__(self, members: DataFrame, basis: Basis | None = None):
        self.members, self.basis = members.select("v", *[c for c in ("weight",) if c in members.columns]), basis
        got = self._sums(lambda h: np.concatenate([[h.count, h.n], h.whole]))
        self.count, self.n, self.whole = int(got[0]), float(got[1]), got[2:]
        self.d = len(self.whole)

    def _each(self, one: Callable[[Held], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """one() of all batches of a task, merged: a row of numbers for each task."""
        basis = self.basis

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for b in batches:
                if len(b):
                    x = np.asarray(b.column("v").flatten(), dtype=float).reshape(len(b), -1)
                    new = one(Held(x, np.asarray(b.column("weight"), dtype=float) if "weight" in b.schema.names else None, basis))
                    got = new if got is None else merge(got, new)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([list(got)], pa.list_(pa.float64()))], ["r"])

        return self.members.mapInArrow(run, "r array<double>")

    def _sums(self, one: Callable[[Held], np.ndarray]) -> np.ndarray:
        rows = self._each(one, lambda a, b: a + b).select(F.posexplode("r").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([x for _, x in sorted(map(tuple, rows))])

    def seen(self, basis: Basis) -> "Spread":
        return Spread(self.members, basis)

    def moments(self) -> tuple[float, np.ndarray, np.ndarray]:
        got = self._sums(lambda h: np.concatenate([[h.n], h.moments()[1], h.moments()[2].ravel()]))
        d = int(np.sqrt(len(got)))
        return float(got[0]), got[1 : d + 1], got[d + 1 :].reshape(d, d)

    def farthest(self, mu: np.ndarray) -> np.ndarray:
        def one(h):
            c = np.round((h.y @ mu.T).max(axis=1), 12)
            return np.concatenate([[c.min()], min(map(tuple, h.y[c == c.min()]))])

        least = self._each(one, lambda a, b: min(a, b, key=tuple)).agg(F.min("r")).first()[0]
        return np.array(least)[1:]

    def soft(self, parts: tuple) -> tuple[float, np.ndarray, np.ndarray]:
        def one(h):
            ll, soft, total = h.soft(parts)
            return np.concatenate([[ll], soft, total.ravel()])

        got, k = self._sums(one), len(parts[0])
        return float(got[0]), got[1 : k + 1], got[k + 1 :].reshape(k, -1)

    def hard(self, parts: tuple, raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
        def one(h):
            size, total = h.hard(parts, raw)
            return np.concatenate([size, total.ravel()])

        got, k = self._sums(one), len(parts[0])
        return got[:k], got[k:].reshape(k, -1)


def mixture(x: Held | Spread, k: int, rounds: int = 150) -> tuple | None:
    """Directions, concentrations and weights of a k-part directional mixture, started from the centroid's farthest points; None if a part dies."""
    n, d = x.n, x.d
    mu = x.farthest(x.whole[None] / n)[None]
    while len(mu) < k:
        mu = np.vstack([mu, x.farthest(mu)])
    parts, last, idle = (mu, np.full(k, 10.0), np.full(k, 1 / k)), -np.inf, 0
    for i in range(rounds):
        ll, soft, total = x.soft(parts)
        if soft.min() < 0.01 * n:
            return None
        idle = idle + 1 if ll <= last else 0
        if abs(ll - last) / n < 1e-5 or idle >= 10 or i == rounds - 1:
            break
        last, size = ll, np.linalg.norm(total, axis=1)
        parts = (total / np.maximum(size, 1e-12)[:, None], np.array([kappa_of(a / m, m, d) for a, m in zip(size, soft)]), soft / n)
    return parts


def separation_of(size: np.ndarray, total: np.ndarray) -> float:
    """Chance-corrected separation of cells from their masses and sums: 1 if cells are points, 0 if no better than a random split."""
    n, whole = size.sum(), total.sum(axis=0)
    if n < 2:
        return 0.0
    within = (size**2 - (total**2).sum(axis=1)).sum()
    expected = (n * n - whole @ whole) * (size * (size - 1)).sum() / (n * (n - 1))
    return float(1 - within / expected) if expected > 1e-10 else 0.0


def split_dims(count: int, d: int) -> int:
    """Directions that a node of so many members is split in."""
    return min(32 if count < 100 else 64 if count < 500 else 128, d)


def split(x: Held | Spread, least: float, most: int, epsilon: float) -> tuple[str, np.ndarray, np.ndarray, float]:
    """Why a node is not split, or "split"; masses and sums of the parts as far as they were found, and their separation.

    The mixture is fitted to the members' projections on their leading directions; k grows while the separation gains
    epsilon. Its parts only propose children: members go to the proposed child that fits best in the whole space, as
    routing would send them, and that partition must hold the least mass in each part and separate by epsilon itself.
    """
    n, total, moment = x.moments()
    none = (np.zeros(0), np.zeros((0, len(total))), 0.0)
    y = x.seen(leading(n, total, moment, split_dims(x.count, len(total))))
    best, found, gate = 0.0, None, "separation"
    for k in range(2, most + 1):
        if n < k * least or (parts := mixture(y, k)) is None:
            gate = gate if found is not None else "collapsed"
            break
        size, sums = y.hard(parts)
        if size.min() < least:
            gate = "floor"
            break
        sep = separation_of(size, sums)
        if sep < best + epsilon:
            break
        best, found = sep, parts
    if found is None:
        return gate, *none
    size, sums = y.hard(found, raw=True)
    fits = [fit_of(m, t) for m, t in zip(size, sums)]
    direct = (np.stack([m for m, _ in fits]), np.array([k for _, k in fits]), np.ones(len(fits)))
    size, sums = x.hard(direct, raw=True)
    if size.min() < least:
        return "unsustained", size, sums, 0.0
    sep = separation_of(size, sums)
    return ("split" if sep >= (2 * epsilon if x.count < 2 * least else epsilon) else "separation"), size, sums, sep
