"""The taxonomy as plain values: a small table of nodes that the driver holds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Node:
    """A node below its tree parent, and below any further parents by cross links. Without a direction it has no gate."""

    name: str
    parent: str | None
    depth: int
    mu: tuple[float, ...] = ()
    kappa: float = 1e-3
    mass: float = 0.0
    also: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    epsilon: float = 0.04
    least: int = 20
    most_children: int = 4
    max_depth: int = 12
    rounds: int = 10
    margin: float = 0.1
    path_floor: float = 1e-4
    share_floor: float = 0.05
    assignments: int = 3
    quiet_rounds: int = 2
    seed: int = 42
    residuals: bool = True
    #: A node is diffuse below this concentration while its mass is under so many times the least.
    diffuse_kappa: float = 0.5
    diffuse_times: int = 10


@dataclass
class Taxonomy:
    nodes: dict[str, Node] = field(default_factory=dict)

    def children(self, name: str | None) -> list[Node]:
        return sorted((n for n in self.nodes.values() if n.parent == name or name in n.also), key=lambda n: n.name)

    def leaves(self) -> list[str]:
        inner = {p for n in self.nodes.values() for p in (n.parent, *n.also)}
        return sorted(k for k in self.nodes if k not in inner)

    @property
    def root(self) -> str:
        return next(n.name for n in self.nodes.values() if n.parent is None)

    def shrinkage(self, name: str) -> float:
        """Length of the children's mean direction, weighed by mass (alike where none has any): 1 without children."""
        kids = self.children(name)
        if not kids or not kids[0].mu:
            return 1.0
        w = np.array([k.mass for k in kids])
        w = w / w.sum() if w.sum() > 0 else np.full(len(kids), 1 / len(kids))
        d = len(kids[0].mu)
        total = sum(x * np.array(k.mu) for x, k in zip(w, kids) if len(k.mu) == d)
        return float(min(1.0, np.linalg.norm(total)))
