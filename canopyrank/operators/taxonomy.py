"""Taxonomy construction: bootstrap, and the loop that evolves the tree by proposals.

Queries are rows of a DataFrame (vec_id, category, v); the topology is a small
table of nodes, kept as plain values on the driver. A proposal is a new
topology: accepted ones take the old one's place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyrank.functions.vectors import dot, sums
from canopyrank.operators import proposals
from canopyrank.operators.mixtures import fit_of, kappa_of  # noqa: F401
from canopyrank.operators.proposals import ALONE
from canopyrank.operators.routing import residual_hits, route, walk  # noqa: F401
from canopyrank.operators.topology import Node, Settings, Taxonomy
from canopyrank.storage import discard, materialise


def fit(members: DataFrame, key: str = "node") -> dict[str, tuple[int, np.ndarray, float]]:
    """n, mean direction and concentration of every node, from component sums; as many rows as there are nodes reach the driver."""
    out = {}
    for r in sums(members, key, "v", F.col("weight") if "weight" in members.columns else None).collect():
        out[r[key]] = (int(r["n"]), *fit_of(r["n"], np.array(r["total"])))
    return out


def separation(members: DataFrame, key: str = "node") -> float:
    """Chance-corrected separation of cells: 1 if cells are points, 0 if they are no better than a random split."""
    s = sums(members, key, "v")
    cells = s.select("n", (F.col("n") * F.col("n") - dot("total", "total")).alias("w"), "total")
    r = cells.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
    whole = cells.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    if not r["n"] or r["n"] < 2:
        return 0.0
    expected = (r["n"] ** 2 - whole) * r["pairs"] / (r["n"] * (r["n"] - 1))
    return float(1 - r["w"] / expected) if expected > 1e-10 else 0.0


def bootstrap(queries: DataFrame) -> Taxonomy:
    """A root and a node for each category, fitted."""
    t = Taxonomy({"root": Node("root", None, 0)})
    for name, (n, total) in sorted(proposals.cell_sums(queries.select(F.concat(F.lit("c"), F.col("category").cast("string")).alias("node"), "v")).items()):
        mu, kappa = fit_of(n, total)
        t.nodes[name] = Node(name, "root", 1, tuple(mu), kappa, n)
    return t


def splits(members: DataFrame, s: Settings, most: int = ALONE) -> dict[str, list[tuple[np.ndarray, float]]]:
    """For every node that separates by epsilon at least: its parts' mean directions and concentrations."""
    found = proposals.split_parts(members, s, most)
    return {node: [fit_of(n, t) for n, t in parts] for node, (gate, parts, _) in found.items() if gate == "split"}


def routed(queries: DataFrame, tree: Taxonomy, s: Settings) -> tuple[DataFrame, proposals.Cells, dict[str, proposals.Cell]]:
    """The walk with the queries' vectors (vec_id, node, weight, residual, v), written; cells of its members, and counts and sums of its residual hits, from one pass."""
    found = materialise(walk(queries, tree, s, True, vectors=True), "walk")
    hit = F.col("residual")
    both = proposals.cell_sums(found.select(F.concat(F.when(hit, "h").otherwise("m"), "node").alias("node"), "v", F.when(hit, 1.0).otherwise(F.col("weight")).alias("weight")))
    cells, hits = ({k[1:]: c for k, c in both.items() if k[0] == kind} for kind in "mh")
    return found, proposals.Cells(cells), hits


def evolve(queries: DataFrame, s: Settings = Settings()) -> tuple[Taxonomy, DataFrame, list[dict]]:
    """Bootstrap, then in each round split, prune, merge and collapse by proposals, refit and route anew, until the topology is quiet.

    Gives the taxonomy, the memberships (vec_id, node, weight) and a record for each round. Every query keeps a mass of one.
    """
    queries = materialise(queries, "queries")  # read several times in every round
    tree, history, quiet = bootstrap(queries), [], 0
    found, cells, hits = routed(queries, tree, s)
    for i in range(s.rounds):
        before = set(tree.nodes)
        members = found.filter("NOT residual").select("vec_id", "node", "weight", "v")
        viable = proposals.viable(hits, tree, cells, s) if s.residuals and any(n.kappa < s.diffuse_kappa for n in tree.nodes.values()) else ()
        tree, cells, grown, log = proposals.split_pass(members, tree, cells, s, viable=viable)
        # members are read again only where leaves starve
        stored = materialise(grown, "grown") if any(r.accepted for r in log) and proposals.starved(tree, cells, s) else None
        tree, cells, _, more = proposals.optimise(grown if stored is None else stored, tree, cells, s)
        log += more
        tree = proposals.refit(tree, cells)
        for done in (stored, found):
            if done is not None:
                discard(done)
        found, cells, hits = routed(queries, tree, s)
        changed = len(before ^ set(tree.nodes))
        history.append({"round": i, "nodes": len(tree.nodes), "leaves": len(tree.leaves()), "edits": changed, "accepted": sum(r.accepted for r in log), "proposals": len(log), "objective": cells.objective()})
        quiet = quiet + 1 if not changed else 0
        if quiet >= s.quiet_rounds:
            break
    return tree, found.filter("NOT residual").select("vec_id", "node", "weight"), history
