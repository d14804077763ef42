"""Exports and snapshots. Tables go out through Spark's writers; text forms are made from node tables, which are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = ("nodes", "edges", "memberships", "residuals", "pair_stats", "bt_states", "ratings", "matches")
#: Rows of a typeset leaderboard at most.
MOST_MODELS = 1000


def save_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: str) -> None:
    """Write tables under root/<table>/snapshot_id=<id>; another save of the id takes its place."""
    for name, df in tables.items():
        if name not in SNAPSHOT:
            raise ValueError(f"{name} is none of {SNAPSHOT}")
        df.write.mode("overwrite").parquet(f"{root}/{name}/snapshot_id={snapshot_id}")


def load_snapshot(spark: SparkSession, root: str, name: str, snapshot_id: str | None = None) -> DataFrame:
    """A table of one snapshot, or of all with snapshot_id as a column; columns that older snapshots lack are null."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
    return df if snapshot_id is None else df.filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def drop_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> None:
    for name in SNAPSHOT:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/snapshot_id={snapshot_id}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by ;."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def _kids(edges: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Children by parent. A topology has hundreds of nodes; more than this bound are refused."""
    rows = edges.select("p", "c", "kind").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the topology is too large to draw")
    out: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        out.setdefault(r["p"], []).append((r["c"], r["kind"]))
    return {p: sorted(v) for p, v in out.items()}


def graphviz(edges: DataFrame) -> str:
    """Tree edges solid, cross edges dashed."""
    lines = [f'  "{p}" -> "{c}"{" [style=dashed]" if kind == "CROSS" else ""};' for p, v in sorted(_kids(edges).items()) for c, kind in v]
    return "\n".join(["digraph taxonomy {", *lines, "}"])


def text_tree(edges: DataFrame, root: str = "root", compact: bool = False) -> str:
    """Indented tree; compact joins chains of single children by /."""
    kids, out = _kids(edges), []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        name, below = node, [c for c, k in kids.get(node, []) if k == "TREE"]
        while compact and len(below) == 1:
            name, node = f"{name} / {below[0]}", below[0]
            below = [c for c, k in kids.get(node, []) if k == "TREE"]
        out.append("  " * depth + name)
        stack += [(c, depth + 1) for c in reversed(below)]
    return "\n".join(out)


def latex_leaderboard(board: DataFrame) -> str:
    """A table of model, score and rank, best first. More rows than fit a document are refused."""
    rows = board.select("model", "score").orderBy(F.desc("score"), "model").limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError("the leaderboard is too long to typeset")
    body = [f"{i} & {r['model'].replace('_', chr(92) + '_')} & {r['score']:.3f} " + r"\\" for i, r in enumerate(rows, 1)]
    return "\n".join([r"\begin{tabular}{rlr}", r"\# & Model & Score \\", *body, r"\end{tabular}"])
