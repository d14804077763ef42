"""Separation, routing and evolution on made-up clusters."""

import json
import zipfile

import numpy as np

from canopyrank.operators import taxonomy as T
from canopyrank.sources import outputs, sinks


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, category int, v array<double>, node string")


def test_orthogonal_cells_separate_fully_and_mixed_ones_do_not(spark):
    e = np.eye(8)
    apart = [(i, 0, e[i % 2].tolist(), f"n{i % 2}") for i in range(40)]
    mixed = [(i, 0, e[i % 2].tolist(), f"n{(i // 2) % 2}") for i in range(40)]
    assert T.separation(frame(spark, apart)) == 1.0
    assert abs(T.separation(frame(spark, mixed))) < 0.05
    assert T.separation(frame(spark, [(i, 0, e[i % 2].tolist(), "n") for i in range(40)])) == 0.0


def test_evolution_finds_the_clusters_within_a_category_and_conserves_mass(spark):
    rng = np.random.default_rng(0)
    centre = np.linalg.qr(rng.normal(size=(16, 16)))[0][:4]
    rows = []
    for i in range(160):
        x = centre[i % 4] + 0.05 * rng.normal(size=16)
        rows.append((i, i % 4 // 2, (x / np.linalg.norm(x)).tolist(), ""))
    tree, members, history = T.evolve(frame(spark, rows), T.Settings(least=10, rounds=3, quiet_rounds=1))
    assert len(tree.leaves()) == 4 and history[0]["edits"] == 4
    mass = members.groupBy("vec_id").sum("weight").collect()
    assert len(mass) == 160 and all(abs(r[1] - 1) < 1e-9 for r in mass)


def test_outputs_from_zip_and_json(spark, tmp_path):
    item = [{"question_id": 1, "question": "q", "options": ["a", "b"], "answer": "A", "pred": "A", "category": "math"}, {"id": 2, "question": "r", "answer": "B"}, {"id": 3}]
    (tmp_path / "model_outputs_two_0shots.json").write_text(json.dumps(item))
    with zipfile.ZipFile(tmp_path / "model_outputs_one_5shots.zip", "w") as z:
        z.writestr("x.json", json.dumps(item))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = sorted((r.model_name, r.question_id, r.is_correct) for r in outputs.read_outputs(spark, str(tmp_path)).collect())
    assert got == [("one", 1, True), ("one", 2, False), ("two", 1, True), ("two", 2, False)]
    assert {r.model_name for r in outputs.catalogue(spark, str(tmp_path)).collect()} == {"one", "two", "bad"}


def test_drawings_and_snapshots(spark, tmp_path):
    e = spark.createDataFrame([("root", "a", "TREE"), ("a", "b", "TREE"), ("root", "b", "CROSS")], "p string, c string, kind string")
    assert '"root" -> "b" [style=dashed];' in sinks.graphviz(e)
    assert sinks.text_tree(e).split("\n") == ["root", "  a", "    b"] and sinks.text_tree(e, compact=True) == "root / a / b"
    sinks.save_snapshot({"edges": e}, str(tmp_path), "s1")
    assert sinks.load_snapshot(spark, str(tmp_path), "edges", "s1").count() == 3
