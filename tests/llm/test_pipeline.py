"""The pipeline against brute force, stage by stage, on a small table with every awkward case."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from canopyrank.llm import langid, packing

from .test_operators import alnum, base_spans, brute_fp, windows

LANGUAGES = {"en": "the of and house water runs in that was for with his", "de": "der und von haus wasser läuft im dass war für mit sein", "fr": "le de et maison eau coule dans que était pour avec son"}


def corpus():
    rng = random.Random(11)
    rows, add = [], lambda t, lang: rows.append((len(rows), t, lang, f"s{len(rows) % 5}", len(t or "")))
    for lang, w in LANGUAGES.items():
        for k in range(25):
            add(" ".join(rng.choice(w.split()) + (f"{rng.choice('abcdef')}{rng.randrange(900)}x" if rng.random() < 0.5 else "") for _ in range(120)), lang)
    item = " ".join(f"exam{i}" for i in range(20))
    for t in (None, "", "12 34 !?", rows[3][1], rows[3][1], rows[30][1]):
        add(t, None)
    words = rows[5][1].split()
    words[60] = "changed"
    add(" ".join(words), "en")  # one word of 120: five-word shingles 0.92 alike
    add(rows[7][1] + " " + item, "en")
    add(" ".join(item.split()[:13]), "en")
    add(rows[8][1] + " password=abcdefgh1 Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1", None)
    add("the of and " * 3 + "Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9 in that was", "en")
    return rows, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def accepted(rows, model):
    of, out = langid.Labeller(model), []
    for i, t, lang, source, n in rows:
        pred, score = of.label(t)
        if pred != "und" and score >= 0.5:
            out.append((i, t, lang or pred, source, n))
    return out


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def one_of_each(rows):
    fps = [brute_fp(r[1]) for r in rows]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [r for k, r in enumerate(rows) if root[k] == k]


def uncontaminated(rows, items):
    win, out = windows(items), []
    for r in rows:
        w = alnum(r[1])
        hit = {p for a in range(len(w)) for k in {len(x) for x in win} if tuple(w[a : a + k]) in win for p in range(a, a + k)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def masked(rows):
    """Base spans, and bare tokens that fewer than three sources hold and that meet no base span."""
    bare = re.compile(r"[A-Za-z0-9+/_-]{20,}")
    looks = lambda v: all(re.search(p, v) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    owners, spans = {}, []
    for r in rows:
        base = base_spans(r[1])
        own = [(m.start(), 3, m.end(), m[0]) for m in bare.finditer(r[1]) if looks(m[0]) and not any(a < m.end() and m.start() < z for a, _, z in base)]
        for x in own:
            owners.setdefault(x[3], set()).add(r[3])
        spans.append((base, own))
    out = []
    for r, (base, own) in zip(rows, spans):
        at, parts = 0, []
        for a, _, z in sorted(base + [x[:3] for x in own if len(owners[x[3]]) < 3]):
            if a >= at:
                parts += [r[1][at:a], "<secret>"]
            at = max(at, z)
        t = "".join(parts) + r[1][at:]
        out.append((*r[:1], t, *r[2:4], len(t) if parts else r[4]))
    return out


def test_every_stage_equals_brute_force(spark, tables):
    tk = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    want = accepted(rows, langid.train(docs))
    steps = [want, one_of_each(want)]
    steps.append(uncontaminated(steps[-1], items))
    steps.append(masked(steps[-1]))
    for (name, stage), expect in zip(corpus_pipeline.STAGES, steps):
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = sorted(tuple(r) for r in docs.collect())
        assert got == sorted(expect), name
    assert len(rows) > len(steps[0]) > len(steps[1]) > len(steps[2]) == len(steps[3]) and steps[2] != steps[3]
    plain = Tokenizer.from_file(tk.path("word_bpe_49k.json"))
    ids = {r[0]: [*plain.encode(r[1], add_special_tokens=False).ids, packing.END_ID] for r in steps[3]}
    out = corpus_pipeline.run(spark, at).collect()
    seen = {i: [] for i in ids}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(v) == list(range(len(ids[i]))) for i, v in seen.items())
    loads = {}
    for r in out:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= packing.CAPACITY


def test_empty_tables_nulls_and_clashing_names(spark, tmp_path):
    at = str(tmp_path)
    names = "doc_id long, text string, lang string, source string, n_chars long, w string, root string, score double, hash string, item string"
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    known = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)  # a row that the language model may learn from
    row = (known, "the of and house", "en", "s", 3, "w", "r", 0.5, "h", "i")
    for k, data in enumerate(([], [(None,) * 10, row, row, (None, "house of the water", *(None,) * 8)])):
        sf = f"{at}/t{k}"
        docs = spark.createDataFrame(data, names)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.schema.names == [x.split()[0] for x in names.split(", ")], name
        assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() == (2 if data else 0)
