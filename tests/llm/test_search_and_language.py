import random

import numpy as np
import pytest

from skein.llm import langid, topk
from skein.llm.queries import ORACLES, QUERIES

from .. import oracle


def test_query_equals_sql(spark, sf_dir):
    oracle.compare(spark, QUERIES["op5_top_k"], ORACLES["op5_top_k"], sf_dir)


def brute(rows, k=5, every=50):
    fit = [(i, [float(np.floor(256 * x)) if abs(x) < 1e12 else max(min(256 * x, 1.7976931348623157e308), -1.7976931348623157e308) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fit):
        if i is None or i % every:
            continue
        found = []
        for b, (j, x) in enumerate(fit):
            if a != b and len(q) == len(x):
                s = sum(int(c) * int(d) for c, d in zip(q, x))
                found.append((-min(max(s, -(2**63)), 2**63 - 1), j is None, j or 0, j))
        out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.repartition(3), **options).collect()), key=repr)


def test_top_k_edges(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(0, 300, 5)]
    rows += [(50, [1.0, 0.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0, 0.0]), (0, rows[0][1]), (None, [1.0, 1.0, 1.0, 1.0]), (100, None), (150, [1.0, None, 0.0, 0.0])]
    rows += [(200, [float("nan"), 0.0, 0.0, 0.0]), (250, [float("inf"), 0.0, 0.0, 0.0]), (400, [1.0, 2.0]), (-50, [0.1] * 4), (7, []), (450, [])]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(topk, "TILE_BYTES", 64)
    assert run(spark, rows) == brute(rows)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e10, -1e10]), (50, [3e9, 1.0]), (3, [1e300, 1.0]), (4, [-1e300, 1.0]), (5, [2.5, 2.5]), (100, [1.7e308, -1.7e308])]
    assert run(spark, rows) == brute(rows)


def test_top_k_without_rows(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0


def naive_phrases(text, reference):
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference and text[at : at + size] in reference:
            size += 1
        count, at = count + 1, at + size
    return count


@pytest.mark.parametrize("stretch, dense", [(7, 10**6), (7, 0), (64, 0), (4096, 10**6)])
def test_phrases_equal_brute_force(monkeypatch, stretch, dense):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    monkeypatch.setattr(langid, "DENSE", dense)
    r = random.Random(1)
    refs = {"x": "".join(r.choice("ab c") for _ in range(400)), "y": "".join(r.choice("bcd ") for _ in range(300))}
    parser = langid.CrossParser(refs)
    plain = {k: "".join(map(chr, langid.normalise(v))) for k, v in refs.items()}
    texts = ["".join(r.choice("abcde ") for _ in range(r.randint(0, 300))) for _ in range(80)]
    texts += ["a" * 250, "ab" * 120, refs["x"][30:300], refs["x"] + refs["y"]]
    forms = [langid.normalise(t) for t in texts]
    counts = parser.phrases(forms)
    for form, row in zip(forms, counts, strict=True):
        text = "".join(map(chr, form))
        assert row.tolist() == [naive_phrases(text, plain[k]) for k in ("x", "y")]


def test_automata_of_large_alphabets_are_small():
    r = random.Random(6)
    texts = {k: "".join(chr(r.randint(0x4E00, 0x64AB)) for _ in range(60_000)) for k in ("ja", "zh")}
    parser = langid.CrossParser(texts)
    assert all(a.dense is None for a in parser.automata) and sum(a.slots.nbytes + a.first.nbytes for a in parser.automata) < 30_000_000
    pieces = [langid.normalise(texts["zh"][i : i + 50]) for i in range(0, 5000, 50)]
    counts = parser.phrases(pieces)
    assert (counts[:, 1] <= 3).all() and (counts[:, 0] > 20).all()


def test_languages_with_little_text_compete_fairly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    refs = langid.fit(docs)
    refs = {k: v if k == "en" else v[:6000] for k, v in refs.items()}
    rows = docs.select("lang", langid.identify(docs, refs).alias("f")).filter("f.n_letters >= 200").select("lang", "f.lang_pred").collect()
    assert sum(x.lang == x.lang_pred for x in rows) / len(rows) >= 0.99


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, None, "en", 1), (2, "", "fr", 1), (3, "123 !!", None, 1), (None, "the cat and the dog " * 9, "en", 1), (11, "the cat sat with the dog " * 20, "en", 1)]
    rows += [(11, "the cat sat with the dog " * 20, "en", 1), (10, "le chat et le chien " * 20, "fr", 1), (7, "le chat " * 3000, None, 1), (8, "cat", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, found int")
    got = langid.language_id(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[3].score == 0
    assert by[7].lang_pred == "fr" and by[8].lang_pred == "en" and by[None].held_out
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "11", "11", "7", "8", "None"]
    assert langid.language_id(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "some words here", "secret" if i in held else "en") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(df)) == {"en"}
    assert {r.doc_id for r in langid.language_id(df).filter("held_out").collect()} == set(held)


def test_random_letters_are_rejected(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(5)
    noise = spark.createDataFrame([(10**6, "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(400)), None)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in langid.keep_identified(df.unionByName(noise)).collect()}
    assert 10**6 not in kept and len(kept) == df.count()


def test_any_number_of_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 20)
    monkeypatch.setattr(langid, "ALL_CHARS", 4000)
    rows = [(i, "some words of it " * 3, f"l{i}") for i in range(200)] + [(200 + i, "the cat and the dog sat " * 20, "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = langid.fit(df)
    assert len(refs) == 20 and "en" in refs and all(len(v) <= 4000 // 20 + 20 for v in refs.values())
    assert langid.language_id(df).filter("doc_id >= 200 and lang_pred = 'en'").count() == 30
