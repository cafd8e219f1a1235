import random

import numpy as np
import pytest

from skein.llm import jaccard
from skein.llm.queries import ORACLES, QUERIES

from .. import oracle


def test_query_equals_sql(spark, sf_dir):
    oracle.compare(spark, QUERIES["op8_ngram_jaccard"], ORACLES["op8_ngram_jaccard"], sf_dir)


def grams(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, least=0.8):
    sets = [grams(t or "") for _, t in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) > 0:
                links[i].append(j)
                links[j].append(i)
    top = list(range(n))
    for _ in range(n):
        new = [min([top[i], *(top[j] for j in links[i])]) for i in range(n)]
        if new == top:
            break
        top = new
    out = []
    for i in range(n):
        group = [rows[j][0] for j in range(n) if top[j] == top[i]]
        head = min(group, key=lambda d: (d is None, d or 0))
        out.append((rows[i][0], head, len(group), len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, set_key string, comp int")
    got = jaccard.similar(df.repartition(3), **options).collect()
    return sorted(((r.doc_id, r.class_id, r.class_size, r.n_links, r.n_set_links) for r in got), key=repr)


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.random()}"
    return " ".join(words)


def sample(seed=1, groups=12, size=6):
    r = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([30, 60, 200]))]
        for _ in range(r.randint(1, size)):
            rows.append((i, changed(r, base, r.choice([0, 1, 2, 4]))))
            i += 1
    return rows


def test_equals_brute_force_with_edges(spark):
    rows = sample()
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a b"), (904, "a  b"), (905, "a b c"), (None, rows[0][1]), (None, "unlike anything else at all here"), (3, rows[3][1])]
    rows += [(950, "long " + " ".join(f"v{j}" for j in range(30_000)))] * 2
    assert run(spark, rows) == brute(rows)


def test_large_group_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    monkeypatch.setattr(jaccard, "PRODUCT_COLUMNS", 64)
    monkeypatch.setattr(jaccard, "BUCKET_SETS", 16)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 50)
    r = random.Random(9)
    base = [f"w{j}" for j in range(120)]
    rows = [(i, changed(r, base, r.randint(0, 4))) for i in range(70)] + [(100 + i, " ".join(base)) for i in range(30)] + [(200 + i, t) for i, t in sample(4, 5)]
    assert run(spark, rows) == brute(rows)


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.99999), (0.7, 0.999), (0.9, 0.99)):
        bands, rows = jaccard.banding(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall > 1 - (1 - similarity**rows) ** (bands - 1)


def test_minhash_estimates_similarity():
    sign = jaccard._signer(400, 1)
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 100, dtype=np.uint64)])
    assert (sign(np.sort(a))[0] == sign(np.sort(b))[0]).mean() == pytest.approx(800 / 1100, abs=0.07)


def test_sketches_of_similar_sets_are_alike():
    sign = jaccard._signer(*jaccard.banding())
    r = np.random.default_rng(2)
    for n in (5, 40, 900):
        for _ in range(60):
            a = r.integers(0, 2**63, 9 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            b, far = np.concatenate([a[: 8 * n], r.integers(0, 2**63, n, dtype=np.uint64)]), a[: 3 * n]
            both = np.array([sign(np.sort(x))[1] for x in (a, b, far)])
            assert jaccard._alike(both).tolist() == [0, 0, 2]


def test_alike_equals_brute_force():
    r = np.random.default_rng(5)
    for _ in range(40):
        base = r.integers(0, 256, (4, 126), dtype=np.uint8)
        rows = base[r.integers(0, 4, 30)]
        rows = np.where(r.random(rows.shape) < 0.28, r.integers(0, 256, rows.shape, dtype=np.uint8), rows)
        top = list(range(30))
        near = (rows[:, None] == rows[None]).sum(axis=2) >= np.ceil(jaccard.ALIKE * 126)
        for _ in range(30):
            top = [min(top[j] for j in range(30) if near[i, j]) for i in range(30)]
        assert jaccard._alike(rows).tolist() == top


def test_keep_one(spark):
    rows = sample(3) + [(3, sample(3)[3][1]), (None, "alone in the world with it"), (500, None), (501, "")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, _row string, comp int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, c, *_ in brute(rows)}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want))
    assert jaccard.keep_one(df.limit(0)).count() == 0 and jaccard.similar(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
