import hashlib
import re

import pytest

from skein.llm import common, exact_dedup, mixing
from skein.llm.queries import ORACLES, QUERIES

from .. import oracle

SCHEMA = "doc_id long, text string, lang string, source string, norm string, uid int, rank int, `a.b` string"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, "x", 7, 9, "y") for i, t, s in rows], SCHEMA)


ROWS = [
    (5, "a  b", "s"), (2, "a\tb", None), (9, "a b", "s"), (2, "a\n\r b", "t"), (None, "a b", "t"), (3, None, "t"), (1, "", None),
    (4, " ", "s"), (6, "A b", "s"), (6, "A b", "s"), (None, "zz", "u"), (7, "w " * 50_000, "u"), (8, "a b", "s"),
]


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op10_source_mix"])
def test_query_equals_sql(spark, sf_dir, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name], sf_dir)


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        sha = hashlib.sha256(re.sub("[\x20\t-\r]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(sha, []).append(i)
    keep = {s: min(v, key=lambda i: (i is None, i or 0)) for s, v in groups.items()}
    return groups, keep


def test_dedup_edges(spark):
    groups, keep = brute(ROWS)
    got = exact_dedup.exact_dedup(table(spark, ROWS).repartition(5)).collect()
    assert len(got) == len(ROWS)
    for sha, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == sha]
        assert sorted(map(repr, (r.doc_id for r in mine))) == sorted(map(repr, ids))
        assert {r.keep_id for r in mine} == {keep[sha]} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [keep[sha]]


def test_dedup_of_many_runs_and_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", "s") for i in range(600)]
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(40)).collect()
    groups, keep = brute(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {
        (i, keep[s], len(v), i == keep[s]) for s, v in groups.items() for i in v
    }


def test_keep_first(spark):
    df = table(spark, ROWS)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, brute(ROWS)[1].values()))
    assert exact_dedup.keep_first(df.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Excess reshared by weight until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ones = share * sum(sizes.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in open_ones) if open_ones else 0
        over = [s for s in open_ones if level * weight[s] >= cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_ones}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_ones.remove(s)


def test_mix_targets_and_draw(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 7}" if i % 3 else None) for i in range(2000)] + [(None, None, "empty"), (1, "", "empty"), (5, "x y", "é")] * 2
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    words = {}
    source_of = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in got:
        s = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 2
        words[s] = words.get(s, 0) + r.copies * r["size"]
    for s, n in words.items():
        assert abs(n - want[s]) <= 80
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixed_rows(spark):
    df = table(spark, ROWS)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = mixing.mix(df).agg({"copies": "sum"}).first()[0]
    assert out.count() == copies
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_words(spark):
    texts = ["", " ", "a", " a\tb\x0bc\r\nd ", " x y", "  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(mixing.F.col("t"))).collect()
    assert [r[0] for r in got] == [len(re.findall("[^\x20\t-\r]+", t)) for t in texts]


def test_copies_add_up_to_the_target(spark):
    rows = [(i, "one two three four", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        assert mixing.mix(df, share=1 / 3, seed=seed).agg({"copies": "sum"}).first()[0] == 100


def test_a_folder_that_all_share(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    assert common.shared_dir(spark)


def test_runs_delete_their_own_tables_only(spark):
    import os

    def files(path):
        return os.path.isdir(path.removeprefix("file:"))

    with common.run_tables() as outer:
        one = common.materialise(spark.range(3), "one")
        with common.run_tables() as inner:
            common.materialise(spark.range(4), "two")
            common.materialise(spark.range(5), "three")
            gone = inner[0]
            common.release(spark, inner, keep=1)
        assert len(inner) == 1 and len(outer) == 3 and not files(gone) and files(inner[0]) and one.count() == 3
        common.release(spark, outer)
    assert not files(inner[0])
