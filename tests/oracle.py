"""Registered queries against their SQL on the same files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(_plain, r)) for r in rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want
