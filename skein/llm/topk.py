"""Exact top-k inner products: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts

#: Candidates of a tile and queries of a tile: a score matrix of 2048 x 1024 doubles takes 16 MB.
TILE_ROWS, TILE_QUERIES = 2048, 1024
#: Bytes of vectors, as doubles, that one side of a cell of the grid takes.
TILE_BYTES = 32 << 20
#: Lists merged at each level of the tree.
FAN_IN = 8
_LONG = 1 << 63


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly.

    Doubles are exact as long as no sum can reach 2**53; beyond that Python's
    integers are used, and scores that a long can't hold are cut to its range.
    """
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    out = [[sum(int(a) * b for a, b in zip(row, other, strict=True)) for other in whole] for row in q]
    return np.array([[min(max(v, -_LONG), _LONG - 1) for v in row] for row in out], dtype=np.int64).reshape(len(q), len(x))


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row and their places, of equal ones the first; ``at`` numbers the columns."""
    k = min(k, scores.shape[1])
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        above, level = scores > least, scores == least
        room = k - above.sum(axis=1, keepdims=True)
        taken = above | (level & (np.cumsum(level, axis=1) <= room))
        found = np.nonzero(taken)[1].reshape(len(scores), k)
    else:
        found = np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    got = np.take_along_axis(scores, found, axis=1)
    order = np.argsort(~got, axis=1, kind="stable")  # ~ turns the order of longs round without overflow
    return np.take_along_axis(got, order, axis=1), at[np.take_along_axis(found, order, axis=1)]


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The best k of two lists a row."""
    scores, at = (np.concatenate([a, b], axis=1) for a, b in zip(one, two, strict=True))
    order = np.lexsort((at, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(at, order, axis=1)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, of single precision where that holds them exactly."""
    for pdf in batches:
        packed = []
        for v in pdf["q"]:
            wide = np.asarray(v, dtype=np.float64)
            with np.errstate(over="ignore"):
                narrow = wide.astype(np.float32)
            packed.append((len(wide), (narrow if (narrow == wide).all() else wide).tobytes()))
        out = pdf[["uid", "vec_id"]].copy()
        out["width"], out["q"] = [w for w, _ in packed], [b for _, b in packed]
        yield out


def _matrix(packed: pd.Series, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), 0))
    return np.stack([np.frombuffer(b, dtype=np.float32 if len(b) == 4 * width else np.float64) for b in packed]).astype(np.float64)


def _cell(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of a shard's rows, their own left out, for each query of a block."""
    out = []
    empty = pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("query", "query_id", "score", "vec_id")})
    if asked.empty or rows.empty:
        return empty
    for width in sorted(set(asked["width"]) & set(rows["width"])):
        a, x = asked[asked["width"] == width], rows[rows["width"] == width]
        known = x["vec_id"].notna().to_numpy()
        ids = x["vec_id"].astype("Int64").fillna(0).to_numpy(dtype=np.int64)
        order = np.lexsort((ids, ~known))
        ids, known, uid = ids[order], known[order], x["uid"].to_numpy()[order]
        q, m = _matrix(a["q"], width), _matrix(x["q"].iloc[order], width)
        queries, names = a["uid"].to_numpy(), a["vec_id"].to_numpy(dtype=np.int64)
        for i in range(0, len(q), TILE_QUERIES):
            held = None
            for j in range(0, len(m), TILE_ROWS):
                part = slice(j, j + TILE_ROWS)
                at = np.arange(len(m))[part]
                found = _best(_scores(q[i : i + TILE_QUERIES], m[part]), at, k + 1)
                held = found if held is None else _merged(held, found, k + 1)
            scores, at = held
            own = uid[at] == queries[i : i + TILE_QUERIES, None]
            out.append(
                pd.DataFrame(
                    {
                        "query": np.repeat(queries[i : i + TILE_QUERIES], at.shape[1]),
                        "query_id": np.repeat(names[i : i + TILE_QUERIES], at.shape[1]),
                        "score": scores.ravel(),
                        "vec_id": pd.array(ids[at].ravel(), dtype="Int64"),
                        "known": known[at].ravel(),
                    }
                )[~own.ravel()]
            )
    if not out:
        return empty
    made = pd.concat(out, ignore_index=True)
    made.loc[~made["known"], "vec_id"] = pd.NA
    return made.drop(columns="known")


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is a
    multiple of ``every``; candidates are all rows but the query's own.  Ties go
    to the smaller id, null ids last.  Vectors that are null or hold null or
    non-finite components take no part; vectors of different length are not
    compared.  Rows that repeat are rows of their own: a repeated query row
    answers for itself and sees its copies.  Without queries, or with one row
    only, there are no rows.

    Queries are dealt into blocks and all rows into shards of up to
    ``TILE_BYTES`` each; every block meets every shard in one task of the grid,
    which multiplies tiles, selects k + 1 of each and leaves out the query's own
    row.  Nothing is broadcast or passes through the driver.  The shards' lists
    then merge in a tree of ``FAN_IN``, so no task takes in all of them.
    """
    value = vectors[embedding].cast("array<double>")
    fit = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), value.alias("v")).filter(
        "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    # doubles beyond 2**52 are whole as they are, and a long could not hold the largest
    most = "1.7976931348623157E308D"
    whole = F.expr(
        f"transform(v, x -> if(abs(x * {scale}D) < 9e15D, cast(floor(x * {scale}D) as double), greatest(least(x * {scale}D, {most}), -{most})))"
    )
    fit = fit.select(F.monotonically_increasing_id().alias("uid"), "vec_id", whole.alias("q"))
    fit = materialise(fit.mapInPandas(_packed, "uid long, vec_id long, width int, q binary"), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, asked, width = fit.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max("width"), F.lit(0))).first()
    room = max(1, TILE_BYTES // (8 * max(1, width)))
    blocks = max(1, -(-asked // room))
    # shards for all cores, but not so many that queries are copied more often than there are rows
    shards = max(1, -(-n // room), min(parts(vectors), n // max(1, asked)))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(fit.filter(is_query), "block", blocks, "shard", shards).groupBy("block", "shard")
    # columns of its own for the other side of one table
    fit = fit.select(*[F.col(c).alias(c) for c in fit.columns])
    right = dealt(fit, "shard", shards, "block", blocks).groupBy("block", "shard")

    def cell(key: tuple, a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return _cell(a, x, k).assign(run=key[1])

    lists = left.cogroup(right).applyInPandas(cell, "query long, query_id long, score long, vec_id long, run int")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    n = shards
    while True:
        n = -(-n // FAN_IN)
        lists = lists.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
        best = Window.partitionBy("query", "run").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if n <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
