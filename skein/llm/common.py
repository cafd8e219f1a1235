"""Shared helpers: tables in the cluster's shared folder, row ids, input cleaning."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_runs: ContextVar[tuple[list[str], ...]] = ContextVar("runs", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder in local mode only;
    on a cluster, where executors would write to their own disks, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="skein-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and pins values
    such as ``monotonically_increasing_id`` that a second evaluation may change.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skein/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    for run in _runs.get():
        run.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def run_tables() -> Iterator[list[str]]:
    """The tables that :func:`materialise` writes inside, in order, for :func:`release`.

    They are those of this run alone, whatever other threads write meanwhile.
    """
    mine: list[str] = []
    token = _runs.set((*_runs.get(), mine))
    try:
        yield mine
    finally:
        _runs.reset(token)


def release(spark: SparkSession, tables: list[str], keep: int = 0) -> None:
    """Delete the given tables but for the last ``keep``; the list is left with those.

    For callers that have consumed every result that reads them.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = tables[: len(tables) - keep]
    for path in gone:
        if (spark, path) in _written:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            _written.remove((spark, path))
    del tables[: len(gone)]


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark, [path for s, path in _written if s is spark])
        except Exception:  # the session has ended; its shared folder goes with it
            pass


atexit.register(_release_all)


def parts(df: DataFrame) -> int:
    """Partitions a shuffle of this session makes."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def row_of(df: DataFrame) -> Column:
    """All columns as one, whatever their names; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Materialise ``df`` with ``rank``: the row's place, from 0, within its group.

    No group meets in one task, however large: rows are range-partitioned and
    sorted by group and order, numbered by their place in the sorted table, and
    each partition's first number of a group is set against the rows that
    earlier partitions hold of it (one small row per group and partition).
    Nulls come last.  ``order`` has to tell rows apart for reruns to agree.
    """
    keys = [F.col(c).asc_nulls_last() for c in group + order]
    placed = df.repartitionByRange(parts(df), *keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("_gid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_gid", 33)
    runs = (
        placed.withColumn("_part", part)
        .groupBy(*group, "_part")
        .agg(F.min("_gid").alias("_first"), F.count("*").alias("_n"))
    )
    runs = materialise(runs, name + "-runs")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    starts = starts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], F.col("_part").alias("_kp"), "_first", "_before"
    )
    on = F.shiftright(placed["_gid"], 33) == starts["_kp"]
    for i, c in enumerate(group):
        on = on & placed[c].eqNullSafe(starts[f"_k{i}"])
    return (
        placed.join(starts, on)
        .withColumn("rank", F.col("_gid") - F.col("_first") + F.col("_before"))
        .select(*df.columns, "rank")
    )


def blocks(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def give_back() -> None:
    """Let the system have the memory that this process has freed; Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: dict[str, tuple[object, object]] = {}


def worker_keeps(operator: str, key: object = None, make: Callable | None = None):
    """``make(key)``, kept by this Python worker until another operator runs in it.

    Workers live on from stage to stage; what an earlier stage's operator kept is
    dropped here, and an operator that keeps nothing says so by its name alone.
    """
    if _kept.keys() - {operator}:
        _kept.clear()
        give_back()
    if make is None:
        return None
    if operator not in _kept or _kept[operator][0] != key:
        _kept[operator] = key, make(key)
    return _kept[operator][1]
