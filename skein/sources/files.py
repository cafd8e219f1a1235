"""Sources from files, and results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """One row per file: ``source_id, path, content, valid``.

    ``source_id`` is a hash of the path.  ``valid`` is false for files that aren't
    UTF-8 (content null) and for those with nothing but white space.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(fine, F.decode("content", "UTF-8"))
    rows = files.select(F.xxhash64("path").alias("source_id"), "path", text.alias("content"))
    return rows.withColumn("valid", F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)))


def write_lines(results: DataFrame, path: str, value: str, key: str = "source_id") -> None:
    """Results as text files, in order within each source; a source's lines stay in one file."""
    placed = results.repartitionByRange(key, "ord").sortWithinPartitions(key, "ord")
    placed.select(F.col(value).alias("value")).write.text(path)


def spread(sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows evenly over ``partitions`` (as many as the cluster has cores) if they come in fewer.

    Parsing costs far more than moving a text; a table that already comes in
    enough partitions is left alone.
    """
    wanted = partitions or sources.sparkSession.sparkContext.defaultParallelism
    return sources.repartition(wanted) if sources.rdd.getNumPartitions() < wanted else sources
