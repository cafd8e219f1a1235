"""Addresses from streams of sources: the same stateless operators, and repeats dropped across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.urls import extract_urls
from ..plans.options import UrlOptions


def stream_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they come into a folder: ``path, content, at``; a file is a row."""
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder)
    meta = F.col("_metadata")
    return files.select(meta["file_path"].alias("path"), F.col("value").alias("content"), meta["file_modification_time"].alias("at"))


def stream_urls(sources: DataFrame, options: UrlOptions | None = None, delay: str | None = None, time: str = "at") -> DataFrame:
    """Addresses of streamed sources.

    With ``delay``, an address is given once over the whole stream, for as long
    as its first time is within that delay of the watermark; state is bounded by it.
    """
    rows = extract_urls(sources, "content", options or UrlOptions())
    if delay is None:
        return rows
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])
