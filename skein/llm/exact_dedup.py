"""Exact deduplication: a tree merge of sorted digest runs, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, parts, row_of, text_of

#: Levels' fan-in as a power of two: four binomial rounds are merged in one shuffle.
FAN_BITS = 4
#: What tells texts apart: the digest, and what verifies it.
KEY = ["text_sha256", "length", "check"]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, text_sha256, length, check, uid``.

    Texts count after every run of white space became one space; null counts as
    empty.  ``uid`` numbers the rows and tells repeated rows apart.  The table
    holds no texts and is written once, so that everything after it reads a few
    dozen bytes a document.
    """
    norm = F.regexp_replace(text_of(docs, text), SPACE, " ")
    runs = docs.select(docs[doc_id].alias("doc_id"), norm.alias("norm"))
    runs = runs.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.octet_length("norm").cast("long").alias("length"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("uid"),
    )
    return materialise(runs, "digests")


def merge_runs(rows: DataFrame) -> DataFrame:
    """Merge the partitions' digest runs level by level: ``text_sha256, length, check, keep, group_size``.

    A run is one partition's digests.  At each level, runs whose numbers agree
    but for the lowest bits meet: their entries of equal digest become one that
    keeps the smallest identifier and adds up the sizes, if the length and a
    second hash of another kind verify that the texts are the same.  Each level
    is a sorted-key aggregation dealt by (run group, digest), so that no task
    holds more than a share of a run group, and a digest of which there are
    millions of copies arrives as one entry per run.  The last level has one run left, dealt by digest alone.
    """
    last = rows.agg(F.coalesce(F.max(F.shiftright("uid", 33)), F.lit(0))).first()[0]
    entry = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")
    level = rows.select(
        F.shiftright("uid", 33).alias("run"), *KEY, entry.alias("keep"), F.lit(1).alias("group_size")
    )
    while True:
        last >>= FAN_BITS
        level = (
            level.withColumn("run", F.shiftright("run", FAN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
        if last == 0:
            break
    return level.drop("run")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest ``doc_id`` stays (null last); of
    repeated rows with that identifier, exactly one.  Null texts count as empty,
    empty texts equal each other, an empty table gives no rows, and further
    columns of the input play no part.

    Rows find their group's entry by digest.  A digest that more than one in
    ``n`` rows has is joined as a broadcast table of at most ``n`` entries, as
    no more than ``n`` such digests can exist; all others, none of them hot, are
    joined by a shuffle.
    """
    rows = digests(docs, text, doc_id)
    groups = materialise(merge_runs(rows), "digest-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    n = max(100, 8 * parts(docs))
    hot = groups.filter(F.col("group_size") * n > total)
    tail = rows.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti")
    found = rows.join(F.broadcast(hot), KEY).unionByName(
        tail.join(groups.filter(F.col("group_size") * n <= total), KEY)
    )
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input's rows that :func:`exact_dedup` keeps, all columns as they were.

    The decision travels by (identifier, digest).  Only where the table repeats
    such a pair among the kept is a second pass needed that leaves one row each.
    """
    found = materialise(exact_dedup(docs, text, doc_id), "dedup")
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    again = found.filter("not kept and doc_id <=> keep_id").limit(1).count()
    sha = F.sha2(F.regexp_replace(text_of(docs, text), SPACE, " "), 256)
    marked = docs.select(row_of(docs).alias("_row"), docs[doc_id].alias("_d"), sha.alias("_s"))
    on = marked["_d"].eqNullSafe(kept["_id"]) & (marked["_s"] == kept["_sha"])
    one = marked.join(kept, on, "left_semi")
    if again:
        one = one.dropDuplicates(["_s"])
    return one.select("_row.*")
