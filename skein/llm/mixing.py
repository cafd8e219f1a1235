"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranked, row_of, text_of

#: Weights in code-point order of the sources, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Maximal runs of anything but white space: each begins after white space or at the start."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets by source: ``source, source_size, target``.

    ``sizes`` has ``source, size``.  The sources together get ``share`` times all
    words, by weight; none gets more than ``cap`` times its own, and what is
    above goes to the others by weight until no source is above.  At that fixed
    point a source has ``min(cap * size, level * weight)`` for one level, which
    is raised here until the sources below their caps take all that is left.
    Only the level's sums come to the driver; the table of sources, which may be
    long, stays distributed.  Sums run over integers, so they don't depend on
    the order of addition.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(sources, [], ["source"], "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    placed = materialise(placed.select("source", "source_size", w.alias("weight")), "source-weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(cap)
        n, full, open_weight = placed.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == seen or not open_weight:
            break
        seen, level = n, (share * total - cap * full) / open_weight
    target = F.least(F.col("source_size") * F.lit(cap), F.col("weight") * F.lit(level))
    return placed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """How often the mix takes each row: ``doc_id, text_hash, size, source_size, target, copies``.

    Within a source every document is expected ``target / source_size`` times.
    Documents are laid end to end in order of size (ties in a fixed order drawn
    by hash); the expected copies' prefix sum, plus one offset drawn from the
    source's name and ``seed``, crosses whole numbers, and each crossing emits a
    copy.  Order by size makes the words taken follow the target within about
    the size of one large document, and never more than ``ceil(cap)`` copies of
    one are taken.  The draw depends on nothing but the rows, so reruns agree;
    rows equal in identifier and text are interchangeable.

    A null source is a source of its own, the last in order; null texts have
    size 0, and a source without words has target 0 and emits nothing.  An empty
    table gives no rows.  A source of any share of the rows is spread over tasks
    (see :func:`skein.llm.common.ranked`).
    """
    body = text_of(docs, text)
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        docs[source].cast("string").alias("source"),
        word_count(body).alias("size"),
        F.xxhash64(body).alias("text_hash"),
    )
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumn("draw", F.md5(F.concat(number, F.lit(f":{seed}"))))
    rows = materialise(rows, "sizes")
    targets = source_targets(rows, weights, share, cap)
    placed = ranked(rows, ["source"], ["size", "draw", "doc_id", "text_hash"], "mix-order")
    t = targets.withColumnRenamed("source", "_source")
    placed = placed.join(t, placed["source"].eqNullSafe(t["_source"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = F.least(each, F.lit(float(cap)))
    drawn = F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}")))
    offset = F.conv(F.substring(drawn, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    # both ends by one formula, so that neighbours share their boundary to the last bit
    crossed = F.floor((F.col("rank") + 1) * each + offset) - F.floor(F.col("rank") * each + offset)
    return placed.select("doc_id", "text_hash", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """:func:`mix` as words taken: ``doc_id, size, source_size, target, taken``."""
    return mix(docs, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each input row as often as :func:`mix` takes it, columns as they were.

    Rows equal in identifier and text share their copies: they are numbered on
    both sides, each number meeting its own.
    """
    made = mix(docs, text=text, doc_id=doc_id, **options).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "copies"
    )
    made = materialise(made, "copies")
    keys = ["_id", "_hash"]
    repeats = made.groupBy(*keys).count().filter("count > 1").limit(1).count()
    marked = docs.select(
        row_of(docs).alias("_row"),
        docs[doc_id].alias("_d"),
        F.xxhash64(text_of(docs, text)).alias("_h"),
    )
    on = marked["_d"].eqNullSafe(made["_id"]) & (marked["_h"] == made["_hash"])
    if repeats:
        made = made.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("copies")))
        marked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_h").orderBy("_h")))
        on = marked["_d"].eqNullSafe(made["_id"]) & (marked["_h"] == made["_hash"]) & (marked["_n"] == made["_k"])
    out = marked.join(made.filter("copies > 0"), on)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
