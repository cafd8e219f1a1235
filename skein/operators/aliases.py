"""Telling names for variables: a table of what they are also called, and the best of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def alias_table(found: DataFrame, name: str = "name", alias: str = "alias", confidence: str = "confidence", ord: str = "ord") -> DataFrame:
    """``name, alias, confidence, ord``: each alias of a name once, where it first came up.

    Its confidence is the first one given, or ``high`` if any is.  Aggregated
    before the shuffle, so names with any number of rows are fine.
    """
    first = F.min_by(F.col(confidence), F.col(ord))
    high = F.bool_or(F.coalesce(F.col(confidence) == "high", F.lit(False)))
    return found.groupBy(F.col(name).alias("name"), F.col(alias).alias("alias")).agg(
        F.when(high, "high").otherwise(first).alias("confidence"), F.min(ord).alias("ord")
    )


def tier(alias: Column) -> Column:
    """0 for compound names of a common word, 1 for others, 2 for the common word alone, 3 for names that stand for anything."""
    low = F.lower(alias)
    return (
        F.when(low.isin(list(fixed.LETTERS)) | low.rlike("|".join(fixed.TEMPORARY)), 3)
        .when(low.isin(list(fixed.COMMON)), 2)
        .when(low.rlike("|".join(fixed.COMMON)) & (F.length(alias) > 4), 0)
        .otherwise(1)
    )


def best_aliases(table: DataFrame) -> DataFrame:
    """``name, best`` of an :func:`alias_table`: by tier, confidence, length and order; null aliases don't count."""
    sure = F.coalesce(F.array_position(F.array(*map(F.lit, fixed.CONFIDENCE)), F.col("confidence")), F.lit(0))
    order = F.struct(tier(F.col("alias")).alias("tier"), (-sure).alias("sure"), F.length("alias").alias("size"), F.col("ord"))
    best = F.min_by("alias", F.when(F.col("alias").isNotNull(), order))
    return table.groupBy("name").agg(F.coalesce(best, F.first("name")).alias("best"))
