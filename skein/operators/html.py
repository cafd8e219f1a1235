"""What HTML texts hold, as rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..javascript import markup
from ..plans.frames import fresh, named, others

PIECE = "struct<kind: string, tag: string, name: string, value: string>"


def pieces(html: Column, kinds: Sequence[str] = ("attribute", "comment", "script")) -> Column:
    """An array of ``kind, tag, name, value`` of each text, in order; only pieces of the given kinds leave Python."""
    wanted = frozenset(kinds)

    @F.pandas_udf(f"array<{PIECE}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [[p for p in markup.read(t) if p.kind in wanted] if t else [] for t in texts]
            yield pd.Series([[{"kind": p.kind, "tag": p.tag, "name": p.name, "value": p.value} for p in f] for f in found], dtype=object)

    return read(F.coalesce(html.cast("string"), F.lit("")))


def _rows(pages: DataFrame, html: str, kinds: Sequence[str], made: dict[str, str]) -> DataFrame:
    """The other columns and those that are made: ``ord``, the place among all given kinds, and parts of the pieces."""
    rest, at, p = others(pages, html, made), fresh("at"), fresh("piece")
    rows = pages.select(*rest, F.posexplode(pieces(named(html), kinds)).alias(at, p))
    return rows.select(*rest, *[F.col(at).cast("long").alias(name) if part == "ord" else F.col(f"{p}.{part}").alias(name) for name, part in made.items()])


def html_pieces(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns, then ``ord, kind, tag, name, value``: attributes, comments and inline scripts in order.

    Null texts have none.  Columns named like the operator's own give way to them, here and below.
    """
    return _rows(pages, html, ("attribute", "comment", "script"), {c: c for c in ("ord", "kind", "tag", "name", "value")})


def html_attributes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Attributes that may hold addresses: those of the known tags, and data attributes of any tag.

    ``rank`` is the place in the table of tags and attributes, its length for data attributes.
    """
    made = {c: c for c in ("ord", "tag", "name", "value")}
    pages = pages.select(*others(pages, "rank"))  # gives way as well
    found = _rows(pages, html, ("attribute",), made)
    table = F.array(*[F.lit(f"{t} {a}") for t, a in fixed.TAG_ATTRIBUTES])
    place = F.array_position(table, F.concat("tag", F.lit(" "), "name")).cast("int")
    rank = F.when(place > 0, place - 1).when(F.col("name").isin(list(fixed.DATA_ATTRIBUTES)), len(fixed.TAG_ATTRIBUTES))
    return found.withColumn("rank", rank).filter("rank is not null")


def inline_scripts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Code of scripts without a source: the other columns, ``ord`` and ``code``."""
    return _rows(pages, html, ("script",), {"ord": "ord", "code": "value"})


def html_comments(pages: DataFrame, html: str = "html") -> DataFrame:
    return _rows(pages, html, ("comment",), {"ord": "ord", "comment": "value"})
