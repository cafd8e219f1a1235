"""Addresses of JavaScript and HTML sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..javascript import markup
from ..javascript.candidates import Entry, Options, entries
from ..plans.frames import fresh, named, others
from ..plans.options import UrlOptions, extension_set

ENTRY = "struct<original: string, placeholder: string, resolved: string, has_template: boolean, verbatim: boolean>"
#: The problem of a script in a page that no tree could be made of.
UNREADABLE = "unreadable script"


def read_source(text: str, size: int, options: UrlOptions, problems: set[str] | None = None) -> list[tuple]:
    """Candidates of one text; HTML gives its attributes' addresses verbatim, then its scripts' candidates.

    Limits that were met are added to ``problems``.
    """
    own = options.for_size(size)
    if not rules.is_html(text):
        return [(*e, False) for e in entries(text, own, problems)]
    pieces = markup.read(text)
    found = [(a, a, a, False, True) for a in markup.addresses(pieces, own.extensions)]
    for code in markup.scripts(pieces):
        found += [(*e, False) for e in _safely(code, own, problems)]
    return found


def _safely(code: str, options: Options, problems: set[str] | None) -> list[Entry]:
    """A script that can't be read must not take its page with it."""
    try:
        return entries(code, options, problems)
    except (RecursionError, MemoryError):
        if problems is not None:
            problems.add(UNREADABLE)
        return []


def candidates(text: Column, options: UrlOptions, size: Column | None = None) -> Column:
    """Entries of each source, as an array in order of the text; one Arrow batch call for many sources."""

    @F.pandas_udf(f"array<{ENTRY}>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("original", "placeholder", "resolved", "has_template", "verbatim")
        for texts, sizes in batches:
            yield pd.Series(
                [[dict(zip(names, e, strict=True)) for e in read_source(t, n, options)] if t else [] for t, n in zip(texts, sizes, strict=True)],
                dtype=object,
            )

    body = F.coalesce(text, F.lit(""))
    return read(body, F.coalesce(size if size is not None else F.length(body), F.lit(0)).cast("long"))


def format_entries(found: Column, options: UrlOptions) -> Column:
    """Entries as cleaned addresses without junk, each once, in order of first occurrence.

    Everything stays within the row: no shuffle, and order is the array's.
    """
    extra = sorted(extension_set(options.extensions))
    placeholder = options.placeholder
    kept = F.filter(found, lambda e: ~((e["placeholder"] == placeholder) & (F.coalesce(e["resolved"], F.lit("")) == "")))

    def shown(e: Column) -> Column:
        shape = C.clean(e["placeholder"])
        if options.include_templates:
            texts = F.when(e["has_template"], F.array(C.clean(e["original"]), shape)).otherwise(F.array(shape))
        else:
            static = C.clean(F.coalesce(e["resolved"], e["original"]))
            texts = F.when(~e["has_template"], F.array(static)).when(~shape.contains("{"), F.array(shape)).otherwise(
                F.array().cast("array<string>")
            )
        good = F.filter(texts, lambda t: ~C.is_junk(t, placeholder, extra))
        return F.when(e["verbatim"], F.array(e["original"])).otherwise(good)

    return F.array_distinct(F.flatten(F.transform(kept, shown)))


def extract_urls(
    sources: DataFrame, text: str = "content", options: UrlOptions | None = None, size: str | None = None, **given
) -> DataFrame:
    """``sources``' other columns, then ``ord`` and ``url``: one row per address, in order of the text.

    ``size`` names a column with the size that the limit of the options holds
    for, where it isn't the number of characters.  Null and empty texts have no
    addresses.  Columns named like the operator's own give way to them.  Sources
    don't see each other, so rows may be dealt anyhow; large sources are single
    tasks' work, so spread them before.  :func:`source_problems` tells which
    sources met a limit.
    """
    options = options or UrlOptions(**given)
    found, rest = fresh("found"), others(sources, text, ("ord", "url"))
    rows = sources.select(*rest, candidates(named(text).cast("string"), options, named(size) if size else None).alias(found))
    at = fresh("at")
    rows = rows.select(*rest, F.posexplode(format_entries(F.col(found), options)).alias(at, "url"))
    return rows.select(*rest, F.col(at).cast("long").alias("ord"), "url")


def url_entries(sources: DataFrame, text: str = "content", options: UrlOptions | None = None, **given) -> DataFrame:
    """Candidates before cleaning: ``ord, original, placeholder, resolved, has_template`` beside the other columns."""
    options = options or UrlOptions(**given)
    rest, at, e = others(sources, text, ("ord", "original", "placeholder", "resolved", "has_template")), fresh("at"), fresh("entry")
    rows = sources.select(*rest, F.posexplode(candidates(named(text).cast("string"), options)).alias(at, e))
    return rows.select(*rest, F.col(at).cast("long").alias("ord"), f"{e}.original", f"{e}.placeholder", f"{e}.resolved", f"{e}.has_template")


def source_problems(sources: DataFrame, text: str = "content", options: UrlOptions | None = None, size: str | None = None, **given) -> DataFrame:
    """The other columns and ``problem``, a row for each limit that kept a source from being read in full.

    Problems: ``nested too deep`` and ``too ambiguous`` (parts became loose
    tokens), ``readings cut`` (``max_combinations``), ``nodes cut`` (``max_nodes``),
    ``unreadable script`` (of a page).  Sources without problems give no rows.
    """
    options = options or UrlOptions(**given)

    @F.pandas_udf("array<string>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            found = []
            for t, n in zip(texts, sizes, strict=True):
                problems: set[str] = set()
                read_source(t, n, options, problems)
                found.append(sorted(problems))
            yield pd.Series(found, dtype=object)

    body = F.coalesce(named(text).cast("string"), F.lit(""))
    sized = F.coalesce(named(size) if size else F.length(body), F.lit(0)).cast("long")
    return sources.select(*others(sources, text, ("problem",)), F.explode(read(body, sized)).alias("problem"))
