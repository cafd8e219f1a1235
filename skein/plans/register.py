"""The operators by SQL names."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed, rules
from ..javascript import aliases, markup, modes, patterns
from ..javascript.comments import bare
from ..javascript.parser import parse
from ..operators.modes import _node_rows
from ..operators.urls import read_source
from .options import UrlOptions, extension_set

#: :func:`skein.functions.columns.clean` in SQL, whose lambdas have no text form.
CLEAN = r"""regexp_replace(if(@cut >= 0, substring(text, 1, @cut), text), '[.,]+$', '')"""
CUT = r"""if(text rlike '[)\\]}]', aggregate(split(text, ''), named_struct('open', '', 'at', 0, 'cut', -1), (s, c) -> named_struct(
    'open', CASE WHEN c IN ('(', '[', '{') THEN concat(s.open, c) WHEN c IN (')', ']', '}') THEN substring(s.open, 1, length(s.open) - 1) ELSE s.open END,
    'at', s.at + 1,
    'cut', if(s.cut < 0 AND c IN (')', ']', '}') AND translate(right(s.open, 1), '([{', ')]}') <> c, s.at, s.cut)), s -> s.cut), -1)"""

_NODE_SCHEMA = (
    "unit_id int, node_id int, parent_id int, child_idx int, depth int, type string, named boolean, field_name string,"
    " start_row int, start_col int, end_row int, end_col int, start int, end int, last_desc int, text string"
)


@functools.lru_cache(maxsize=64)
def _options(given: str) -> UrlOptions:
    return UrlOptions(**json.loads(given or "{}"))


@functools.lru_cache(maxsize=64)
def _compiled(pattern: str) -> patterns.Query:
    return patterns.Query(pattern)


def urls(source: str, options: UrlOptions) -> Iterator[str]:
    """Addresses of one source as :func:`skein.operators.urls.extract_urls` gives them."""
    extra, mark = extension_set(options.extensions), options.placeholder
    seen: dict[str, None] = {}
    for original, placeholder, resolved, template, verbatim in read_source(source, len(source), options):
        if placeholder == mark and not resolved:
            continue
        shape = rules.clean(placeholder)
        if verbatim:
            seen[original] = None
            continue
        if options.include_templates:
            texts = [rules.clean(original), shape] if template else [shape]
        elif not template:
            texts = [rules.clean(original if resolved is None else resolved)]
        else:
            texts = [] if "{" in shape else [shape]
        seen.update((t, None) for t in texts if not rules.is_junk(t, mark, extra))
    return iter(seen)


def _sql(spark: SparkSession, made: Callable[[Column], Column]) -> str:
    """A column expression over ``text`` as SQL text."""
    plan = spark.createDataFrame([], "text string").select(made(F.col("text")).alias("x"))._jdf.queryExecution().analyzed()
    return plan.expressions().apply(0).child().sql()


def register(spark: SparkSession) -> None:
    """Register scalar functions and table functions in the session.

    Scalar: ``is_url, is_path, is_filename, is_html, is_junk_url, clean_url,
    route_template`` are SQL expressions that Catalyst sees through;
    ``js_unescape, bare_comment, alias_score`` run in Python.  Table, for use with
    LATERAL: ``js_urls(source, options)`` with the options of
    :class:`~skein.plans.options.UrlOptions` as a JSON object, ``js_entries``
    (candidates before cleaning, same options), ``js_strings(source, least,
    most)``, ``js_inspect(source, types)``, ``js_query(source, pattern, unique,
    trim)``, ``js_tree(source, only_named, include_text, parse_comments)``,
    ``js_nodes(source, parse_comments)``, ``html_pieces(html)`` and
    ``html_attrs(html)``.  Arguments after the first may be left out, but for the pattern.
    """
    for name, kind, made in (
        ("is_url", "BOOLEAN", C.is_url), ("is_path", "BOOLEAN", C.is_path), ("is_filename", "BOOLEAN", C.is_filename),
        ("is_html", "BOOLEAN", C.is_html), ("is_junk_url", "BOOLEAN", C.is_junk), ("route_template", "STRING", C.route_template),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN {_sql(spark, made)}")
    clean = CLEAN.replace("@cut", f"({CUT})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_url(text STRING) RETURNS STRING RETURN {clean}")

    def scalar(name: str, kind: str, fn: Callable) -> None:
        @F.pandas_udf(kind)
        def one(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else fn(t) for t in texts], dtype=object)

        spark.udf.register(name, one)

    scalar("js_unescape", "string", rules.unescape)
    scalar("bare_comment", "string", lambda t: bare(t)[0])
    scalar("alias_score", "int", aliases.score)

    @F.udtf(returnType="ord int, url string")
    class Urls:
        def eval(self, source: str, options: str = "") -> Iterator[tuple]:
            yield from enumerate(urls(source, _options(options)) if source else ())

    @F.udtf(returnType="ord int, original string, placeholder string, resolved string, has_template boolean")
    class Entries:
        def eval(self, source: str, options: str = "") -> Iterator[tuple]:
            for i, entry in enumerate(read_source(source, len(source), _options(options)) if source else ()):
                yield (i, *entry[:4])

    @F.udtf(returnType="ord int, text string")
    class Strings:
        def eval(self, source: str, least: int = None, most: int = None) -> Iterator[tuple]:
            yield from enumerate(modes.strings(source, least, most) if source else ())

    @F.udtf(returnType="ord int, text string")
    class Inspect:
        def eval(self, source: str, types: str = "") -> Iterator[tuple]:
            yield from enumerate(modes.inspect(source, types.split(",") if "," in types else types.split()) if source else ())

    @F.udtf(returnType="ord int, line string")
    class Tree:
        def eval(self, source: str, only_named: bool = False, include_text: bool = False, parse_comments: bool = False) -> Iterator[tuple]:
            yield from enumerate(modes.tree(source, 2, only_named, include_text, parse_comments) if source is not None else ())

    @F.udtf(returnType="ord int, capture string, text string")
    class Query:
        def eval(self, source: str, query: str, unique: bool = False, trim: bool = False) -> Iterator[tuple]:
            if source is not None:
                for i, row in enumerate(patterns.run(parse(source), _compiled(query), unique, trim)):
                    yield (i, *row)

    @F.udtf(returnType=_NODE_SCHEMA)
    class Nodes:
        def eval(self, source: str, parse_comments: bool = False) -> Iterator[tuple]:
            for row in _node_rows(source, parse_comments) if source is not None else ():
                yield tuple(row.values())

    @F.udtf(returnType="ord int, kind string, tag string, name string, value string")
    class Html:
        def eval(self, html: str) -> Iterator[tuple]:
            for i, p in enumerate(markup.read(html) if html else ()):
                yield (i, p.kind, p.tag, p.name, p.value)

    @F.udtf(returnType="ord int, tag string, name string, value string")
    class Attributes:
        def eval(self, html: str) -> Iterator[tuple]:
            known = {*fixed.TAG_ATTRIBUTES}
            for i, p in enumerate(markup.read(html) if html else ()):
                if p.kind == "attribute" and ((p.tag, p.name) in known or p.name in fixed.DATA_ATTRIBUTES):
                    yield (i, p.tag, p.name, p.value)

    tables = {
        "js_urls": Urls, "js_entries": Entries, "js_strings": Strings, "js_inspect": Inspect, "js_tree": Tree, "js_query": Query,
        "js_nodes": Nodes, "html_pieces": Html, "html_attrs": Attributes,
    }
    for name, table in tables.items():
        spark.udtf.register(name, table)
