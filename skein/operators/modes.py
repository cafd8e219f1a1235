"""Syntax modes over sources: nodes, tree dumps, strings, node texts, pattern queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..javascript import modes, patterns
from ..javascript.parser import parse
from ..plans.frames import fresh, named, others

NODE = (
    "struct<unit_id: int, node_id: int, parent_id: int, child_idx: int, depth: int, type: string, named: boolean,"
    " field_name: string, start_row: int, start_col: int, end_row: int, end_col: int, start: int, end: int, last_desc: int, text: string>"
)


def _per_source(sources: DataFrame, text: str, read: Callable[[str], list], kind: str, made: dict[str, str]) -> DataFrame:
    """The other columns and what ``read`` gives of each text, in its order; null texts give nothing.

    ``made`` has the operator's columns: ``ord`` and parts of what is read, or all of it for ``*``.
    Columns of the same names give way.
    """

    @F.pandas_udf(f"array<{kind}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[] if t is None else read(t) for t in texts], dtype=object)

    rest, at, one = others(sources, text, made), fresh("at"), fresh("one")
    rows = sources.select(*rest, F.posexplode(run(named(text).cast("string"))).alias(at, one))
    places = {"ord": F.col(at).cast("long"), "*": F.col(one)}
    return rows.select(*rest, *[places.get(part, F.col(f"{one}.{part}")).alias(name) for name, part in made.items()])


def _node_rows(source: str, comments: bool) -> list[dict]:
    rows: list[dict] = []
    ids: dict[int, int] = {}
    alive = []  # nodes stay referenced, so that their identities stay theirs
    for node, depth, unit, places in modes.nodes(source, comments):
        alive.append(node)
        me = ids[id(node)] = len(rows)
        parent = node.parent
        begin, end = places(node.start), places(node.end)
        rows.append(
            {
                "unit_id": unit, "node_id": me, "parent_id": ids.get(id(parent)) if parent is not None else None,
                "child_idx": 0, "depth": depth, "type": node.type, "named": node.named, "field_name": node.field,
                "start_row": begin[0], "start_col": begin[1], "end_row": end[0], "end_col": end[1],
                "start": node.start, "end": node.end, "last_desc": me, "text": node.text,
            }
        )
    counts: dict[int, int] = {}
    for row in rows:
        if row["parent_id"] is not None:
            row["child_idx"] = counts.get(row["parent_id"], 0)
            counts[row["parent_id"]] = row["child_idx"] + 1
    for row in reversed(rows):
        if row["parent_id"] is not None:
            above = rows[row["parent_id"]]
            above["last_desc"] = max(above["last_desc"], row["last_desc"])
    return rows


def js_nodes(sources: DataFrame, text: str = "content", parse_comments: bool = False) -> DataFrame:
    """The node relation: one row per syntax node, ``node_id`` in order of the text, comments as units of their own.

    ``start`` and ``end`` are code points, columns are bytes; a node's subtree is
    ``node_id`` to ``last_desc``.
    """
    parts = [part.split(":")[0].strip() for part in NODE.removeprefix("struct<").removesuffix(">").split(",")]
    return _per_source(sources, text, lambda t: _node_rows(t, parse_comments), NODE, {p: p for p in parts})


def syntax_tree(
    sources: DataFrame, text: str = "content", indent: int = 2, only_named: bool = False, include_text: bool = False, parse_comments: bool = False
) -> DataFrame:
    """``ord, line``: the dump of each source's tree."""
    if indent < 0:
        raise ValueError("indent cannot be negative")
    return _per_source(sources, text, lambda t: modes.tree(t, indent, only_named, include_text, parse_comments), "string", {"ord": "ord", "line": "*"})


def js_strings(
    sources: DataFrame, text: str = "content", least: int | None = None, most: int | None = None, include_error: bool = False
) -> DataFrame:
    """``ord, text``: string and template literals without quotes, each once."""
    if (least is not None and least < 1) or (most is not None and most < 1) or (least is not None and most is not None and least >= most):
        raise ValueError("lengths have to be positive, the least below the most")
    return _per_source(sources, text, lambda t: modes.strings(t, least, most, include_error), "string", {"ord": "ord", "text": "*"})


def js_inspect(sources: DataFrame, text: str = "content", types: list[str] | None = None) -> DataFrame:
    """``ord, text``: texts of nodes, of the given types if any."""
    return _per_source(sources, text, lambda t: modes.inspect(t, types), "string", {"ord": "ord", "text": "*"})


def js_query(sources: DataFrame, query: str, text: str = "content", unique: bool = False, trim: bool = False) -> DataFrame:
    """``ord, capture, text`` of the pattern's captures.  A pattern that can't be read is an error at once."""
    compiled = patterns.Query(query)

    def read(source: str) -> list[dict]:
        return [{"capture": c, "text": t} for c, t in patterns.run(parse(source), compiled, unique, trim)]

    return _per_source(sources, text, read, "struct<capture: string, text: string>", {"ord": "ord", "capture": "capture", "text": "text"})


def node_types(spark) -> DataFrame:
    """The catalogue of node types."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(fixed.NODE_TYPES)], "ord int, type string")
