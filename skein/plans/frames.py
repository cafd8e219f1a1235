"""Columns of the caller's tables, whatever their names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, text: str, made: Iterable[str] = ()) -> list[Column]:
    """The columns beside the text's, less those whose names the operator gives to its own."""
    gone = {text, *(m for m in made)}
    gone = {x.lower() for x in gone}
    return [named(c) for c in df.columns if c.lower() not in gone]


def fresh(stem: str) -> str:
    """A column name that no table has."""
    return f"_{stem}_{uuid.uuid4().hex}"
