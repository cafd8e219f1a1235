"""Bindings given from outside: a JSON file, a JSON object, or KEY=VALUE pairs."""

from __future__ import annotations

import json
import os
import re
from typing import Any


def parse_context(given: str) -> dict[str, Any]:
    """The bindings; a ``ValueError`` says what can't be read."""
    if not given or not given.strip():
        raise ValueError("the context is empty")
    if os.path.isfile(given):
        with open(given, encoding="utf-8") as f:
            given_text, where = f.read(), f"context file {given!r}"
        try:
            found = json.loads(given_text)
        except json.JSONDecodeError as e:
            raise ValueError(f"invalid JSON in {where}: {e}") from e
        return _object(found, where)
    try:
        found = json.loads(given)
    except json.JSONDecodeError:
        return _pairs(given)
    return _object(found, "context")


def _object(found: Any, where: str) -> dict[str, Any]:
    if not isinstance(found, dict):
        raise ValueError(f"{where} has to be a JSON object, not {type(found).__name__}")
    return found


def _pairs(given: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for item in filter(None, re.split(r"[,\s]+", given)):
        key, equals, value = item.partition("=")
        if not equals:
            raise ValueError(f"invalid context item {item!r}: KEY=VALUE or a JSON object is expected")
        if not key:
            raise ValueError(f"empty key in context item {item!r}")
        out[key] = value
    if not out:
        raise ValueError("the context has no items")
    return out
