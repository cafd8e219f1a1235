"""Spans as text: ``kind:start:end`` in code points, end exclusive, comma-joined."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[str, int, int]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()

