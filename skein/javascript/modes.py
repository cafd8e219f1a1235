"""Readings of one tree: its dump, its strings, its nodes' texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .comments import bare
from .nodes import Node
from .parser import parse

STRINGS = frozenset(("string", "template_string", "string_fragment"))


class Places:
    """Rows and byte columns of places in a text."""

    def __init__(self, source: str):
        self.source = source
        self.lines = [0]
        at = source.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = source.find("\n", at + 1)
        self.ascii = source.isascii()

    def __call__(self, at: int) -> tuple[int, int]:
        low, high = 0, len(self.lines)
        while high - low > 1:
            mid = (low + high) // 2
            if self.lines[mid] <= at:
                low = mid
            else:
                high = mid
        begun = self.lines[low]
        return low, at - begun if self.ascii else len(self.source[begun:at].encode())


def nodes(source: str, comments: bool = False) -> Iterator[tuple[Node, int, int, Places]]:
    """Nodes in order with depth and unit; units are the text, 0, and comments read as programs of their own."""
    units = 0
    stack: list[tuple[Node, int, int, Places]] = [(parse(source), 0, 0, Places(source))]
    while stack:
        node, depth, unit, places = stack.pop()
        yield node, depth, unit, places
        stack.extend((c, depth + 1, unit, places) for c in reversed(node.children))
        if comments and node.type == "comment":
            text, gone = bare(node.text)
            if text is not None and gone:
                units += 1
                stack.append((parse(text), depth, units, Places(text)))


def tree(source: str, indent: int = 2, only_named: bool = False, include_text: bool = False, parse_comments: bool = False) -> list[str]:
    """A line per node: field, type, begin and end, and the text as bytes if asked for."""
    out = []
    for node, depth, _, places in nodes(source, parse_comments):
        if only_named and not node.named:
            continue
        begin, end = places(node.start), places(node.end)
        line = f"{' ' * (indent * depth)}{node.field + ': ' if node.field else ''}{node.type} {begin} - {end}"
        out.append(line + (f" => {node.text.encode()!r}" if include_text else ""))
    return out


def _texts(source: str, wanted: Callable[[Node], bool], fits: Callable[[str], bool]) -> list[str]:
    """Texts without quotes of the wanted nodes, each once; below a node whose text is known nothing is read.

    Comments are read as programs of their own.
    """
    found: dict[str, None] = {}
    stack = [parse(source)]
    while stack:
        node = stack.pop()
        if wanted(node):
            text = node.text.strip("'\"")
            if text in found:
                continue
            if fits(text):
                found[text] = None
        stack.extend(reversed(node.named_children))
        if node.type == "comment":
            text, gone = bare(node.text)
            if text is not None and gone:
                stack.append(parse(text))
    return list(found)


def strings(source: str, least: int | None = None, most: int | None = None, include_error: bool = False) -> list[str]:
    kinds = STRINGS | {"ERROR"} if include_error else STRINGS
    return _texts(source, lambda n: n.type in kinds, lambda t: (least is None or len(t) >= least) and (most is None or len(t) <= most))


def inspect(source: str, types: list[str] | None = None) -> list[str]:
    kinds = frozenset(types or ())
    return _texts(source, lambda n: not kinds or n.type in kinds, lambda t: True)
