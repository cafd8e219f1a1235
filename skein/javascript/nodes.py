"""Syntax tree nodes."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A stretch of the source with a type; ``named`` tells constructs from punctuation and keywords."""

    __slots__ = ("type", "start", "end", "children", "named", "field", "parent", "source")

    def __init__(self, type_: str, start: int, end: int, source: str, named: bool = True):
        self.type, self.start, self.end, self.source, self.named = type_, start, end, source, named
        self.children: list[Node] = []
        self.field: str | None = None
        self.parent: Node | None = None

    @property
    def text(self) -> str:
        return self.source[self.start : self.end]

    @property
    def named_children(self) -> list[Node]:
        return [c for c in self.children if c.named]

    def get(self, field: str) -> Node | None:
        for c in self.children:
            if c.field == field:
                return c
        return None

    def add(self, child: Node | None, field: str | None = None) -> Node:
        if child is not None:
            child.field = field
            child.parent = self
            self.children.append(child)
            self.end = max(self.end, child.end)
        return self

    def walk(self, named_only: bool = False) -> Iterator[tuple[Node, int]]:
        """Nodes with their depth, in order of the text, parents first; no recursion."""
        stack = [(self, 0)]
        while stack:
            node, depth = stack.pop()
            yield node, depth
            below = node.named_children if named_only else node.children
            stack.extend((c, depth + 1) for c in reversed(below))

    def base_identifier(self) -> str | None:
        """Of a.b.c the name a."""
        node = self
        while node is not None and node.type == "member_expression":
            node = node.get("object")
        return node.text if node is not None and node is not self and node.type == "identifier" else None
