"""A pattern language over syntax trees: S-expressions with captures.

``(type field: (type) @name)``, wildcards ``_`` and ``(_)``, quoted tokens,
alternatives ``[...]``, groups, quantifiers ``? * +``, anchors ``.``, negated
fields ``!field``, and the predicates ``#eq? #not-eq? #match? #not-match?
#any-of? #not-any-of?``.  Types are checked when a pattern is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
import dataclasses

from ..functions.fixed import MORE_NODE_TYPES, NODE_TYPES
from .nodes import Node

_TOKEN = re.compile(r'\s*(?:;[^\n]*\n\s*)*("(?:[^"\\]|\\.)*"|[()\[\]!.]|@[\w.-]+|#[\w?!-]+|[\w-]+:|[\w-]+|[*+?])')
_KNOWN = frozenset(NODE_TYPES) | frozenset(MORE_NODE_TYPES) | {"MISSING"}


class PatternError(ValueError):
    """The pattern can't be read, or names an unknown type."""


@dataclasses.dataclass
class Pattern:
    kind: str = "node"  # node, any, token, choice, group
    type: str | None = None
    field: str | None = None
    captures: list[str] = dataclasses.field(default_factory=list)
    items: list[Pattern] = dataclasses.field(default_factory=list)
    absent: list[str] = dataclasses.field(default_factory=list)
    quantifier: str = ""
    anchored: bool = False
    anchored_end: bool = False
    tests: list[tuple[str, list[tuple[bool, str]]]] = dataclasses.field(default_factory=list)


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = re.sub(r";[^\n]*\Z", "", text.rstrip())
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PatternError(f"unexpected character at {at}")
        out.append(m[1])
        at = m.end()
        if not text[at:].strip():
            break
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise PatternError("the pattern ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def all(self) -> list[Pattern]:
        out: list[Pattern] = []
        while self.peek() is not None:
            if self.peek() == "(" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].startswith("#"):
                if not out:
                    raise PatternError("a predicate before any pattern")
                self.take()
                out[-1].tests.append(self.test())
            else:
                out.append(self.one())
        if not out:
            raise PatternError("the pattern is empty")
        return out

    def test(self) -> tuple[str, list[tuple[bool, str]]]:
        name, given = self.take(), []
        while (t := self.take()) != ")":
            given.append((t[0] == "@", t[1:] if t[0] == "@" else _unquoted(t)))
        if name not in ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?", "#not-any-of?") or not given or not given[0][0]:
            raise PatternError(f"predicate {name} can't be read")
        return name, given

    def one(self) -> Pattern:
        t = self.take()
        if t == "[":
            made = Pattern("choice")
            while self.peek() != "]":
                made.items.append(self.one())
            self.take()
        elif t == "(":
            made = self._inside()
        elif t == "_":
            made = Pattern("any", type="*")
        elif t[0] == '"':
            made = Pattern("token", type=_unquoted(t))
        else:
            raise PatternError(f"unexpected {t}")
        if self.peek() in ("*", "+", "?"):
            made.quantifier = self.take()
        while (self.peek() or "").startswith("@"):
            made.captures.append(self.take()[1:])
        return made

    def _inside(self) -> Pattern:
        t = self.peek()
        if t is None:
            raise PatternError("the pattern ends too soon")
        if t[0] in "([" or t[0] == '"':
            made = Pattern("group")
        else:
            name = self.take()
            if name == "_":
                made = Pattern("any", type="named")
            elif name in _KNOWN:
                made = Pattern("node", type=name)
            else:
                raise PatternError(f"unknown node type {name}")
        anchored = False
        while (t := self.peek()) != ")":
            if t is None:
                raise PatternError("the pattern ends too soon")
            if t == ".":
                self.take()
                anchored = True
            elif t == "!":
                self.take()
                made.absent.append(self.take())
            elif t == "(" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].startswith("#"):
                self.take()
                made.tests.append(self.test())
            else:
                name = self.take()[:-1] if t.endswith(":") and t[0] != '"' else None
                child = self.one()
                child.field, child.anchored = name, anchored
                anchored = False
                made.items.append(child)
        made.anchored_end = anchored
        self.take()
        return made


def _unquoted(t: str) -> str:
    if t[0] != '"':
        return t
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), t[1:-1])


Captures = tuple[tuple[str, Node], ...]


def _node(p: Pattern, node: Node) -> Iterator[Captures]:
    if p.field is not None and node.field != p.field:
        return
    if p.kind == "choice":
        for item in p.items:
            for got in _node(item, node):
                yield tuple((c, node) for c in p.captures) + got
        return
    if p.kind == "token":
        fits = not node.named and node.type == p.type
    elif p.kind == "any":
        fits = p.type == "*" or node.named
    else:
        fits = p.kind == "node" and node.type == p.type and node.named
    if not fits or any(node.get(f) is not None for f in p.absent):
        return
    mine = tuple((c, node) for c in p.captures)
    for got in _children(p.items, node.children, 0, 0, p.anchored_end):
        found = mine + got
        if _holds(p.tests, found):
            yield found


def _children(items: list[Pattern], children: list[Node], i: int, at: int, end: bool) -> Iterator[Captures]:
    """Ways to lay the patterns from ``i`` on over the children from ``at`` on, in order."""
    if i == len(items):
        if not end or not any(c.named for c in children[at:]):
            yield ()
        return
    p = items[i]
    if p.quantifier in ("*", "?"):
        matched = False
        for got in _some(p, items, children, i, at, end):
            matched = True
            yield got
        if not matched:
            yield from _children(items, children, i + 1, at, end)
        return
    yield from _some(p, items, children, i, at, end)


def _some(p: Pattern, items: list[Pattern], children: list[Node], i: int, at: int, end: bool) -> Iterator[Captures]:
    for k in range(at, len(children)):
        if p.anchored and any(c.named for c in children[at:k]):
            return
        if p.kind == "group":
            flat = list(p.items)
            for got in _children(flat, children, 0, k, False):
                last = max((children.index(n) for _, n in got if n in children), default=k)
                for rest in _children(items, children, i + 1, last + 1, end):
                    yield got + rest
            continue
        for got in _node(p, children[k]):
            if p.quantifier in ("*", "+"):
                stop, run = k + 1, got
                while stop < len(children):
                    more = next(_node(p, children[stop]), None)
                    if more is None and children[stop].named:
                        break
                    run += more or ()
                    stop += 1
                for rest in _children(items, children, i + 1, stop, end):
                    yield run + rest
                return
            for rest in _children(items, children, i + 1, k + 1, end):
                yield got + rest


def _holds(tests: list[tuple[str, list[tuple[bool, str]]]], found: Captures) -> bool:
    for name, given in tests:
        nodes = [n.text for c, n in found if c == given[0][1]]
        others = [next((n.text for c, n in found if c == v), None) if is_capture else v for is_capture, v in given[1:]]
        if "match" in name:
            good = all(re.search(others[0], t) for t in nodes)
        else:
            good = all(t in others for t in nodes)
        if nodes and good == name.startswith("#not-"):
            return False
    return True


class Query:
    """A compiled pattern text."""

    def __init__(self, text: str):
        if not text.strip():
            raise PatternError("the pattern is empty")
        self.patterns = _Reader(text).all()

    def matches(self, root: Node) -> Iterator[Captures]:
        for node, _ in root.walk():
            for p in self.patterns:
                if p.kind == "group":
                    for got in _children(p.items, node.children, 0, 0, False):
                        if _holds(p.tests, got):
                            yield got
                else:
                    for got in _node(p, node):
                        if _holds(p.tests, got):
                            yield got

    def captures(self, root: Node) -> list[tuple[str, Node]]:
        """Captured nodes by capture, captures as they first come up, nodes by place, each once."""
        found: dict[str, dict[int, Node]] = {}
        for match in self.matches(root):
            for name, node in match:
                found.setdefault(name, {}).setdefault(id(node), node)
        return [(name, n) for name, held in found.items() for n in sorted(held.values(), key=lambda n: (n.start, -n.end))]


def run(source_root: Node, query: Query, unique: bool = False, trim: bool = False) -> list[tuple[str, str]]:
    """``capture, text`` of what is captured; ``trim`` takes off quotes, blanks and line ends, ``unique`` repeats."""
    out, seen = [], set()
    for name, node in query.captures(source_root):
        text = node.text.strip("'\"\n ") if trim else node.text
        if not (unique and text in seen):
            out.append((name, text))
        seen.add(text)
    return out
