"""First pass: what names stand for.  Names are flat, without scopes, and see only what comes before."""

from __future__ import annotations

from itertools import product
from typing import Any

from ..functions.rules import unescape
from .nodes import Node

#: What location's members are taken for; ``{}`` is the placeholder.
LOCATION = {
    "protocol": "https:", "hostname": "{}", "host": "{}", "origin": "https://{}", "pathname": "/{}", "port": "", "search": "", "hash": "",
}

#: Problems: more readings of an expression, or nodes in a text, than the options allow.
READINGS, NODES = "readings cut", "nodes cut"


def string_value(node: Node | None) -> str | None:
    return unescape(node.text[1:-1]) if node is not None and node.type == "string" else None


def method_of(node: Node) -> str | None:
    """The method's name if the node is a call of one."""
    called = node.get("function") if node.type == "call_expression" else None
    name = called.get("property") if called is not None and called.type == "member_expression" else None
    return name.text if name is not None else None


def receiver(node: Node) -> Node | None:
    return node.get("function").get("object")


def call_arguments(node: Node) -> list[Node]:
    given = node.get("arguments")
    return given.named_children if given is not None and given.type == "arguments" else []


def dotted(node: Node) -> list[str]:
    names: list[str] = []
    while node is not None and node.type == "member_expression":
        names.append(node.get("property").text)
        node = node.get("object")
    if node is not None:
        names.append(node.text)
    return names[::-1]


class Bindings:
    """Values by name: of variables (all that were assigned, in order), of objects, of arrays."""

    def __init__(self, placeholder: str, context: dict[str, Any] | None = None, policy: str = "merge", most: int | None = None):
        self.placeholder, self.most = placeholder, most
        self.problems: set[str] = set()
        self.context, self.policy = context or {}, policy
        self.names: dict[str, list[str]] = {}
        self.objects: dict[str, Any] = {}
        self.arrays: dict[str, list[str]] = {}
        for name, value in self.context.items():
            if isinstance(value, dict):
                self.objects[name] = _leaves(value)
            elif isinstance(value, list):
                self.arrays[name] = [str(v) for v in value]
            else:
                self.names[name] = [str(value)]

    # -- reading ----------------------------------------------------------------

    def member(self, node: Node) -> list[str]:
        path = dotted(node)
        full = ".".join(path)
        if full in self.names:
            return self.names[full]
        at = 1 if path[:2] == ["window", "location"] else 0 if path[0] == "location" else None
        if at is not None and len(path) > at + 1 and path[at + 1] in LOCATION:
            return [LOCATION[path[at + 1]].replace("{}", self.placeholder)]
        found: Any = self.objects
        for name in path:
            found = found.get(name) if isinstance(found, dict) else None
        return found if isinstance(found, list) else [self.placeholder]

    def subscript(self, node: Node) -> list[str]:
        index, held = node.get("index"), self.objects.get(node.get("object").text)
        keys: list[str] = []
        if (text := string_value(index)) is not None:
            keys = [text] if text else []
        elif index is not None and index.type == "identifier":
            keys = self.names.get(index.text, [])
        found: list[str] = []
        for key in keys:
            value = held.get(key) if isinstance(held, dict) else None
            found += value if isinstance(value, list) else []
        return found or [self.placeholder]

    def join(self, node: Node) -> list[str]:
        name = receiver(node).text
        if name not in self.arrays:
            return [self.placeholder]
        given = call_arguments(node)
        return [(string_value(given[0]) or "" if given else "").join(self.arrays[name])]

    def replace(self, node: Node) -> list[str]:
        """All replaced, not the first only, as whatever the search stands for is filled."""
        given, base = call_arguments(node), self._plain(receiver(node))
        search = string_value(given[0]) if len(given) > 1 else None
        if not base or not search:
            return [self.placeholder]
        news = self._plain(given[1]) or [self.placeholder]
        return [old.replace(search, new) for old, new in self._pairs(base, news)]

    def _plain(self, node: Node | None) -> list[str]:
        """Of a literal or a variable."""
        if node is None:
            return []
        if node.type == "identifier":
            return self.names.get(node.text, [])
        return [text] if (text := string_value(node)) else []

    def _pairs(self, left: list[str], right: list[str]) -> list[tuple[str, str]]:
        if self.most is not None and len(left) * len(right) > self.most:
            self.problems.add(READINGS)
            left = left[: max(1, self.most // len(right))]
        return list(product(left, right))[: self.most]

    def operand(self, node: Node) -> list[str]:
        """Of one side of +; the placeholder if nothing is known."""
        if (text := string_value(node)) is not None:
            return [text]
        if node.type == "identifier":
            found = self.names.get(node.text)
        elif node.type == "member_expression":
            found = self.member(node)
        elif node.type == "subscript_expression":
            found = self.subscript(node)
        elif (method := method_of(node)) in ("join", "replace"):
            found = self.join(node) if method == "join" else self.replace(node)
        else:
            found = None
        return found or [self.placeholder]

    def binary(self, node: Node) -> list[str] | None:
        """Combinations along a chain of +; of || and && the right side."""
        operator = node.get("operator").text
        if operator in ("||", "&&"):
            right = node.get("right")
            if right.type == "identifier":
                return self.names.get(right.text, [self.placeholder])
            if right.type == "member_expression":
                return self.member(right)
            return [self.placeholder if (text := string_value(right)) is None else text]
        if operator != "+":
            return None
        sides: list[list[str]] = []
        while True:  # down the left side without recursion
            right = node.get("right")
            sides.append((self.binary(right) or [self.placeholder]) if right.type == "binary_expression" else self.operand(right))
            left = node.get("left")
            if left.type == "binary_expression" and left.get("operator").text == "+":
                node = left
                continue
            sides.append((self.binary(left) or [self.placeholder]) if left.type == "binary_expression" else self.operand(left))
            break
        values = sides.pop()
        while sides:
            values = [a + b for a, b in self._pairs(values, sides.pop())]
        return values

    # -- writing ------------------------------------------------------------------

    def collect(self, root: Node, limit: int) -> None:
        """Go through the tree in order; after ``limit`` nodes the rest stays unread."""
        for seen, (node, _) in enumerate(root.walk(named_only=True)):
            if seen > limit:
                self.problems.add(NODES)
                break
            if node.type == "variable_declarator":
                self._assign(node.get("name"), node.get("value"))
            elif node.type == "assignment_expression":
                left, right = node.get("left"), node.get("right")
                if left.type == "identifier":
                    self._assign(left, right)
                elif left.type == "member_expression":
                    self._assign_member(left, right)

    def _from_file(self, name: str) -> bool:
        return self.policy == "merge" or (self.policy == "override" and name not in self.context)

    def _assign(self, target: Node | None, value: Node | None) -> None:
        if target is None or value is None or not self._from_file(target.text):
            return
        name = target.text
        known = self.names.setdefault(name, [])
        if value.type == "array":
            self.arrays[name] = self._elements(value)
        elif value.type == "object":
            self._fill(self.objects.setdefault(name, {}), value)
        else:
            found: list[str] = []
            if value.type == "identifier":
                found = self.names.get(value.text, [])
            elif value.type == "binary_expression":
                found = self.binary(value) or []
            elif value.type in ("string", "member_expression", "subscript_expression") or method_of(value) in ("join", "replace"):
                found = self.operand(value)
            known.extend(v for v in dict.fromkeys(found) if v and v not in known)

    def _elements(self, array: Node) -> list[str]:
        out: list[str] = []
        for child in array.named_children:
            if child.type == "comment":
                continue
            if child.type == "binary_expression":
                out += self.binary(child) or [self.placeholder]
            elif child.type in ("identifier", "member_expression"):
                out += self.operand(child)
            elif (text := string_value(child)) is not None:
                out += [text] if text else []
            else:
                out.append(self.placeholder)
        return out

    def _property(self, value: Node) -> list[str]:
        """A list that is a variable's own stays shared with it, and grows with it."""
        if value.type == "identifier":
            return self.names.get(value.text, [self.placeholder])
        if value.type == "binary_expression":
            return self.binary(value) or []
        if value.type == "member_expression":
            return self.member(value)
        return [text] if (text := string_value(value)) else []

    def _fill(self, held: dict[str, Any], literal: Node) -> None:
        """Entries of an object literal; a nested one's entries are the outer object's too."""
        for pair in literal.named_children:
            key, value = pair.get("key"), pair.get("value")
            if pair.type != "pair" or key is None or value is None:
                continue
            name = key.text[1:-1] if key.type == "string" else key.text
            if value.type == "object":
                self._fill(held, value)
                held.setdefault(name, {})
            elif found := self._property(value):
                held[name] = found

    def _assign_member(self, target: Node, value: Node) -> None:
        found, path = self._property(value), dotted(target)
        if not found or len(path) < 2:
            return
        held = self.objects
        for name in path[:-1]:
            below = held.get(name)
            if not isinstance(below, dict):
                below = held[name] = {}
            held = below
        known = held.setdefault(path[-1], [])
        if isinstance(known, list):
            known.extend(v for v in list(found) if v not in known)


def _leaves(value: dict[str, Any]) -> dict[str, Any]:
    """A context object with single values as lists of one."""
    out: dict[str, Any] = {}
    for name, below in value.items():
        if isinstance(below, dict):
            out[name] = _leaves(below)
        else:
            out[name] = [str(v) for v in below] if isinstance(below, list) else [str(below)]
    return out
