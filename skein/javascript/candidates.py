"""Second pass: expressions that make addresses, as entries in order of the text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice, product
from typing import Any, NamedTuple

from ..functions import rules
from . import markup
from .aliases import nearby
from .bindings import NODES, READINGS, Bindings, call_arguments, method_of, receiver, string_value
from .nodes import Node
from .parser import parse


class Entry(NamedTuple):
    original: str
    placeholder: str
    resolved: str | None
    has_template: bool


class Options(NamedTuple):
    """How one source is read; the defaults of the command line."""

    placeholder: str = "FUZZ"
    max_nodes: int = 1_000_000
    skip_symbols: bool = False
    skip_aliases: bool = False
    context: dict[str, Any] | None = None
    policy: str = "merge"
    extensions: frozenset[str] = frozenset()
    max_combinations: int | None = None


class Part(NamedTuple):
    """A piece of a concatenation: as shown in a template, its value, and whether it is a literal."""

    shown: str
    value: str
    literal: bool = False
    resolved: str | None = None


def plain(text: str) -> Entry:
    return Entry(text, text, text, False)


class Collector:
    def __init__(self, options: Options, bindings: Bindings):
        self.options, self.bindings = options, bindings
        self.placeholder = options.placeholder
        self.entries: dict[tuple[str, str, str], Entry] = {}
        self.problems: set[str] = set()

    # -- traversal ----------------------------------------------------------------

    def run(self, root: Node, budget: list[int]) -> None:
        """Go through the tree in order; ``budget`` holds the nodes still to be read."""
        for node, _ in root.walk(named_only=True):
            if budget[0] < 0:
                return
            budget[0] -= 1
            for entry in self._of(node, budget):
                self.entries.setdefault((entry.original, entry.placeholder, entry.resolved or ""), entry)

    def _of(self, node: Node, budget: list[int]) -> Iterator[Entry]:
        kind = node.type
        if kind == "string":
            text = string_value(node)
            if text:
                yield from self._literal(text, budget)
        elif kind == "template_string":
            yield from self._template(node, budget)
        elif kind == "binary_expression":
            if node.get("operator").text == "+":
                yield from self._concatenation(node, list(self._plus(node)))
            else:
                yield from self._concatenation(node, [self._unknown(node)])
        elif kind == "call_expression":
            method = method_of(node)
            if method == "concat":
                yield from self._finish(list(self._chain(node)))
            elif method in ("join", "replace"):
                value = (self.bindings.join(node) if method == "join" else self.bindings.replace(node))[0]
                if self._address(value):
                    yield Entry(f"{{{node.text}}}", value, value, True)
        elif kind in ("comment", "hash_bang_line"):
            self._comment(node)

    def _address(self, *texts: str) -> bool:
        return any(rules.is_url(t) or rules.is_path(t, self.options.extensions) for t in texts)

    def _comment(self, node: Node) -> None:
        text = node.text
        if text.startswith(("//", "#!")):
            text = text[2:]
        elif text.startswith("/*") and text.endswith("*/"):
            text = text[2:-2]
        text = text.strip()
        if not text:
            return
        for found in (*rules.embedded_urls(text), *rules.comment_paths(text)):
            if self._address(found.strip()):
                entry = plain(found.strip())
                self.entries.setdefault((entry.original, entry.placeholder, entry.resolved or ""), entry)
        self.run(parse(text, self.problems), [self.options.max_nodes])

    # -- literals -------------------------------------------------------------------

    def _html(self, text: str, budget: list[int]) -> list[Entry]:
        """Addresses of HTML in a string; its scripts are read at once, before them."""
        if "<" not in text or ">" not in text:
            return []
        pieces = markup.read(text)
        for code in markup.scripts(pieces):
            self.run(parse(code, self.problems), budget)
        return [plain(a) for a in markup.addresses(pieces, self.options.extensions)]

    def _message(self, text: str) -> list[Entry] | None:
        found = rules.message_urls(text, self.placeholder)
        return None if found is None else [Entry(u, u, u, self.placeholder in u) for u in found]

    def _literal(self, text: str, budget: list[int]) -> list[Entry]:
        found = self._message(text)
        if found is not None:
            return found
        if html := self._html(text, budget):
            return html
        if self._address(text):
            shown, routed = rules.route_template(text)
            if not routed:
                return [plain(text)]
            filled = re.sub(r"\{[^}]+\}", lambda _: self.placeholder, shown)
            return [Entry(shown, filled, filled, True)]
        return [plain(u) for u in rules.embedded_urls(text)]

    def _names(self, node: Node, expressions: list[Node]) -> dict[str, str]:
        if self.options.skip_aliases:
            return {}
        wanted = {e.text if e.type == "identifier" else e.base_identifier() for e in expressions if e.type in ("identifier", "member_expression")}
        return nearby(node, wanted - {None})

    @staticmethod
    def _shown(node: Node, names: dict[str, str]) -> str:
        """The expression's text with the variable by its better name."""
        if node.type == "identifier":
            return names.get(node.text, node.text)
        base = node.base_identifier() if node.type == "member_expression" else None
        return node.text.replace(base, names[base], 1) if base in names else node.text

    def _template(self, node: Node, budget: list[int]) -> list[Entry]:
        holes = [c.named_children[0] for c in node.named_children if c.type == "template_substitution" and c.named_children]
        names = self._names(node, holes)
        shown: list[str] = []
        values: list[list[str]] = []
        for child in node.named_children:
            if child.type == "string_fragment":
                text = rules.route_template(rules.unescape(child.text))[0]
            elif child.type == "escape_sequence":
                text = rules.unescape(child.text)
            elif child.type == "template_substitution" and child.named_children:
                hole = child.named_children[0]
                shown.append(f"{{{self._shown(hole, names)}}}")
                known = self.bindings.names.get(hole.text) if hole.type == "identifier" else self.bindings.member(hole) if hole.type == "member_expression" else None
                values.append(known or [self.placeholder])
                continue
            else:
                continue
            shown.append(text)
            values.append([text])
        original = "".join(shown)
        if not holes:
            if html := self._html(original, budget):
                return html
            return [plain(original)] if self._address(original) else []
        out: list[Entry] = []
        good = self._address(original)
        most = self.options.max_combinations
        if most is not None and math.prod(map(len, values)) > most:
            self.problems.add(READINGS)
        for combination in islice(product(*values), most):
            resolved = "".join(combination)
            message = self._message(resolved)
            if message is not None:
                out += message
            elif good or self._address(resolved):
                name = rules.route_template(original)[0]
                filled = rules.fill(rules.route_template(resolved)[0], self.placeholder)
                out.append(Entry(name, filled, filled if filled != name else None, True))
        return out

    # -- concatenations ---------------------------------------------------------------

    def _unknown(self, node: Node) -> Part:
        return Part(f"{{{node.text}}}", self.placeholder)

    def _plus(self, node: Node) -> Iterator[Node]:
        """Operands of a chain of +, from left to right; the chain may be long."""
        stack = [node]
        while stack:
            one = stack.pop()
            if one.type == "binary_expression" and one.get("operator").text == "+":
                stack += [one.get("right"), one.get("left")]
            else:
                yield one

    def _concatenation(self, node: Node, operands: list[Node | Part]) -> Iterator[Entry]:
        nodes = [o for o in operands if isinstance(o, Node)]
        names = self._names(node, nodes)
        parts: list[Part] = []
        for one in operands:
            if isinstance(one, Part):
                parts.append(one)
            elif one.type == "template_string":
                # of several readings the first stands in the chain
                made = self._template(one, [-1])
                parts += [Part(e.original, e.placeholder, False, e.resolved or e.placeholder) for e in made[:1]]
            elif method_of(one) in ("join", "replace"):
                value = (self.bindings.join(one) if method_of(one) == "join" else self.bindings.replace(one))[0]
                parts.append(Part(f"{{{one.text}}}", value))
            else:
                parts += self._simple(one, names)
        yield from self._finish(parts)

    def _simple(self, node: Node, names: dict[str, str]) -> list[Part]:
        """A literal (none if empty), a variable's first value, a member's first value, or something unknown."""
        if node.type == "string":
            return [Part(text, text, True)] if (text := string_value(node)) else []
        if node.type == "identifier":
            known = self.bindings.names.get(node.text) or [self.placeholder]
        elif node.type == "member_expression":
            known = self.bindings.member(node) or [self.placeholder]
        else:
            return [self._unknown(node)]
        return [Part(f"{{{self._shown(node, names)}}}", known[0])]

    def _chain(self, node: Node) -> list[Part]:
        """Parts of .concat() and .replace() calls on each other."""
        calls: list[Node] = []
        while node.type == "call_expression" and method_of(node) is not None:
            calls.append(node)
            node = receiver(node)
        parts = self._simple(node, {})
        for call in reversed(calls):
            method, given = method_of(call), call_arguments(call)
            if method == "concat":
                for one in given:
                    parts += self._simple(one, {})
            elif method == "replace" and len(given) > 1 and (search := string_value(given[0])):
                new = self.placeholder
                if given[1].type == "string":
                    new = string_value(given[1]) or new
                elif given[1].type == "identifier":
                    new = (self.bindings.names.get(given[1].text) or [new])[0]
                if parts and parts[-1].literal:
                    text = parts[-1].value.replace(search, new)
                    parts[-1] = Part(text, text, True)
                else:
                    parts.append(Part(f"{{{{{search}->{new}}}}}", self.placeholder))
        return parts

    def _finish(self, parts: list[Part]) -> Iterator[Entry]:
        """The concatenation's entry, if any of its readings is an address."""
        p = re.escape(self.placeholder)

        def narrow(text: str, last: bool) -> str:
            text = re.sub(f"{p}+", lambda _: self.placeholder, text)
            text = re.sub(f"{p}/{p}", lambda _: self.placeholder, text)
            return re.sub(f"{p}{p}", lambda _: self.placeholder, text) if last else text

        original = "".join(x.shown for x in parts)
        value = narrow("".join(x.value for x in parts), True)
        resolved = narrow("".join(x.value if x.resolved is None else x.resolved for x in parts), False)
        if not self._address(original, value, resolved):
            return
        template = not all(x.literal for x in parts)
        shown, routed = rules.route_template(original)
        if routed or template:
            template = True
            original = shown
            value = rules.fill(rules.route_template(value)[0], self.placeholder)
            resolved = rules.fill(rules.route_template(resolved)[0], self.placeholder)
        yield Entry(original, value, resolved if resolved and resolved != value else None, template)


def entries(source: str, options: Options, problems: set[str] | None = None) -> list[Entry]:
    """Candidate addresses of one JavaScript text, first occurrences in order; limits that were met go to ``problems``."""
    found: set[str] = set() if problems is None else problems
    root = parse(source, found)
    bindings = Bindings(options.placeholder, options.context, options.policy, options.max_combinations)
    if not options.skip_symbols and not (options.context and options.policy == "only"):
        bindings.collect(root, options.max_nodes)
    collector = Collector(options, bindings)
    budget = [options.max_nodes]
    collector.run(root, budget)
    found |= collector.problems | bindings.problems
    if budget[0] < 0:
        found.add(NODES)
    return list(collector.entries.values())
