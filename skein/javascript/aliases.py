"""Names that a variable goes by near an expression: keys it is stored under or taken from."""

from __future__ import annotations

from .bindings import call_arguments, method_of, string_value
from .nodes import Node

#: Ancestors that are looked at.
REACH = 15
#: Parts of names that say little, and parts that say much.  Fixed values.
VAGUE = ("temp", "value", "data", "var", "val", "item")
TELLING = ("id", "key", "name", "code", "type", "status")


def nearby(node: Node, wanted: set[str]) -> dict[str, str]:
    """The best name for each of the wanted variables, if it has any."""
    found: dict[str, list[str]] = {}

    def take(literal: Node | None) -> None:
        if literal is None or literal.type not in ("object", "object_pattern"):
            return
        for pair in literal.named_children:
            key, value = pair.get("key"), pair.get("value")
            if key is not None and value is not None and value.type == "identifier" and value.text in wanted:
                found.setdefault(value.text, []).append(key.text.strip("\"'"))

    above, steps = node.parent, 0
    while above is not None and steps < REACH and wanted:
        steps += 1
        if above.type in ("arrow_function", "function_declaration", "method_definition"):
            for one in above.children:
                if one.field == "parameters":
                    for parameter in one.named_children:
                        take(parameter)
        elif above.type in ("statement_block", "program"):
            for statement in above.named_children:
                _statement(statement, take, wanted, found)
        above = above.parent
    return {name: best(names) for name, names in found.items()}


def _statement(statement: Node, take, wanted: set[str], found: dict[str, list[str]]) -> None:
    if statement.type in ("lexical_declaration", "variable_declaration"):
        declared = [d for d in statement.named_children if d.type == "variable_declarator"]
        for one in declared:
            take(one.get("value"))
            take(one.get("name"))
        for one in declared:
            made = one.get("value")
            if made is not None and made.type == "new_expression" and made.get("constructor").text == "URLSearchParams":
                take(next(iter(call_arguments(made)), None))
    elif statement.type == "expression_statement" and statement.named_children:
        call = statement.named_children[0]
        given = call_arguments(call) if method_of(call) == "append" else []
        if len(given) > 1 and given[0].type == "string" and given[1].type == "identifier" and given[1].text in wanted:
            found.setdefault(given[1].text, []).append(string_value(given[0]))


def score(name: str) -> int:
    """Lower is better: short names, rather telling than vague."""
    low = name.lower()
    return len(name) + 100 * any(v in low for v in VAGUE) - 5 * any(t in low for t in TELLING)


def best(names: list[str]) -> str:
    return min(names, key=score)
