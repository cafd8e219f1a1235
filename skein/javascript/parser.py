"""An error-tolerant recursive-descent parser for JavaScript with JSX.

Every text gives a tree.  Where a statement can't be read, an ``ERROR`` node takes
its place and holds what expressions and tokens can be made out, up to the next
semicolon, line or closing brace; reading then goes on.
"""

from __future__ import annotations

import re
import sys

from .nodes import Node

_ID = r"[A-Za-z_$\u0080-\U0010ffff\\][\w$\u0080-\U0010ffff\\]*"
_TRIVIA = re.compile(r"(?:[\s\ufeff]+|//[^\n]*|/\*.*?\*/|<!--[^\n]*)", re.S)
_TOKEN = re.compile(
    rf"(?P<id>{_ID})|(?P<private>\#{_ID})"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?P<body>(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+)/(?P<flags>[A-Za-z]*)")
_ESCAPE = re.compile(r"\\(?:u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-7]{1,3}|\r\n|.)", re.S)
_JSX_TEXT = re.compile(r"[^<{]+")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*")

_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_RESERVED = set(
    "break case catch class const continue debugger default delete do else export extends finally for function if"
    " import in instanceof new return super switch this throw try typeof var void while with null true false".split()
)
_LITERALS = {"this", "super", "null", "true", "false", "undefined"}
_PATTERNS = {
    "object": "object_pattern", "array": "array_pattern", "pair": "pair_pattern", "spread_element": "rest_pattern",
    "shorthand_property_identifier": "shorthand_property_identifier_pattern", "assignment_expression": "assignment_pattern",
}


#: Constructs within each other that are read; deeper ones become loose tokens, and ``DEEP`` is noted.
MAX_DEPTH = 900
#: Problems: too deep; read again and again in more ways than the effort for a text of its size allows.
DEEP, AMBIGUOUS = "nested too deep", "too ambiguous"


class Unreadable(Exception):
    """No construct of the language begins here."""


class Parser:
    def __init__(self, source: str):
        self.src, self.n = source, len(source)
        self.comments: dict[int, Node] = {}
        self.no_arrow: set[int] = set()
        self.no_in = False
        self.depth = 0
        self.effort = 0
        self.limit = 40 * self.n + 20_000
        #: What kept parts of the text from being read as what they are.
        self.problems: set[str] = set()
        self.pos = 0
        self._next(0)

    # -- tokens ---------------------------------------------------------------

    def _next(self, at: int) -> None:
        """Read the token from ``at``: its kind, place, and whether a line ends before it."""
        self.effort += 1
        self.last_end = at
        self.newline = False
        while at < self.n and (m := _TRIVIA.match(self.src, at)):
            piece = m[0]
            if piece[0] in "/<":
                if at not in self.comments:
                    self.comments[at] = Node("comment", at, m.end(), self.src)
                self.newline = self.newline or (piece.startswith("/*") and "\n" in piece)
            elif "\n" in piece:
                self.newline = True
            at = m.end()
        self.pos = at
        if at >= self.n:
            self.kind, self.val, self.end = "eof", "", at
        elif m := _TOKEN.match(self.src, at):
            self.kind, self.val, self.end = m.lastgroup, m[0], m.end()
        else:
            self.kind, self.val, self.end = "bad", self.src[at], at + 1

    def mark(self) -> int:
        return self.last_end

    def reset(self, mark: int) -> None:
        self._next(mark)

    def leaf(self, type_: str | None = None, named: bool | None = None) -> Node:
        """The token as a node; the next one is read."""
        node = Node(type_ or self.val, self.pos, self.end, self.src, type_ is not None if named is None else named)
        self._next(self.end)
        return node

    def at(self, *values: str) -> bool:
        return self.val in values and self.kind in ("p", "id")

    def expect(self, value: str) -> Node:
        if not self.at(value):
            raise Unreadable
        return self.leaf()

    def start(self, type_: str, at: int | None = None) -> Node:
        at = self.pos if at is None else at
        return Node(type_, at, at, self.src)

    # -- program and statements -----------------------------------------------

    def program(self) -> Node:
        root = Node("program", 0, self.n, self.src)
        if self.src.startswith("#!"):
            stop = self.src.find("\n")
            root.add(Node("hash_bang_line", 0, self.n if stop < 0 else stop, self.src))
            self._next(self.n if stop < 0 else stop)
        while self.kind != "eof":
            root.add(self.statement_or_error())
        self._place_comments(root)
        return root

    def statement_or_error(self) -> Node:
        mark, at = self.mark(), self.pos
        if self.effort < self.limit:
            try:
                return self.statement()
            except (Unreadable, RecursionError):
                self.depth = 0
                self.no_in = False
        else:
            self.problems.add(AMBIGUOUS)
        self.reset(mark)
        error = self.start("ERROR", at)
        begun = False
        while self.kind != "eof":
            if begun and (self.at(";", "}") or (self.newline and self.effort >= self.limit)):
                break
            if begun and self.newline and self.kind == "id":
                break
            here = self.mark()
            if self.effort < self.limit and not self.at("}", ")", "]", ",", ";", ":"):
                try:
                    error.add(self.assignment())
                    begun = True
                    continue
                except (Unreadable, RecursionError):
                    self.depth = 0
                    self.reset(here)
            error.add(self.loose())
            begun = True
        if self.at(";", "}") and error.children:
            error.add(self.leaf())
        return error

    def loose(self) -> Node:
        """One token, whatever it is; literals keep their types."""
        if self.kind == "str":
            return self.string()
        if self.at("`"):
            mark = self.mark()
            try:
                return self.template()
            except (Unreadable, RecursionError):
                self.reset(mark)
                self.kind = "bad"
        kinds = {"id": "identifier", "num": "number", "private": "private_property_identifier"}
        if self.kind in kinds and self.val not in _RESERVED:
            return self.leaf(kinds[self.kind])
        return self.leaf()

    def _place_comments(self, root: Node) -> None:
        """Each comment goes into the innermost construct around it."""
        for at in sorted(self.comments):
            comment, node = self.comments[at], root
            while True:
                inner = None
                low, high = 0, len(node.children)
                while low < high:
                    mid = (low + high) // 2
                    if node.children[mid].end <= at:
                        low = mid + 1
                    else:
                        high = mid
                if low < len(node.children) and node.children[low].start < at and node.children[low].children:
                    inner = node.children[low]
                if inner is None or inner.type in ("string", "regex"):
                    break
                node = inner
            if low < len(node.children) and node.children[low].start < at:
                continue  # inside a token
            comment.parent = node
            node.children.insert(low, comment)

    def semicolon(self, node: Node) -> Node:
        if self.at(";"):
            return node.add(self.leaf())
        if self.newline or self.at("}") or self.kind == "eof":
            return node
        raise Unreadable

    def statement(self) -> Node:
        if self.kind == "p":
            if self.val == "{":
                return self.block()
            if self.val == ";":
                return self.start("empty_statement").add(self.leaf())
            if self.val == "@":
                return self.class_(True)
        elif self.kind == "id":
            read = getattr(self, "s_" + self.val, None)
            if read and (made := read()) is not None:
                return made
            if self.val not in _RESERVED and (m := _TRIVIA.match(self.src, self.end) or True):
                at = self.end if m is True else m.end()
                if self.src.startswith(":", at) and not self.src.startswith("::", at):
                    node = self.start("labeled_statement").add(self.leaf("statement_identifier"), "label")
                    return node.add(self.expect(":")).add(self.statement(), "body")
        node = self.start("expression_statement").add(self.expression())
        return self.semicolon(node)

    def block(self) -> Node:
        node = self.start("statement_block").add(self.expect("{"))
        while not self.at("}"):
            if self.kind == "eof":
                raise Unreadable
            node.add(self.statement_or_error())
        return node.add(self.leaf())

    def declarators(self, node: Node) -> Node:
        while True:
            one = self.start("variable_declarator").add(self.binding(), "name")
            if self.at("="):
                one.add(self.leaf()).add(self.assignment(), "value")
            node.add(one)
            if not self.at(","):
                return node
            node.add(self.leaf())

    def s_var(self) -> Node:
        return self.semicolon(self.declarators(self.start("variable_declaration").add(self.leaf())))

    def s_const(self) -> Node:
        return self.semicolon(self.declarators(self.start("lexical_declaration").add(self.leaf(), "kind")))

    def s_let(self) -> Node | None:
        mark = self.mark()
        word = self.leaf()
        if self.kind == "id" or self.at("{", "["):
            return self.semicolon(self.declarators(self.start("lexical_declaration", word.start).add(word, "kind")))
        self.reset(mark)
        return None

    def s_function(self) -> Node:
        return self.function("function_declaration")

    def s_async(self) -> Node | None:
        mark = self.mark()
        word = self.leaf()
        if self.at("function") and not self.newline:
            return self.function("function_declaration", word)
        self.reset(mark)
        return None

    def s_class(self) -> Node:
        return self.class_(True)

    def parenthesised(self) -> Node:
        return self.start("parenthesized_expression").add(self.expect("(")).add(self.expression()).add(self.expect(")"))

    def s_if(self) -> Node:
        node = self.start("if_statement").add(self.leaf()).add(self.parenthesised(), "condition")
        node.add(self.statement(), "consequence")
        if self.at("else"):
            node.add(self.start("else_clause").add(self.leaf()).add(self.statement()), "alternative")
        return node

    def s_while(self) -> Node:
        return self.start("while_statement").add(self.leaf()).add(self.parenthesised(), "condition").add(self.statement(), "body")

    def s_with(self) -> Node:
        return self.start("with_statement").add(self.leaf()).add(self.parenthesised(), "object").add(self.statement(), "body")

    def s_do(self) -> Node:
        node = self.start("do_statement").add(self.leaf()).add(self.statement(), "body").add(self.expect("while"))
        node.add(self.parenthesised(), "condition")
        return node.add(self.leaf()) if self.at(";") else node

    def s_for(self) -> Node:
        node = self.start("for_in_statement").add(self.leaf())
        if self.at("await"):
            node.add(self.leaf())
        node.add(self.expect("("))
        first = None
        self.no_in = True
        try:
            if self.at("var", "let", "const"):
                first = self.start("variable_declaration" if self.val == "var" else "lexical_declaration").add(self.leaf())
                self.declarators(first)
            elif not self.at(";"):
                first = self.expression()
        finally:
            self.no_in = False
        if self.at("of", "in") and first is not None:
            if first.type.endswith("declaration"):
                node.add(first.children[0], "kind").add(first.children[1].get("name"), "left")
            else:
                node.add(_as_pattern(first), "left")
            node.add(self.leaf(), "operator").add(self.expression(), "right")
        else:
            node.type = "for_statement"
            node.add(first if first is not None else self.start("empty_statement"), "initializer").add(self.expect(";"))
            if not self.at(";"):
                node.add(self.expression(), "condition")
            node.add(self.expect(";"))
            if not self.at(")"):
                node.add(self.expression(), "increment")
        return node.add(self.expect(")")).add(self.statement(), "body")

    def _jump(self, type_: str, field: str | None) -> Node:
        node = self.start(type_).add(self.leaf())
        if not self.newline and not self.at(";", "}") and self.kind != "eof":
            node.add(self.expression() if field is None else self.leaf("statement_identifier"), field)
        return self.semicolon(node)

    def s_return(self) -> Node:
        return self._jump("return_statement", None)

    def s_throw(self) -> Node:
        return self._jump("throw_statement", None)

    def s_break(self) -> Node:
        return self._jump("break_statement", "label")

    def s_continue(self) -> Node:
        return self._jump("continue_statement", "label")

    def s_debugger(self) -> Node:
        return self.semicolon(self.start("debugger_statement").add(self.leaf()))

    def s_try(self) -> Node:
        node = self.start("try_statement").add(self.leaf()).add(self.block(), "body")
        if self.at("catch"):
            clause = self.start("catch_clause").add(self.leaf())
            if self.at("("):
                clause.add(self.leaf()).add(self.binding(), "parameter").add(self.expect(")"))
            node.add(clause.add(self.block(), "body"), "handler")
        if self.at("finally"):
            node.add(self.start("finally_clause").add(self.leaf()).add(self.block(), "body"), "finalizer")
        return node

    def s_switch(self) -> Node:
        node = self.start("switch_statement").add(self.leaf()).add(self.parenthesised(), "value")
        body = self.start("switch_body").add(self.expect("{"))
        while not self.at("}"):
            case = self.start("switch_default" if self.at("default") else "switch_case")
            if not self.at("case", "default"):
                raise Unreadable
            case.add(self.leaf())
            if case.type == "switch_case":
                case.add(self.expression(), "value")
            case.add(self.expect(":"))
            while not self.at("case", "default", "}"):
                if self.kind == "eof":
                    raise Unreadable
                case.add(self.statement_or_error(), "body")
            body.add(case)
        return node.add(body.add(self.leaf()), "body")

    def _from(self, node: Node) -> Node:
        node.add(self.expect("from"))
        if self.kind != "str":
            raise Unreadable
        node.add(self.string(), "source")
        if self.at("with", "assert") and not self.newline:
            node.add(self.start("import_attribute").add(self.leaf()).add(self.primary()))
        return node

    def _specifiers(self, list_type: str, one_type: str) -> Node:
        node = self.start(list_type).add(self.expect("{"))
        while not self.at("}"):
            one = self.start(one_type).add(self.string() if self.kind == "str" else self.word("identifier"), "name")
            if self.at("as"):
                one.add(self.leaf()).add(self.string() if self.kind == "str" else self.word("identifier"), "alias")
            node.add(one)
            if not self.at("}"):
                node.add(self.expect(","))
        return node.add(self.leaf())

    def s_import(self) -> Node | None:
        mark = self.mark()
        node = self.start("import_statement").add(self.leaf())
        if self.at("(", "."):
            self.reset(mark)
            return None
        if self.kind == "str":
            return self.semicolon(node.add(self.string(), "source"))
        clause = self.start("import_clause")
        if self.kind == "id":
            clause.add(self.word("identifier"))
            if self.at(","):
                clause.add(self.leaf())
        if self.at("*"):
            clause.add(self.start("namespace_import").add(self.leaf()).add(self.expect("as")).add(self.word("identifier")))
        elif self.at("{"):
            clause.add(self._specifiers("named_imports", "import_specifier"))
        return self.semicolon(self._from(node.add(clause)))

    def s_export(self) -> Node:
        node = self.start("export_statement").add(self.leaf())
        if self.at("default"):
            node.add(self.leaf())
            if self.at("function", "class", "async"):
                mark = self.mark()
                if (made := getattr(self, "s_" + self.val)()) is not None:
                    return node.add(made, "declaration")
                self.reset(mark)
            return self.semicolon(node.add(self.assignment(), "value"))
        if self.at("*"):
            star = self.leaf()
            if self.at("as"):
                star = self.start("namespace_export", star.start).add(star).add(self.leaf()).add(self.word("identifier"))
            return self.semicolon(self._from(node.add(star)))
        if self.at("{"):
            node.add(self._specifiers("export_clause", "export_specifier"))
            return self.semicolon(self._from(node) if self.at("from") else node)
        return node.add(self.statement(), "declaration")

    # -- functions, classes, patterns -------------------------------------------

    def word(self, type_: str) -> Node:
        if self.kind != "id":
            raise Unreadable
        return self.leaf(type_)

    def name(self) -> Node:
        if self.kind != "id" or self.val in _RESERVED:
            raise Unreadable
        return self.leaf("identifier")

    def binding(self) -> Node:
        if self.at("{"):
            node = self.start("object_pattern").add(self.leaf())
            while not self.at("}"):
                if self.at("..."):
                    node.add(self.start("rest_pattern").add(self.leaf()).add(self.binding()))
                else:
                    short = self.kind == "id" and self.val not in _RESERVED
                    key = self.property_key()
                    if self.at(":"):
                        pair = self.start("pair_pattern", key.start).add(key, "key").add(self.leaf())
                        node.add(pair.add(self.binding_default(), "value"))
                    elif short and key.type == "property_identifier":
                        key.type = "shorthand_property_identifier_pattern"
                        if self.at("="):
                            whole = self.start("object_assignment_pattern", key.start).add(key, "left")
                            key = whole.add(self.leaf()).add(self.assignment(), "right")
                        node.add(key)
                    else:
                        raise Unreadable
                if not self.at("}"):
                    node.add(self.expect(","))
            return node.add(self.leaf())
        if self.at("["):
            node = self.start("array_pattern").add(self.leaf())
            while not self.at("]"):
                if self.at(","):
                    node.add(self.leaf())
                    continue
                if self.at("..."):
                    node.add(self.start("rest_pattern").add(self.leaf()).add(self.binding()))
                else:
                    node.add(self.binding_default())
                if not self.at("]"):
                    node.add(self.expect(","))
            return node.add(self.leaf())
        return self.name()

    def binding_default(self) -> Node:
        left = self.binding()
        if self.at("="):
            return self.start("assignment_pattern", left.start).add(left, "left").add(self.leaf()).add(self.assignment(), "right")
        return left

    def parameters(self) -> Node:
        node = self.start("formal_parameters").add(self.expect("("))
        while not self.at(")"):
            if self.at("..."):
                node.add(self.start("rest_pattern").add(self.leaf()).add(self.binding()))
            else:
                node.add(self.binding_default())
            if not self.at(")"):
                node.add(self.expect(","))
        return node.add(self.leaf())

    def body(self) -> Node:
        before, self.no_in = self.no_in, False
        made = self.block()
        self.no_in = before
        return made

    def function(self, type_: str, word: Node | None = None) -> Node:
        node = self.start(type_, word.start if word else None).add(word).add(self.expect("function"))
        if self.at("*"):
            node.type = type_.replace("function_", "generator_function_").replace("_expression", "")
            node.add(self.leaf())
        if self.kind == "id" and not self.at("("):
            node.add(self.word("identifier"), "name")
        elif type_ == "function_declaration" and self.kind == "id":
            raise Unreadable
        return node.add(self.parameters(), "parameters").add(self.body(), "body")

    def class_(self, declares: bool) -> Node:
        node = self.start("class_declaration" if declares else "class")
        while self.at("@"):
            node.add(self.start("decorator").add(self.leaf()).add(self.postfix()), "decorator")
        if not self.at("class"):
            raise Unreadable
        node.add(self.leaf())
        if self.kind == "id" and not self.at("extends"):
            node.add(self.leaf("identifier"), "name")
        if self.at("extends"):
            node.add(self.start("class_heritage").add(self.leaf()).add(self.postfix()))
        body = self.start("class_body").add(self.expect("{"))
        while not self.at("}"):
            if self.at(";"):
                body.add(self.leaf())
                continue
            body.add(self.member(True))
        return node.add(body.add(self.leaf()), "body")

    def property_key(self) -> Node:
        if self.kind == "id":
            return self.leaf("property_identifier")
        if self.kind == "private":
            return self.leaf("private_property_identifier")
        if self.kind == "str":
            return self.string()
        if self.kind == "num":
            return self.leaf("number")
        if self.at("["):
            return self.start("computed_property_name").add(self.leaf()).add(self.assignment()).add(self.expect("]"))
        raise Unreadable

    def member(self, in_class: bool) -> Node:
        """A member of a class, or an entry of an object literal."""
        at = self.pos
        lead: list[Node] = []
        while self.at("@"):
            lead.append(self.start("decorator").add(self.leaf()).add(self.postfix()))
        if in_class and self.at("static"):
            mark = self.mark()
            lead.append(self.leaf())
            if self.at("{"):
                return self.start("class_static_block", at).add(lead[-1]).add(self.block(), "body")
            if self.at("=", "(", ";", "}"):
                lead.pop()
                self.reset(mark)
        while self.at("async", "get", "set", "*"):
            mark = self.mark()
            lead.append(self.leaf())
            if self.at("=", "(", ":", ",", "}", ";") or (lead[-1].type == "async" and self.newline):
                lead.pop()
                self.reset(mark)
                break
        if not in_class and self.at("..."):
            return self.start("spread_element").add(self.leaf()).add(self.assignment())
        short = self.kind == "id" and self.val not in _RESERVED
        key = self.property_key()
        if self.at("("):
            node = self.start("method_definition", at)
            for x in lead:
                node.add(x)
            return node.add(key, "name").add(self.parameters(), "parameters").add(self.body(), "body")
        if in_class:
            node = self.start("field_definition", at)
            for x in lead:
                node.add(x)
            node.add(key, "property")
            if self.at("="):
                node.add(self.leaf()).add(self.assignment(), "value")
            return self.semicolon(node)
        if lead:
            raise Unreadable
        if self.at(":"):
            return self.start("pair", at).add(key, "key").add(self.leaf()).add(self.assignment(), "value")
        if short:
            key.type = "shorthand_property_identifier"
            if self.at("="):
                key.type += "_pattern"
                node = self.start("object_assignment_pattern", at).add(key, "left")
                return node.add(self.leaf()).add(self.assignment(), "right")
            return key
        raise Unreadable

    # -- expressions --------------------------------------------------------------

    def expression(self) -> Node:
        first = self.assignment()
        if not self.at(","):
            return first
        node = self.start("sequence_expression", first.start).add(first)
        while self.at(","):
            node.add(self.leaf()).add(self.assignment())
        return node

    def assignment(self) -> Node:
        self.depth += 1
        if self.effort > 2 * self.limit:
            self.problems.add(AMBIGUOUS)
            raise Unreadable
        if self.depth > MAX_DEPTH:
            self.problems.add(DEEP)
            raise Unreadable
        try:
            return self._assignment()
        finally:
            self.depth -= 1

    def _assignment(self) -> Node:
        if (arrow := self.arrow()) is not None:
            return arrow
        if self.at("yield"):
            node = self.start("yield_expression").add(self.leaf())
            if self.at("*"):
                node.add(self.leaf())
            if not self.newline and not self.at(")", "]", "}", ",", ";", ":") and self.kind != "eof":
                node.add(self.assignment())
            return node
        left = self.ternary()
        if self.at("="):
            target = _as_pattern(left) if left.type in ("object", "array") else left
            return self.start("assignment_expression", left.start).add(target, "left").add(self.leaf()).add(self.assignment(), "right")
        if self.kind == "p" and self.val in _ASSIGN:
            node = self.start("augmented_assignment_expression", left.start).add(left, "left")
            return node.add(self.leaf(), "operator").add(self.assignment(), "right")
        return left

    def arrow(self) -> Node | None:
        """An arrow function, if one begins here."""
        if not (self.kind == "id" and self.val not in _RESERVED or self.at("(")) or self.pos in self.no_arrow:
            return None
        mark, at = self.mark(), self.pos
        node = self.start("arrow_function")
        if self.at("async"):
            word = self.leaf()
            if not self.newline and (self.kind == "id" and self.val not in _RESERVED or self.at("(")):
                node.add(word)
            else:
                self.reset(mark)
        try:
            if self.at("("):
                node.add(self.parameters(), "parameters")
            elif self.kind == "id":
                m = _TRIVIA.match(self.src, self.end)
                if not self.src.startswith("=>", m.end() if m else self.end):
                    raise Unreadable
                node.add(self.name(), "parameter")
            if not self.at("=>") or self.newline:
                raise Unreadable
        except Unreadable:
            self.no_arrow.add(at)
            self.reset(mark)
            return None
        node.add(self.leaf())
        return node.add(self.body() if self.at("{") else self.assignment(), "body")

    def ternary(self) -> Node:
        first = self.binary(0)
        if not self.at("?"):
            return first
        node = self.start("ternary_expression", first.start).add(first, "condition").add(self.leaf())
        before, self.no_in = self.no_in, False
        node.add(self.assignment(), "consequence")
        self.no_in = before
        return node.add(self.expect(":")).add(self.assignment(), "alternative")

    def binary(self, least: int) -> Node:
        left = self.unary()
        while self.kind in ("p", "id") and (rank := _BINARY.get(self.val, 0)) > least:
            if self.val == "in" and self.no_in:
                break
            node = self.start("binary_expression", left.start).add(left, "left").add(self.leaf(), "operator")
            left = node.add(self.binary(rank - (node.children[1].type == "**")), "right")
        return left

    def unary(self) -> Node:
        if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
            return self.start("unary_expression").add(self.leaf(), "operator").add(self.nested_unary(), "argument")
        if self.at("++", "--"):
            return self.start("update_expression").add(self.leaf(), "operator").add(self.nested_unary(), "argument")
        if self.at("await"):
            mark = self.mark()
            word = self.leaf()
            if not self.newline and (self.kind in ("id", "str", "num") and self.val not in _BINARY or self.at("(", "[", "`", "{")):
                return self.start("await_expression", word.start).add(word).add(self.nested_unary())
            self.reset(mark)
        node = self.postfix()
        if self.at("++", "--") and not self.newline:
            return self.start("update_expression", node.start).add(node, "argument").add(self.leaf(), "operator")
        return node

    def nested_unary(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.problems.add(DEEP)
            raise Unreadable
        try:
            return self.unary()
        finally:
            self.depth -= 1

    def postfix(self) -> Node:
        node = self.new() if self.at("new") else self.primary()
        return self.chain(node, True)

    def chain(self, node: Node, calls: bool) -> Node:
        """Members, subscripts, calls and tagged templates that follow."""
        while self.kind == "p":
            optional = None
            if self.val == "?." and calls:
                optional = self.leaf("optional_chain")
            if optional is None and self.val == "." or optional is not None and self.kind in ("id", "private"):
                whole = self.start("member_expression", node.start).add(node, "object")
                whole.add(optional if optional is not None else self.leaf())
                kind = "private_property_identifier" if self.kind == "private" else "property_identifier"
                if self.kind not in ("id", "private"):
                    raise Unreadable
                node = whole.add(self.leaf(kind), "property")
            elif self.val == "[":
                whole = self.start("subscript_expression", node.start).add(node, "object").add(optional)
                before, self.no_in = self.no_in, False
                whole.add(self.leaf()).add(self.expression(), "index")
                self.no_in = before
                node = whole.add(self.expect("]"))
            elif self.val == "(" and calls:
                node = self.start("call_expression", node.start).add(node, "function").add(optional).add(self.arguments(), "arguments")
            elif self.val == "`":
                node = self.start("call_expression", node.start).add(node, "function").add(self.template(), "arguments")
            elif optional is not None:
                raise Unreadable
            else:
                break
        return node

    def arguments(self) -> Node:
        node = self.start("arguments").add(self.expect("("))
        before, self.no_in = self.no_in, False
        while not self.at(")"):
            if self.at("..."):
                node.add(self.start("spread_element").add(self.leaf()).add(self.assignment()))
            else:
                node.add(self.assignment())
            if not self.at(")"):
                node.add(self.expect(","))
        self.no_in = before
        return node.add(self.leaf())

    def new(self) -> Node:
        node = self.start("new_expression").add(self.leaf())
        if self.at("."):
            node.type = "meta_property"
            return node.add(self.leaf()).add(self.word("property_identifier"))
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.problems.add(DEEP)
            raise Unreadable
        node.add(self.chain(self.new() if self.at("new") else self.primary(), False), "constructor")
        self.depth -= 1
        if self.at("("):
            node.add(self.arguments(), "arguments")
        return node

    def primary(self) -> Node:
        if self.kind == "id":
            return self._word()
        if self.kind == "str":
            return self.string()
        if self.kind == "num":
            return self.leaf("number")
        if self.kind == "private":
            return self.leaf("private_property_identifier")
        if self.kind == "p":
            if self.val == "(":
                return self.parenthesised()
            if self.val == "[":
                return self.array()
            if self.val == "{":
                node = self.start("object").add(self.leaf())
                while not self.at("}"):
                    node.add(self.member(False))
                    if not self.at("}"):
                        node.add(self.expect(","))
                return node.add(self.leaf())
            if self.val == "`":
                return self.template()
            if self.val in ("/", "/="):
                return self.regex()
            if self.val == "<":
                return self.jsx()
            if self.val == "@":
                return self.class_(False)
        raise Unreadable

    def _word(self) -> Node:
        word = self.val
        if word in _LITERALS:
            return self.leaf(word)
        if word == "function":
            return self.function("function_expression")
        if word == "class":
            return self.class_(False)
        if word == "async":
            mark = self.mark()
            lead = self.leaf()
            if self.at("function") and not self.newline:
                return self.function("function_expression", lead)
            self.reset(mark)
        if word == "import":
            node = self.leaf("import")
            if self.at("."):
                node = self.start("meta_property", node.start).add(node).add(self.leaf()).add(self.word("property_identifier"))
            elif not self.at("("):
                raise Unreadable
            return node
        return self.name()

    def array(self) -> Node:
        node = self.start("array").add(self.leaf())
        while not self.at("]"):
            if self.at(","):
                node.add(self.leaf())
                continue
            if self.at("..."):
                node.add(self.start("spread_element").add(self.leaf()).add(self.assignment()))
            else:
                node.add(self.assignment())
            if not self.at("]"):
                node.add(self.expect(","))
        return node.add(self.leaf())

    def _quoted(self, node: Node, start: int, stop: int) -> None:
        """Fragments and escapes of the literal's inside."""
        at = start
        for m in _ESCAPE.finditer(self.src, start, stop):
            if m.start() > at:
                node.add(Node("string_fragment", at, m.start(), self.src))
            node.add(Node("escape_sequence", m.start(), m.end(), self.src))
            at = m.end()
        if at < stop:
            node.add(Node("string_fragment", at, stop, self.src))

    def string(self) -> Node:
        node = self.start("string")
        start, end, quote = self.pos, self.end, self.val[0]
        node.add(Node(quote, start, start + 1, self.src, False))
        self._quoted(node, start + 1, end - 1)
        node.add(Node(quote, end - 1, end, self.src, False))
        self._next(end)
        return node

    def template(self) -> Node:
        node = self.start("template_string")
        at = self.pos + 1
        node.add(Node("`", self.pos, at, self.src, False))
        begun = at
        while True:
            if at >= self.n:
                raise Unreadable
            c = self.src[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self._quoted(node, begun, at)
                node.add(Node("`", at, at + 1, self.src, False))
                self._next(at + 1)
                return node
            elif c == "$" and self.src.startswith("${", at):
                self._quoted(node, begun, at)
                part = Node("template_substitution", at, at, self.src)
                part.add(Node("${", at, at + 2, self.src, False))
                self._next(at + 2)
                before, self.no_in = self.no_in, False
                part.add(self.expression())
                self.no_in = before
                if not self.at("}"):
                    raise Unreadable
                at = begun = self.end
                part.add(Node("}", self.pos, self.end, self.src, False))
                node.add(part)
            else:
                # on to the next character that means something
                at += 1
                while at < self.n and self.src[at] not in "\\`$":
                    at += 1

    def regex(self) -> Node:
        m = _REGEX.match(self.src, self.pos)
        if not m:
            raise Unreadable
        node = self.start("regex").add(Node("/", m.start(), m.start() + 1, self.src, False))
        node.add(Node("regex_pattern", *m.span("body"), self.src), "pattern")
        node.add(Node("/", m.end("body"), m.end("body") + 1, self.src, False))
        if m["flags"]:
            node.add(Node("regex_flags", *m.span("flags"), self.src), "flags")
        self._next(m.end())
        return node

    # -- JSX ------------------------------------------------------------------------

    def _jsx_name(self) -> Node | None:
        m = _JSX_NAME.match(self.src, self.pos)
        if not m:
            return None
        node = Node("identifier", m.start(), m.end(), self.src)
        self._next(m.end())
        while self.at(".", ":"):
            whole = self.start("member_expression" if self.val == "." else "jsx_namespace_name", node.start).add(node).add(self.leaf())
            m = _JSX_NAME.match(self.src, self.pos)
            if not m:
                raise Unreadable
            node = whole.add(Node("property_identifier", m.start(), m.end(), self.src))
            self._next(m.end())
        return node

    def _jsx_hole(self) -> Node:
        node = self.start("jsx_expression").add(self.expect("{"))
        if self.at("..."):
            node.add(self.start("spread_element").add(self.leaf()).add(self.assignment()))
        elif not self.at("}"):
            node.add(self.expression())
        return node

    def jsx(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.problems.add(DEEP)
            raise Unreadable
        opening = self.start("jsx_opening_element").add(self.expect("<"))
        name = self._jsx_name()
        opening.add(name, "name")
        while not self.at(">", "/"):
            if self.at("{"):
                hole = self._jsx_hole()
                opening.add(hole.add(self.expect("}")))
                continue
            m = _JSX_NAME.match(self.src, self.pos)
            if not m or name is None:
                raise Unreadable
            one = self.start("jsx_attribute").add(Node("property_identifier", m.start(), m.end(), self.src))
            self._next(m.end())
            if self.at(":"):
                one.add(self.leaf()).add(self.word("property_identifier"))
            if self.at("="):
                one.add(self.leaf())
                if self.src.startswith(('"', "'"), self.pos):
                    stop = self.src.find(self.src[self.pos], self.pos + 1)
                    if stop < 0:
                        raise Unreadable
                    self.kind, self.val, self.end = "str", self.src[self.pos : stop + 1], stop + 1
                    one.add(self.string())
                elif self.at("{"):
                    hole = self._jsx_hole()
                    one.add(hole.add(self.expect("}")))
                else:
                    one.add(self.jsx())
            opening.add(one)
        if self.at("/"):
            opening.type = "jsx_self_closing_element"
            opening.add(self.leaf()).add(self.expect(">"))
            self.depth -= 1
            return opening
        at = self.end
        opening.add(Node(">", self.pos, at, self.src, False))
        node = self.start("jsx_element", opening.start).add(opening, "open_tag")
        while True:
            if m := _JSX_TEXT.match(self.src, at):
                node.add(Node("jsx_text", at, m.end(), self.src))
                at = m.end()
            if at >= self.n:
                raise Unreadable
            if self.src[at] == "{":
                self._next(at)
                hole = self._jsx_hole()
                if not self.at("}"):
                    raise Unreadable
                at = self.end
                node.add(hole.add(Node("}", self.pos, at, self.src, False)))
            elif re.match(r"<\s*/", self.src[at : at + 20]):
                self._next(at)
                closing = self.start("jsx_closing_element").add(self.leaf()).add(self.expect("/"))
                closing.add(self._jsx_name(), "name").add(self.expect(">"))
                self.depth -= 1
                return node.add(closing, "close_tag")
            else:
                self._next(at)
                child = self.jsx()
                node.add(child)
                at = child.end


def _as_pattern(node: Node) -> Node:
    stack = [node]
    while stack:
        one = stack.pop()
        one.type = _PATTERNS.get(one.type, one.type)
        if one.type in ("object_pattern", "array_pattern"):
            stack.extend(one.children)
        elif one.type == "pair_pattern" and (value := one.get("value")) is not None:
            stack.append(value)
    return node


def parse(source: str, problems: set[str] | None = None) -> Node:
    """The tree of a text, of type ``program``; what went unread for its depth or effort is added to ``problems``."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    parser = Parser(source)
    root = parser.program()
    if problems is not None:
        problems |= parser.problems
    return root
