"""What an HTML text holds: attributes, comments and inline scripts, by one streaming pass."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

from ..functions import fixed, rules

_ATTRIBUTE = re.compile(r"(?:href|src|action|data)\s*=\s*[\"']([^\"']+)[\"']")
_PATH = re.compile(fixed.COMMENT_PATH.replace("./{}:]", "./{}: ]"))
_TAG_RANK: dict[str, int] = {}
_WANTED: dict[str, list[str]] = {}
for _tag, _attribute in fixed.TAG_ATTRIBUTES:
    _TAG_RANK.setdefault(_tag, len(_TAG_RANK))
    _WANTED.setdefault(_tag, []).append(_attribute)


class Piece(NamedTuple):
    """``kind`` is attribute, comment or script; place is by order in the text."""

    kind: str
    tag: str
    name: str
    value: str
    place: int


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[Piece] = []
        self.place = 0
        self.script: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.place += 1
        seen = set()
        for name, value in attrs:
            if name not in seen and value is not None:
                self.pieces.append(Piece("attribute", tag, name, value, self.place))
            seen.add(name)
        if tag == "script":
            self.script = None if any(n == "src" and v for n, v in attrs) else []

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "script":
            self.script = None

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            code = "".join(self.script).strip()
            if code:
                self.place += 1
                self.pieces.append(Piece("script", tag, "", code, self.place))
            self.script = None

    def handle_comment(self, data: str) -> None:
        self.place += 1
        self.pieces.append(Piece("comment", "", "", data, self.place))


def read(html: str) -> list[Piece]:
    """Pieces in order of the text; a text that isn't HTML has few or none."""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except Exception:  # the parser gives up on some malformed declarations; what it found stays
        pass
    return reader.pieces


def scripts(pieces: list[Piece]) -> list[str]:
    return [p.value for p in pieces if p.kind == "script"]


def addresses(pieces: list[Piece], extra: frozenset[str] = frozenset()) -> list[str]:
    """Addresses: of the known tags by tag, of data attributes, of comments.

    An empty candidate in a srcset is passed over.
    """
    attributes = [p for p in pieces if p.kind == "attribute"]
    found: list[str] = []
    known = [p for p in attributes if p.name in _WANTED.get(p.tag, ())]
    for p in sorted(known, key=lambda p: (_TAG_RANK[p.tag], p.place, _WANTED[p.tag].index(p.name))):
        if p.name == "srcset":
            found += [w[0] for part in p.value.split(",") if (w := part.split())]
        else:
            found.append(p.value.strip())
    data = [p for p in attributes if p.name in fixed.DATA_ATTRIBUTES]
    found += [p.value.strip() for p in sorted(data, key=lambda p: (p.place, fixed.DATA_ATTRIBUTES.index(p.name)))]
    for p in pieces:
        if p.kind == "comment":
            text = p.value.strip()
            for some in (rules.embedded_urls(text), _ATTRIBUTE.findall(text), _PATH.findall(text)):
                found += [x.strip() for x in some]
    return [x for x in found if x and not x.startswith(fixed.SKIPPED_SCHEMES) and (rules.is_url(x) or rules.is_path(x, extra))]
