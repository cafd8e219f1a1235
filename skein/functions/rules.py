"""Predicates and rewrites of single texts, as the resolver needs them while it walks a tree."""

from __future__ import annotations

import re

from . import fixed

_SCHEME, _HOST, _IPV4 = (re.compile(p) for p in (fixed.SCHEME, fixed.HOST_PREFIX, fixed.IPV4))
_LABELS = re.compile(f"{fixed.THREE_LABELS}|{fixed.LABELS_SLASH}")
_PATHS = re.compile(f"{fixed.SLASH_WORD}|{fixed.DOT_SLASH}|{fixed.WORD_SLASH}")
_NOISE, _QHOST, _QWORD = (re.compile(p) for p in (fixed.QUERY_NOISE, fixed.QUERY_HOST, fixed.QUERY_WORD))
_PROSE_URL, _EMBEDDED = re.compile(fixed.PROSE_URL), re.compile(fixed.EMBEDDED_URL)
_COMMENT_PATH = re.compile(fixed.COMMENT_PATH)
_CREDENTIALS, _ROUTE, _BRACKET, _BRACES = (
    re.compile(p) for p in (fixed.CREDENTIALS, fixed.ROUTE_PARAM, fixed.BRACKET_PARAM, fixed.BRACES)
)
_NO_ADDRESS = re.compile("|".join(map(re.escape, fixed.NO_ADDRESS)))
_MESSAGE = re.compile("|".join(map(re.escape, fixed.MESSAGE)))
_EXTENSIONS = frozenset(fixed.FILE_EXTENSIONS)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|([0-9]{1,3})|([ntrbfv\\'\"]))")


def wordy(text: str) -> bool:
    """Reads like a sentence."""
    return text.count(" ") >= 3 or bool(_NO_ADDRESS.search(text.lower()))


def is_filename(text: str, extra: frozenset[str] = frozenset()) -> bool:
    base, dot, last = text.rpartition(".")
    if not dot or len(base) < 2 or "/" in text or "\\" in text:
        return False
    known = _EXTENSIONS | extra if extra else _EXTENSIONS
    return last.lower() in known or f"{base.rpartition('.')[2]}.{last}".lower() in known


def is_url(text: str) -> bool:
    if not text or wordy(text):
        return False
    return text.startswith("//") or any(p.match(text) for p in (_SCHEME, _HOST, _IPV4, _LABELS))


def is_path(text: str, extra: frozenset[str] = frozenset()) -> bool:
    if not text or wordy(text) or text.startswith("//"):
        return False
    if is_filename(text, extra):
        return True
    base, query, _ = text.partition("?")
    if query:
        if "/" in base:
            return True
        if "." in base:
            return not _NOISE.search(base) and bool(_QHOST.match(base))
        return bool(_QWORD.match(base))
    return bool(_PATHS.match(text))


def is_html(text: str) -> bool:
    text = text.strip()
    if re.search("<!doctype html|<html|<head|<body", text[:200].lower()):
        return True
    stop = text.find(">")
    if not text.startswith("<") or not 0 < stop < 100:
        return False
    tag = text[: stop + 1]
    return tag.count("<") == 1 or "<script" in tag.lower()


def message_urls(text: str, placeholder: str) -> list[str] | None:
    """Addresses in a text for people: None if it is none."""
    if "<" in text and ">" in text:
        return None
    spaced = text.count(" ") >= 4 and not text.startswith(("http://", "https://", "/", "./", "../"))
    if not spaced and "useRoutes()" not in text and not _MESSAGE.search(text.lower()):
        return None
    found = (m.rstrip(".,;:") for m in _PROSE_URL.findall(text))
    return [m for m in found if len(m) > 10]


def embedded_urls(text: str) -> list[str]:
    return _EMBEDDED.findall(text)


def comment_paths(text: str) -> list[str]:
    return _COMMENT_PATH.findall(text)


def route_template(text: str) -> tuple[str, bool]:
    """``/:id`` and ``[id]`` as ``{id}``, and whether there was any."""
    made = text if _CREDENTIALS.search(text) else _ROUTE.sub(r"/{\1}", text)
    made = _BRACKET.sub(r"{\1}", made)
    return made, made != text


def fill(text: str, placeholder: str) -> str:
    """Braces replaced by the placeholder, neighbouring placeholders as one."""
    made = _BRACES.sub(lambda _: placeholder, text)
    return re.sub(f"(?:{re.escape(placeholder)}){{2,}}", lambda _: placeholder, made)


def unescape(text: str) -> str:
    """JavaScript's escapes; an unknown one keeps its backslash."""
    if "\\" not in text:
        return text

    def value(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            number = int(code, 16)
            return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else "\ufffd"
        if m[4]:
            octal = re.match("[0-7]*", m[4])[0]
            return chr(int(octal, 8)) + m[4][len(octal) :] if octal else m[0]
        return _ESCAPES[m[5]]

    return _ESCAPE.sub(value, text)


_CLOSES = {"(": ")", "[": "]", "{": "}"}


def clean(text: str) -> str:
    """Cut at the first closing bracket that nothing opened, then without full stops and commas at the end."""
    waiting: list[str] = []
    for at, c in enumerate(text):
        if c in _CLOSES:
            waiting.append(_CLOSES[c])
        elif c in ")]}":
            if not waiting or waiting.pop() != c:
                text = text[:at]
                break
    return text.rstrip(".,")


_JUNK = [
    re.compile(x)
    for x in (
        f"^(?:{'|'.join(fixed.MIME_PREFIXES)})/", fixed.BARE_SCHEME, fixed.ONE_PARAM, fixed.DATE_FORMAT, fixed.ZONE, fixed.BARE_DATE,
        fixed.BACKREFERENCE, fixed.API, fixed.OPEN_END,
    )
]
_PROPERTY = re.compile(fixed.PROPERTY_PATH)
_QUOTE_START = re.compile(fixed.QUOTE_START)


def is_junk(text: str | None, placeholder: str = "FUZZ", extra: frozenset[str] = frozenset()) -> bool:
    """Nothing that an address would be; the rules of the column of this name, for single texts."""
    if text is None or len(text) < 2 or text in fixed.JUNK or text.startswith(fixed.JUNK_PREFIX):
        return True
    if text in {f"/{placeholder}", f"//{placeholder}", *(placeholder + u for u in fixed.CSS_UNITS)}:
        return True
    if text in {f"{s}://{placeholder}{e}" for s in ("http", "https") for e in ("", "/")}:
        return True
    bare = text.replace(placeholder, "")
    return (
        any(p.search(text) for p in _JUNK)
        or text.split(";", 1)[0].split(",", 1)[0].strip(" ") in fixed.MIME_OTHERS
        or bool(_PROPERTY.search(text) and not is_filename(text, extra))
        or re.fullmatch(f"{re.escape(placeholder)}(?:/{re.escape(placeholder)})+", text) is not None
        or bool(bare and not re.search("[a-zA-Z0-9]", bare))
        or (len(text) > 3 and re.search("['\"]", text[1:-1]) is not None and not _QUOTE_START.search(text))
    )
