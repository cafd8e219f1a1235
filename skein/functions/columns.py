"""Predicates and rewrites of texts as column expressions; all run inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def quoted(text: str) -> str:
    """The text as a pattern that matches itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _one_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def wordy(text: Column) -> Column:
    """Reads like a sentence: three spaces, or a phrase that no address holds."""
    return (_spaces(text) >= 3) | F.lower(text).rlike(_one_of(fixed.NO_ADDRESS))


def is_filename(text: Column, extra: Sequence[str] = ()) -> Column:
    """A base of two characters or more and a known extension, single or double, without slashes."""
    known = sorted({*fixed.FILE_EXTENSIONS, *extra})
    last = F.lower(F.substring_index(text, ".", -1))
    pair = F.lower(F.substring_index(text, ".", -2))
    shape = text.contains(".") & ~text.rlike(r"[/\\]") & (F.length(text) - F.length(F.substring_index(text, ".", -1)) >= 3)
    # a double extension after a base of one part is the whole text
    return F.coalesce(shape & (last.isin(known) | pair.isin(known)), F.lit(False))


def is_url(text: Column) -> Column:
    start = f"{fixed.SCHEME}|^//|{fixed.HOST_PREFIX}|{fixed.IPV4}|{fixed.THREE_LABELS}|{fixed.LABELS_SLASH}"
    return F.coalesce(~wordy(text) & text.rlike(start), F.lit(False))


def is_path(text: Column, extra: Sequence[str] = ()) -> Column:
    base = F.substring_index(text, "?", 1)
    asked = (
        F.when(base.contains("/"), True)
        .when(base.contains("."), ~base.rlike(fixed.QUERY_NOISE) & base.rlike(fixed.QUERY_HOST))
        .otherwise(base.rlike(fixed.QUERY_WORD))
    )
    plain = text.rlike(f"{fixed.SLASH_WORD}|{fixed.DOT_SLASH}|{fixed.WORD_SLASH}")
    shape = F.when(is_filename(text, extra), True).when(text.contains("?"), asked).otherwise(plain)
    return F.coalesce(~wordy(text) & ~text.startswith("//") & shape, F.lit(False))


def is_html(text: Column) -> Column:
    """A document's opening near the start, or a text that begins with one tag."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    tag = F.substring_index(body, ">", 1)
    opens = body.startswith("<") & F.substring(body, 1, 100).contains(">")
    single = (F.length(tag) - F.length(F.replace(tag, F.lit("<"), F.lit(""))) == 1) | F.lower(tag).contains("<script")
    head = F.lower(F.substring(body, 1, 200)).rlike("<!doctype html|<html|<head|<body")
    return F.coalesce(head | (opens & single), F.lit(False))


def message_urls(text: Column, placeholder: str = "FUZZ") -> Column:
    """Addresses in a text for people, as an array; null if the text is none."""
    spaced = (_spaces(text) >= 4) & ~text.rlike(r"^(?:https?://|/|\./|\.\./)")
    message = spaced | text.contains("useRoutes()") | F.lower(text).rlike(_one_of(fixed.MESSAGE))
    found = F.regexp_extract_all(text, F.lit(f"({fixed.PROSE_URL})"), F.lit(1))
    found = F.transform(found, lambda u: F.regexp_replace(u, "[.,;:]+$", ""))
    return F.when(message & ~(text.contains("<") & text.contains(">")), F.filter(found, lambda u: F.length(u) > 10))


def route_template(text: Column) -> Column:
    """``/:id`` and ``[id]`` as ``{id}``; the first not in a text with credentials."""
    routed = F.when(text.rlike(fixed.CREDENTIALS), text).otherwise(F.regexp_replace(text, fixed.ROUTE_PARAM, r"/{$1}"))
    return F.regexp_replace(routed, fixed.BRACKET_PARAM, r"{$1}")


def consolidate(text: Column, placeholder: str = "FUZZ") -> Column:
    """Neighbouring placeholders as one."""
    return F.regexp_replace(text, f"(?:{quoted(placeholder)}){{2,}}", placeholder.replace("\\", "\\\\").replace("$", "\\$"))


def clean_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[.,]+$", "")


def clean_brackets(text: Column) -> Column:
    """Cut at the first closing bracket that nothing opened.

    A fold over the characters to the place of the cut, with the brackets still
    open as a string; texts without a closing bracket pass by.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.lit(-1).alias("cut"))

    def step(state: Column, char: Column) -> Column:
        opened, closes = state["open"], char.isin(")", "]", "}")
        wants = F.translate(F.right(opened, F.lit(1)), "([{", ")]}")
        after = (
            F.when(char.isin("(", "[", "{"), F.concat(opened, char))
            .when(closes, F.substring(opened, F.lit(1), F.length(opened) - 1))
            .otherwise(opened)
        )
        cut = F.when((state["cut"] < 0) & closes & (wants != char), state["at"]).otherwise(state["cut"])
        return F.struct(after.alias("open"), (state["at"] + 1).alias("at"), cut.alias("cut"))

    place = F.aggregate(F.split(text, ""), start, step, lambda s: s["cut"])
    place = F.when(text.rlike(r"[)\]}]"), place).otherwise(-1)
    return F.when(place >= 0, F.substring(text, F.lit(1), place)).otherwise(text)


def clean(text: Column) -> Column:
    return clean_punctuation(clean_brackets(text))


def is_junk(text: Column, placeholder: str = "FUZZ", extra: Sequence[str] = ()) -> Column:
    """Nothing that an address would be: null, fragments, MIME types, formats, names of functions and so on."""
    p = quoted(placeholder)
    exact = [*fixed.JUNK, f"/{placeholder}", f"//{placeholder}", *(placeholder + u for u in fixed.CSS_UNITS)]
    exact += [f"{s}://{placeholder}{e}" for s in ("http", "https") for e in ("", "/")]
    bare = F.replace(text, F.lit(placeholder), F.lit(""))
    mime = F.trim(F.substring_index(F.substring_index(text, ";", 1), ",", 1))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    rules = (
        F.length(text) < 2,
        text.isin(exact),
        text.startswith(fixed.JUNK_PREFIX),
        text.rlike(f"^(?:{'|'.join(fixed.MIME_PREFIXES)})/"),
        mime.isin(list(fixed.MIME_OTHERS)),
        text.rlike(fixed.BARE_SCHEME),
        text.rlike(fixed.PROPERTY_PATH) & ~is_filename(text, extra),
        text.rlike(fixed.ONE_PARAM),
        text.rlike(f"^{p}(?:/{p})+$"),
        text.rlike(fixed.DATE_FORMAT),
        text.rlike(fixed.ZONE),
        text.rlike(fixed.BARE_DATE),
        text.rlike(fixed.BACKREFERENCE),
        (F.length(bare) > 0) & ~bare.rlike("[a-zA-Z0-9]"),
        text.rlike(fixed.API),
        text.rlike(fixed.OPEN_END),
        (F.length(text) > 3) & inner.rlike("['\"]") & ~text.rlike(fixed.QUOTE_START),
    )
    found = rules[0]
    for rule in rules[1:]:
        found = found | rule
    return F.coalesce(found, F.lit(True))
