"""Comments without their delimiters."""

from __future__ import annotations

import re

_ADDRESS = re.compile(r"//(?:(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}|(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?::[0-9]{1,5})?(?:/\S*)?\Z")
_OPEN, _CLOSE = re.compile(r"(?:/\*\s*)+"), re.compile(r"(?:\s*\*/)+\Z")
_SLASH_BEFORE, _SLASH_AFTER = re.compile(r"(?:/ \s*)+"), re.compile(r"(?:\s* /)+\Z")


def bare(text: str) -> tuple[str | None, bool]:
    """The comment's words, and whether delimiters went; ``(None, False)`` if no words are left.

    Two slashes before a host or an IP address, and nothing else, are part of it.
    """
    whole = text.strip()
    made = _OPEN.sub("", whole, count=1) if whole.startswith("/*") else whole
    made = _CLOSE.sub("", made).strip()
    while made.startswith("//") and not _ADDRESS.match(made):
        made = made[2:].strip()
    if made.startswith("/ "):
        made = _SLASH_BEFORE.sub("", made, count=1).strip()
    made = _SLASH_AFTER.sub("", made).strip()
    return (made, len(made) < len(whole)) if made else (None, False)
