"""Options of the address operators, checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..javascript.candidates import Options

POLICIES = ("merge", "override", "only")
HTML_PARSERS = ("lxml", "html.parser", "html5lib", "html5-parser")


def extension_set(given: str | list[str] | None) -> frozenset[str]:
    """Further file extensions, comma-separated or as a list, without leading dots and in lower case."""
    items = given.split(",") if isinstance(given, str) else given or []
    return frozenset(x for x in (i.strip().lstrip(".").lower() for i in items) if x)


@dataclass(frozen=True)
class UrlOptions:
    """``max_file_size`` is in MB of characters; beyond it variables stay unresolved, unless there is a
    context, and aliases are not looked for.  ``html_parser`` is accepted for the sake of
    existing calls: there is one reader.  ``max_combinations`` bounds the readings of one expression whose
    variables have many values, which otherwise multiply without end."""

    placeholder: str = "FUZZ"
    include_templates: bool = False
    max_nodes: int = 1_000_000
    max_file_size: float = 1.0
    html_parser: str = "lxml"
    skip_symbols: bool = False
    skip_aliases: bool = False
    context: dict[str, Any] = field(default_factory=dict)
    context_policy: str = "merge"
    extensions: str | list[str] | None = None
    max_combinations: int | None = 100_000

    def __post_init__(self) -> None:
        if not self.placeholder:
            raise ValueError("the placeholder cannot be empty")
        if self.context_policy not in POLICIES:
            raise ValueError(f"invalid context policy {self.context_policy!r}; one of {', '.join(POLICIES)}")
        if self.html_parser not in HTML_PARSERS:
            raise ValueError(f"invalid HTML parser {self.html_parser!r}; one of {', '.join(HTML_PARSERS)}")
        if self.max_nodes < 1 or self.max_file_size <= 0:
            raise ValueError("limits have to be positive")

    def for_size(self, characters: int) -> Options:
        """What applies to a source of this size."""
        large = characters / 1024**2 > self.max_file_size
        return Options(
            placeholder=self.placeholder,
            max_nodes=self.max_nodes,
            skip_symbols=self.skip_symbols or (large and not self.context),
            skip_aliases=self.skip_aliases or large,
            context=self.context,
            policy=self.context_policy,
            extensions=extension_set(self.extensions),
            max_combinations=self.max_combinations,
        )
