"""Recursive-descent parsers with precedence climbing and panic-mode recovery for seven languages."""

from __future__ import annotations

from . import ecma, golang, java, json, python, rust
from .base import Fault

#: Languages by the extension of a path.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "json": "json"}
_PARSERS = {"python": python.parse, "javascript": ecma.parse, "typescript": lambda text: ecma.parse(text, ts=True), "go": golang.parse, "rust": rust.parse, "java": java.parse, "json": json.parse}


def faults(language: str, text: str) -> list[Fault]:
    """All faults the grammar of ``language`` finds in ``text``, the first cause first; empty if it accepts it."""
    found, lexer = _PARSERS[language](text)
    if not found:
        return []
    lines = lexer.lines(text) or [1]
    return [Fault(lines[min(max(at, 0), len(lines) - 1)], message) for at, message in found]
