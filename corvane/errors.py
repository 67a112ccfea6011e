"""Errors with a code callers may rely on, what to do about them, and three renderings."""

from __future__ import annotations

from typing import Any

# The codes.
CODES = frozenset(["INVALID_PATH", "INVALID_QUERY", "MISSING_REQUIRED", "NO_INDEX", "INDEX_BUILD_FAILED", "FILE_NOT_FOUND"])


class CorvaneError(Exception):
    def __init__(self, code: str, message: str, advice: str = "", **context: Any):
        if code not in CODES:
            raise ValueError(f"unknown error code {code!r}")
        super().__init__(message)
        self.code, self.message, self.advice, self.context = code, message, advice, context

    def as_dict(self) -> dict[str, Any]:
        return {"code": self.code, "message": self.message, **({"advice": self.advice} if self.advice else {}), **({"context": self.context} if self.context else {})}

    def as_xml(self) -> str:
        from .plans.render import attributes, escape

        advice = f"<advice>{escape(self.advice)}</advice>" if self.advice else ""
        return f"<error {attributes(code=self.code, **self.context)}><message>{escape(self.message)}</message>{advice}</error>"

    def as_text(self) -> str:
        about = ", ".join(f"{k}={v}" for k, v in self.context.items())
        return f"{self.code}: {self.message}" + (f" ({about})" if about else "") + (f"; {self.advice}" if self.advice else "")


def query_text(query: str | None) -> str:
    if not query or not query.strip():
        raise CorvaneError("INVALID_QUERY", "the query is empty", "say what to look for")
    return query


def one_of(focus: str | None, query: str | None) -> None:
    if not focus and not (query and query.strip()):
        raise CorvaneError("MISSING_REQUIRED", "neither a focus nor a query is given", "name a file to start from, or what to look for")


def token_limit(n: int | None) -> int | None:
    if n is not None and n <= 0:
        raise CorvaneError("INVALID_QUERY", "a token limit must be positive", "leave it out for none")
    return n
