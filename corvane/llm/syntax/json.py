"""JSON as RFC 8259 has it."""

from __future__ import annotations

from .base import END, NUMBER, STRING, Lexer, Parser, run


class JsonLexer(Lexer):
    def word(self, token: str) -> str:
        return "B"

    def other(self, token: str) -> str:
        c = token[0]
        return STRING if c == '"' and len(token) > 1 else NUMBER if c in "-0123456789" and (c != "-" or len(token) > 1) else "B"


LEXER = JsonLexer(r"""[ \t\r\n]*+((?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[a-zA-Z]\w*|[^ \t\r\n]|\Z)""", "true false null { } [ ] , :")


class Json(Parser):
    MEMO: dict = {}

    def value(self) -> None:
        if self.take("{"):
            self.listed(self.member, "}", trailing=False)
        elif self.take("["):
            self.listed(self.value, "]", trailing=False)
        elif self.t in (STRING, NUMBER) or self.at("true", "false", "null"):
            self.next()
        else:
            self.fail("value expected")

    def member(self) -> None:
        if self.t != STRING:
            self.fail("key expected")
        self.next()
        self.need(":")
        self.value()

    def program(self) -> None:
        if self.S[self.p] == "﻿":
            self.next()
        self.guarded(self.value)
        while self.t != END:
            self.faults.append((self.p, "end of file expected"))
            self.guarded(self.value)


def parse(text: str):
    tokens, s = LEXER.lex(text)
    return run(Json(s)), LEXER
