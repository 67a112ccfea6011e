"""Go, semicolons put in as the specification says."""

from __future__ import annotations

import re

from .base import END, NAME, NUMBER, STRING, Lexer, Parser, kind, kinds, levels, run

_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_OPS = "++ -- && || &^ &^= << >> <<= >>= == != <= >= := += -= *= /= %= &= |= ^= <- ... + - * / % & | ^ ! < > = ( ) [ ] { } , ; . : ~"


class GoLexer(Lexer):
    def word(self, token: str) -> str:
        return "B" if token[0] in "$#" else NAME

    def other(self, token: str) -> str:
        c = token[0]
        if c in "\"'`":
            return STRING if len(token) > 1 else "B"
        return "\n" if c == "\n" else NAME if c == "_" else super().other(token)


LEXER = GoLexer(
    r"(?:[ \t\r﻿]+|//[^\n]*+|/\*(?:[^*\n]|\*(?!/))*+\*/)*+(\n(?:\s+|//[^\n]*+)*+|/\*(?:[^*]|\*(?!/))*+\*/|[^\W\d]\w*|"
    r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|' + r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'|"
    r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)|"
    r"<<=|>>=|&\^=|\.\.\.|\+\+|--|&&|\|\||&\^|<<|>>|:=|<-|[=!<>+\-*/%&|^]=|[^ \t\r]|\Z)",
    f"{_KEYWORDS} {_OPS}",
)
_ENDS = "".join(kinds("break continue fallthrough return ++ -- ) ] }") | {NAME, NUMBER, STRING})
_SEMI = re.compile(f"(?<=[{re.escape(_ENDS)}])\n")


class Go(Parser):
    MEMO: dict = {}
    STARTS = kinds("if for switch select return var const type func go defer break continue goto import")
    BINARY = levels("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")
    ASSIGN = kinds("= += -= *= /= %= &= |= ^= <<= >>= &^=")
    #: Below 0 in the headers of if, for and switch, where a brace opens the block.
    level = 0

    def semi(self) -> None:
        if not self.take(";") and self.t not in (")", "}", END):
            self.fail("';' expected")

    def program(self) -> None:
        self.guarded(self.package)
        while self.t != END:
            if self.t in ("}", ")"):
                self.faults.append((self.p, f"unmatched {self.t!r}"))
                self.next()
            else:
                self.guarded(self.top)

    def package(self) -> None:
        self.need("package")
        self.name()
        self.semi()

    def top(self) -> None:
        if self.at("func"):
            self.next()
            if self.at("("):
                self.parameters()
            self.name()
            if self.at("["):
                self.type_parameters()
            self.memo("signature", self.upto("{"), self.signature)
            if self.at("{"):
                self.block()
        elif self.at("var", "const", "type", "import"):
            self.declaration()
        else:
            self.fail("declaration expected")
        self.semi()

    def declaration(self) -> None:
        rule = {kind("var"): self.var, kind("const"): self.const, kind("type"): self.type_spec, kind("import"): self.import_}[self.next()]
        if self.take("("):
            while not self.at(")"):
                rule()
                self.semi()
            self.next()
        else:
            rule()

    def import_(self) -> None:
        if self.t == NAME or self.at("."):
            self.next()
        if self.t != STRING:
            self.fail("string expected")
        self.next()

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var(self) -> None:
        self.names()
        if self.take("="):
            self.expressions()
            return
        self.type()
        if self.take("="):
            self.expressions()

    def const(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.peek() == NAME and self.attempt(self.generic_spec):
            return
        self.take("=")
        self.type()

    def generic_spec(self) -> bool:
        self.type_parameters()
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.names()
            self.constraint()
            if not self.take(","):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.t in self.TYPES:
            self.type()

    TYPES = kinds("* [ map chan func struct interface <- (") | {NAME}

    def parameters(self) -> None:
        self.need("(")
        named = plain = False
        while not self.at(")"):
            if self.take("..."):
                self.type()
                plain = True
            else:
                self.type()
                if self.at("..."):
                    self.next()
                    self.type()
                    named = True
                elif self.t in self.TYPES:
                    self.type()
                    named = True
            if not self.take(","):
                break
        self.need(")")

    def type(self) -> None:
        t = self.t
        if t == NAME:
            self.next()
            if self.take("."):
                self.name()
            if self.at("[") and self.peek() != "]":
                self.attempt(self.type_arguments)
        elif t == "*":
            self.next()
            self.type()
        elif t == "(":
            self.next()
            self.type()
            self.need(")")
        elif t == "[":
            self.next()
            if not self.take("]"):
                if not self.take("..."):
                    self.inner(self.expression)
                self.need("]")
            self.type()
        elif self.take("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.take("<-"):
            self.need("chan")
            self.type()
        elif self.take("chan"):
            self.take("<-")
            self.type()
        elif self.take("func"):
            self.signature()
        elif self.take("struct"):
            self.need("{")
            while not self.at("}"):
                self.field()
                self.semi()
            self.next()
        elif self.take("interface"):
            self.need("{")
            while not self.at("}"):
                if self.t == NAME and self.peek() == "(":
                    self.next()
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            self.next()
        else:
            self.fail("type expected")

    def type_arguments(self) -> None:
        self.need("[")
        self.listed(self.type, "]")

    def field(self) -> None:
        if self.at("*") or self.t == NAME and self.peek() in (";", ".", "}", STRING):
            self.take("*")
            self.type()
        else:
            self.names()
            self.type()
        if self.t == STRING:
            self.next()

    def block(self) -> None:
        old, self.level = self.level, 0
        self.need("{")
        self.items(self.line, "}")
        self.next()
        self.level = old

    def line(self) -> None:
        if self.take(";"):
            return
        self.statement()
        self.semi()

    def inner(self, rule, *a) -> None:
        old, self.level = self.level, 0
        rule(*a)
        self.level = old

    def statement(self) -> None:
        rule = self.TABLE.get(self.t)
        if rule is not None:
            getattr(self, rule)()
        else:
            self.memo("simple", self.upto(";"), self.plain)

    def plain(self) -> None:
        if self.take("return"):
            if not self.at(";", "}"):
                self.expressions()
        elif self.at("break", "continue", "goto"):
            goto = self.at("goto")
            self.next()
            if self.t == NAME or goto:
                self.name()
        elif self.at("fallthrough"):
            self.next()
        elif self.at("go", "defer"):
            self.next()
            if self.expression() != "call":
                self.fail("a call expected")
        elif self.t == NAME and self.peek() == ":":
            self.next()
            self.next()
            if not self.at("}"):
                self.statement()
        else:
            self.simple()

    def s_declaration(self) -> None:
        self.memo("declaration", self.upto(";"), self.declaration)

    def s_block(self) -> None:
        self.block()

    def s_if(self) -> None:
        self.next()
        self.memo("if", self.upto("{"), self.header, True)
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.s_if()
            else:
                self.block()

    def header(self, needed: bool) -> str:
        old, self.level = self.level, -1
        what = ""
        if not self.at(";", "{"):
            what = self.simple()
        if self.take(";"):
            what = ""
            if not self.at("{"):
                what = self.simple()
        if needed and what != "expression":
            self.fail("condition expected")
        self.level = old
        return what

    def s_for(self) -> None:
        self.next()
        self.memo("for", self.upto("{"), self.for_header)
        self.block()

    def for_header(self) -> None:
        old, self.level = self.level, -1
        if self.take("range"):
            self.expression()
        elif not self.at("{"):
            what = ""
            if not self.at(";"):
                what = self.simple(True)
            if what != "range" and self.take(";"):
                if not self.at(";"):
                    self.simple()
                self.need(";")
                if not self.at("{"):
                    self.simple()
            elif what not in ("range", "expression"):
                self.fail("condition expected")
        self.level = old

    def s_switch(self) -> None:
        self.next()
        self.header(False)
        self.need("{")
        self.cases(False)

    def s_select(self) -> None:
        self.next()
        self.need("{")
        self.cases(True)

    def cases(self, select: bool) -> None:
        old, self.level = self.level, 0
        while not self.at("}"):
            if self.take("case"):
                if select:
                    self.simple()
                else:
                    while True:
                        self.type_or_expression()
                        if not self.take(","):
                            break
            elif not self.take("default"):
                self.fail("'case' expected")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.t == END:
                    self.fail("'}' expected")
                self.guarded(self.line)
        self.next()
        self.level = old

    def type_or_expression(self) -> None:
        if self.at("[", "map", "chan", "func", "struct", "interface", "*") and self.attempt(self.only_type):
            return
        self.expression()

    def only_type(self) -> bool:
        self.type()
        return self.at(",", ":", ")")

    TABLE = {kind(w): f for w, f in (("{", "s_block"), ("if", "s_if"), ("for", "s_for"), ("switch", "s_switch"), ("select", "s_select"), ("var", "s_declaration"), ("const", "s_declaration"), ("type", "s_declaration"))}

    def simple(self, loop: bool = False) -> str:
        if self.at(";", "}"):
            return ""
        what = self.expressions()
        if self.take("<-"):
            self.expression()
            return "send"
        if self.at("++", "--"):
            self.next()
            return "step"
        if self.at(":=", *()) or self.t in self.ASSIGN:
            define = self.at(":=")
            if define and what not in ("names", "name"):
                self.fail("names expected before ':='")
            if what == "call":
                self.fail("can't assign to a call")
            self.next()
            if loop and self.take("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assignment"
        return "expression" if what != "names" else "list"

    def expressions(self) -> str:
        what, n = self.expression(), 1
        names = what == "name"
        while self.take(","):
            names = (self.expression() == "name") and names
            n += 1
        return ("names" if names else "expressions") if n > 1 else what

    def expression(self) -> str:
        return self.climb()

    def unary(self) -> str:
        if self.at("+", "-", "!", "^", "*", "&", "<-"):
            if self.at("<-") and self.peek() == kind("chan"):
                return self.primary()
            star = self.at("*")
            self.next()
            self.unary()
            return "star" if star else "unary"
        return self.primary()

    def primary(self) -> str:
        t = self.t
        typed = False
        if t == NAME:
            self.next()
            what, typed = "name", True
        elif t in (NUMBER, STRING):
            self.next()
            what = "literal"
        elif t == "(":
            self.next()
            self.inner(self.type_or_expression)
            self.need(")")
            what = "group"
        elif self.at("func"):
            self.next()
            self.signature()
            what = "type"
            if self.at("{"):
                self.block()
                what = "function"
        elif self.at("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            what = "type"
            if self.at("{"):
                self.literal()
                what = "literal"
            elif not self.at("(", ")", ","):
                self.fail("'{' or '(' expected")
        else:
            self.fail("expression expected")
        while True:
            if self.at("."):
                self.next()
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    what, typed = "assertion", False
                else:
                    self.name()
                    what = "selector"
            elif self.at("["):
                self.next()
                self.inner(self.index)
                what = "index"
            elif self.at("("):
                self.next()
                self.inner(self.arguments)
                what, typed = "call", False
            elif self.at("{") and typed and self.level >= 0:
                self.literal()
                what, typed = "literal", False
            else:
                return what

    def index(self) -> None:
        colons = 0
        while not self.at("]"):
            if self.take(":"):
                colons += 1
            else:
                self.type_or_expression()
                if not self.at(":", "]", ","):
                    self.fail("']' expected")
                self.take(",")
        if self.S[self.p - 1] == "[" or colons > 2:
            self.fail("index expected")
        self.next()

    def arguments(self) -> None:
        while not self.at(")"):
            self.argument()
            if not self.take(","):
                break
        self.need(")")

    def argument(self) -> None:
        self.type_or_expression()
        self.take("...")

    def literal(self) -> None:
        old, self.level = self.level, 0
        self.need("{")
        self.listed(self.element, "}")
        self.level = old

    def element(self) -> None:
        self.part()
        if self.take(":"):
            self.part()

    def part(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()


def parse(text: str):
    tokens, s = LEXER.lex(text)
    if "/" in s and any(t.startswith("/*") for t in tokens):
        s = "".join(("\n" if "\n" in t else " ") if t.startswith("/*") and len(t) > 2 else k for t, k in zip(tokens, s))
    marked = _SEMI.sub(";", s)
    if marked and marked[-1] in _ENDS:
        marked += ";"
    keep = [i for i, k in enumerate(marked) if k not in "\n "] if "\n" in marked or " " in marked else None
    parser = Go(marked.replace("\n", "").replace(" ", ""))
    return [(keep[p] if keep and p < len(keep) else p, m) for p, m in run(parser)], LEXER
