"""Rust, 2021 edition; of macro calls only the token trees are held to account."""

from __future__ import annotations

from .base import END, LIFETIME, NAME, NUMBER, STRING, Lexer, Parser, kind, kinds, levels, run

_KEYWORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
_OPS = "-> => :: .. ..= ... && || == != <= >= << += -= *= /= %= &= |= ^= <<= + - * / % & | ^ ! < > = ( ) [ ] { } , ; . : ? @ # $ ~"


class RustLexer(Lexer):
    def word(self, token: str) -> str:
        return STRING if token[-1] in "\"'" or token[-1] == "#" and len(token) > 1 else NAME if token[0] not in "$#" else token[0]

    def other(self, token: str) -> str:
        c = token[0]
        if c == "'":
            return "B" if len(token) == 1 else STRING if token[-1] == "'" and len(token) > 2 else LIFETIME
        if c == '"':
            return STRING if len(token) > 1 else "B"
        return NAME if c == "_" else super().other(token)


# findall wants one group; raw strings are told apart by their count of marks
LEXER = RustLexer(
    r"(?:\s+|//[^\n]*+|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/|\A\#![^\[\n][^\n]*)*+("
    r'(?:b|c)?r"[^"]*"|(?:b|c)?r\#"(?:[^"]|"(?!\#))*"\#|(?:b|c)?r\#\#"(?:[^"]|"(?!\#\#))*"\#\#|(?:b|c)?r\#\#\#"(?:[^"]|"(?!\#\#\#))*"\#\#\#|'
    r'(?:b|c)?"(?:[^"\\]|\\[\s\S])*"|' + r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'|'[^\W\d]\w*|(?:r\#)?[^\W\d]\w*|"
    r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?)(?:_?[iuf](?:8|16|32|64|128|size))?(?!\w)|"
    r"<<=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||==|!=|<=|>=|<<|[+\-*/%&|^]=|\S|\Z)",
    f"{_KEYWORDS} {_OPS}",
)


class Rust(Parser):
    MEMO: dict = {}
    NAMES = frozenset(NAME)
    STARTS = kinds("let fn struct enum impl trait mod use pub const static type if for while loop match return unsafe extern")
    BINARY = levels("||", "&&", "== != < > <= >=", "|", "^", "&", "<< >>", "+ -", "* / %")
    ASSIGN = kinds("= += -= *= /= %= &= |= ^= <<=")
    PATH = frozenset(NAME) | kinds("self Self super crate")
    #: Whether a brace after a path opens a block and not a struct.
    strict = False

    def program(self) -> None:
        while self.t != END:
            if self.t == "}":
                self.faults.append((self.p, "unmatched '}'"))
                self.next()
            else:
                self.guarded(self.item)

    def attributes(self) -> None:
        while self.at("#"):
            self.next()
            self.take("!")
            if not self.at("["):
                self.fail("'[' expected")
            self.tree()

    def tree(self) -> None:
        """A balanced token tree."""
        closes = []
        while True:
            t = self.t
            if t in "([{":
                closes.append({"(": ")", "[": "]", "{": "}"}[t])
            elif t in ")]}":
                if closes[-1] != t:
                    self.fail(f"{closes[-1]!r} expected")
                closes.pop()
            elif t == END or t == "B":
                self.fail(f"{closes[-1] if closes else 'bracket'!r} expected")
            self.next()
            if not closes:
                return

    def visibility(self) -> None:
        if self.take("pub") and self.at("(") and self.peek() in kinds("crate self super in"):
            self.tree()

    ITEMS = kinds("use mod fn struct enum impl trait type const static extern unsafe async pub")

    def item(self) -> None:
        self.attributes()
        if self.t == END:
            return
        self.visibility()
        if self.at("const") and self.peek() in (self.NAMES):
            return self.memo("const", self.upto(";"), self.constant)
        while self.at("const", "async", "unsafe", "extern") and not (self.at("extern") and self.peek() == kind("crate")):
            extern = self.at("extern")
            self.next()
            if extern and self.t == STRING:
                self.next()
            if extern and self.at("{"):
                return self.body(self.associated)
        if self.at("fn"):
            self.function()
        elif self.at("use"):
            self.memo("use", self.upto(";"), self.use)
        elif self.take("extern"):
            self.need("crate")
            self.next()
            if self.take("as"):
                self.name()
            self.need(";")
        elif self.take("mod"):
            self.name()
            if not self.take(";"):
                self.body(self.item)
        elif self.take("struct"):
            self.struct()
        elif self.take("enum"):
            self.name()
            self.generics()
            self.where()
            self.need("{")
            self.listed(self.variant, "}")
        elif self.t == NAME and self.peek() == NAME and self.peek(2) in ("{", "<"):
            self.next()  # union
            self.struct()
        elif self.at("impl"):
            self.next()
            self.generics()
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.body(self.associated)
        elif self.take("trait"):
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.body(self.associated)
        elif self.at("type"):
            self.type_item()
        elif self.at("static", "const"):
            self.constant()
        elif self.t in self.PATH and (self.peek() == "!" or self.peek() == kind("::")):
            self.path_plain()
            self.need("!")
            if self.t == NAME:
                self.next()
            brace = self.at("{")
            if self.t not in "([{":
                self.fail("bracket expected")
            self.tree()
            if not brace:
                self.need(";")
        else:
            self.fail("item expected")

    def body(self, rule) -> None:
        self.need("{")
        self.items(rule, "}")
        self.next()

    def associated(self) -> None:
        self.attributes()
        if self.at("}"):
            return
        self.item()

    def type_item(self) -> None:
        self.next()
        self.name()
        self.generics()
        if self.take(":"):
            self.bounds()
        self.where()
        if self.take("="):
            self.type()
        self.where()
        self.need(";")

    def constant(self) -> None:
        self.next()
        self.take("mut")
        self.name()
        self.need(":")
        self.type()
        if self.take("="):
            self.expression()
        self.need(";")

    def use(self) -> None:
        self.next()
        self.use_tree()
        self.need(";")

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                self.listed(self.use_tree, "}")
                return
            if self.t not in self.PATH:
                self.fail("path expected")
            self.next()
            if not self.take("::"):
                break
        if self.take("as"):
            self.name()

    def struct(self) -> None:
        self.name()
        self.generics()
        self.where()
        if self.take(";"):
            return
        if self.take("("):
            self.listed(self.tuple_field, ")")
            self.where()
            self.need(";")
        else:
            self.need("{")
            self.listed(self.field, "}")

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.take("("):
            self.listed(self.tuple_field, ")")
        elif self.take("{"):
            self.listed(self.field, "}")
        if self.take("="):
            self.expression()

    def function(self) -> None:
        self.next()
        self.name()
        self.memo("signature", self.upto("{"), self.signature)
        if not self.take(";"):
            self.block()

    def signature(self) -> None:
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.take("->"):
            self.type()
        self.where()

    def parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return
        p = self.p
        if self.take("&"):
            if self.t == LIFETIME:
                self.next()
        self.take("mut")
        if self.take("self"):
            if self.take(":"):
                self.type()
            return
        self.back(p)
        self.pattern()
        self.need(":")
        self.type()

    def generics(self) -> None:
        if self.take("<"):
            while not self.at(">"):
                self.attributes()
                if self.t == LIFETIME:
                    self.next()
                    if self.take(":"):
                        self.bounds()
                elif self.take("const"):
                    self.name()
                    self.need(":")
                    self.type()
                    if self.take("="):
                        self.unary()
                else:
                    self.name()
                    if self.take(":"):
                        self.bounds()
                    if self.take("="):
                        self.type()
                if not self.take(","):
                    break
            self.close_angle()

    def close_angle(self) -> None:
        if self.at(">"):
            self.next()
        else:
            self.fail("'>' expected")

    def bounds(self) -> None:
        while self.t not in ",{=>;)":
            self.take("?")
            if self.t == LIFETIME:
                self.next()
            elif self.take("("):
                self.bounds()
                self.need(")")
            else:
                if self.take("for"):
                    self.generics()
                self.take("async")
                self.take("const")
                self.type_path()
            if not self.take("+"):
                return

    def where(self) -> None:
        if self.take("where"):
            while self.t not in "{;=":
                if self.t == LIFETIME:
                    self.next()
                else:
                    if self.take("for"):
                        self.generics()
                    self.type()
                self.need(":")
                self.bounds()
                if not self.take(","):
                    break

    def type(self) -> None:
        t = self.t
        if self.take("&") or self.take("&&"):
            if self.t == LIFETIME:
                self.next()
            self.take("mut")
            self.type()
        elif t == "*":
            self.next()
            if not self.take("const"):
                self.need("mut")
            self.type()
        elif t == "(":
            self.next()
            self.listed(self.type, ")")
        elif t == "[":
            self.next()
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif t == "!":
            self.next()
        elif self.at("impl", "dyn"):
            self.next()
            self.bounds()
        elif self.at("fn", "unsafe", "extern", "for"):
            if self.take("for"):
                self.generics()
            self.take("unsafe")
            if self.take("extern") and self.t == STRING:
                self.next()
            if self.take("fn"):
                self.need("(")
                self.listed(self.fn_type_parameter, ")")
                if self.take("->"):
                    self.type()
            else:
                self.type_path()
        elif t == LIFETIME:
            self.next()
        else:
            self.type_path()
            if self.take("!"):
                self.tree()

    def fn_type_parameter(self) -> None:
        if self.t == NAME and self.peek() == ":":
            self.next()
            self.next()
        self.type()

    def type_path(self) -> None:
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.type()
            self.close_angle()
            self.need("::")
        self.take("::")
        while True:
            if self.t not in self.PATH:
                self.fail("type expected")
            self.next()
            if self.at("::") and self.peek() == "<":
                self.next()
            if self.at("<"):
                self.generic_arguments()
            elif self.at("(") :
                self.next()
                self.listed(self.type, ")")
                if self.take("->"):
                    self.type()
            if not self.take("::"):
                return

    def generic_arguments(self) -> None:
        self.need("<")
        while not self.at(">"):
            if self.t == LIFETIME or self.t in (NUMBER, STRING):
                self.next()
            elif self.at("{"):
                self.block()
            elif self.at("-"):
                self.next()
                self.next()
            elif self.t == NAME and self.peek() == "=":
                self.next()
                self.next()
                self.type()
            else:
                self.type()
                if self.take(":"):
                    self.bounds()
                elif self.take("="):
                    self.type()
            if not self.take(","):
                break
        self.close_angle()

    def path_plain(self) -> None:
        self.take("::")
        while True:
            if self.t not in self.PATH:
                self.fail("path expected")
            self.next()
            if not self.at("::"):
                return
            self.next()

    # statements
    def block(self) -> None:
        old, self.strict = self.strict, False
        self.need("{")
        self.items(self.statement, "}")
        self.next()
        self.strict = old

    BLOCKS = kinds("if match for while loop { unsafe")

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.at("#"):
            self.attributes()
        t = self.t
        if t == kind("let"):
            self.memo("let", self.upto(";"), self.let)
        elif t in self.ITEMS and not (self.at("unsafe", "async", "const") and self.peek() in ("{", kind("move"))):
            self.item()
        elif self.t == NAME and self.peek() == "!" and self.peek(2) == "{":
            self.next()
            self.next()
            self.tree()
            if self.at("."):
                self.after_block()
        elif t in self.BLOCKS or t == LIFETIME:
            p = self.p
            self.block_like()
            if self.at(".", "?"):
                self.back(p)
                self.expression()
                self.ended()
            else:
                self.take(";")
        else:
            self.memo("simple", self.upto(";"), self.simple)

    def after_block(self) -> None:
        self.postfix_rest()
        self.ended()

    def simple(self) -> None:
        self.expression()
        self.ended()

    def ended(self) -> None:
        if not self.take(";") and self.t != "}":
            self.fail("';' expected")

    def let(self) -> None:
        self.next()
        self.pattern_or()
        if self.take(":"):
            self.type()
        if self.take("="):
            self.expression()
            if self.take("else"):
                self.block()
        self.need(";")

    # patterns
    def pattern_or(self) -> None:
        self.take("|")
        self.pattern()
        while self.take("|"):
            self.pattern()

    def pattern(self) -> None:
        t = self.t
        if self.take("&") or self.take("&&"):
            self.take("mut")
            self.pattern()
        elif t == "(":
            self.next()
            self.listed(self.pattern_or, ")")
        elif t == "[":
            self.next()
            self.listed(self.pattern_or, "]")
        elif self.at("..", "..="):
            self.next()
            if self.t in (NUMBER, STRING, "-"):
                self.literal()
        elif t in (NUMBER, STRING, "-") or self.at("true", "false"):
            self.literal()
            self.range_rest()
        elif self.at("ref", "mut"):
            self.take("ref")
            self.take("mut")
            self.name()
            if self.take("@"):
                self.pattern()
        elif t in self.PATH or t == "<" or self.at("::"):
            self.path()
            if self.take("@"):
                self.pattern()
            elif self.take("("):
                self.listed(self.pattern_or, ")")
            elif self.at("{"):
                self.next()
                self.listed(self.field_pattern, "}")
            elif self.take("!"):
                self.tree()
            else:
                self.range_rest()
        elif self.at("const") and self.peek() == "{":
            self.next()
            self.block()
        else:
            self.fail("pattern expected")

    def range_rest(self) -> None:
        if self.at("..", "..=", "..."):
            self.next()
            if self.t in (NUMBER, STRING, "-"):
                self.literal()
            elif self.t in self.PATH:
                self.path()

    def literal(self) -> None:
        self.take("-")
        if self.t not in (NUMBER, STRING) and not self.at("true", "false"):
            self.fail("literal expected")
        self.next()

    def field_pattern(self) -> None:
        self.attributes()
        if self.take(".."):
            return
        self.take("ref")
        self.take("mut")
        if self.t == NUMBER:
            self.next()
        else:
            self.name()
        if self.take(":"):
            self.pattern_or()

    # expressions
    def loose(self, rule, *a):
        old, self.strict = self.strict, False
        result = rule(*a)
        self.strict = old
        return result

    def tight(self, rule, *a):
        old, self.strict = self.strict, True
        result = rule(*a)
        self.strict = old
        return result

    def expression(self) -> str:
        if self.at("..", "..="):
            self.next()
            if self.operand_follows():
                self.climb()
            return "range"
        what = self.climb()
        if self.at("..", "..="):
            closed = self.at("..=")
            self.next()
            if closed or self.operand_follows():
                self.climb()
            what = "range"
        if self.t in self.ASSIGN or self.t == ">" and self.peek() == kind(">="):
            if self.t == ">":
                self.next()
            self.next()
            self.expression()
            return "assignment"
        return what

    OPERANDS = kinds("- * ! & && ( [ | || self Self super crate :: < true false if match loop while for unsafe move async return break continue") | {NAME, NUMBER, STRING, LIFETIME}

    def operand_follows(self) -> bool:
        return self.t in self.OPERANDS or self.t == "{" and not self.strict

    def climb(self, least: int = 1) -> str:
        what = self.unary()
        while True:
            t = self.t
            if t == kind("as"):
                self.next()
                self.type_no_bounds()
                what = "cast"
                continue
            level, n = self.BINARY.get(t, 0), 1
            if t == ">" and self.peek() == ">":
                level, n = self.BINARY[kind("<<")], 2
            elif t == ">" and self.peek() == kind(">="):
                return what
            if not level or level < least:
                return what
            for _ in range(n):
                self.next()
            self.climb(level + 1)
            what = "binary"

    def type_no_bounds(self) -> None:
        self.type()

    def unary(self) -> str:
        if self.at("-", "!", "*"):
            self.next()
            return self.unary()
        if self.at("&", "&&"):
            self.next()
            self.take("mut")
            return self.unary()
        self.primary()
        return self.postfix_rest()

    def postfix_rest(self) -> str:
        what = "primary"
        while True:
            if self.take("?"):
                pass
            elif self.take("."):
                if self.take("await"):
                    pass
                elif self.t == NUMBER:
                    self.next()
                else:
                    self.name()
                    if self.at("::"):
                        self.next()
                        self.generic_arguments()
            elif self.take("("):
                self.loose(self.listed, self.argument, ")")
                what = "call"
            elif self.take("["):
                self.loose(self.expression)
                self.need("]")
            else:
                return what

    def argument(self) -> None:
        self.attributes()
        self.expression()

    def block_like(self) -> None:
        if self.t == LIFETIME:
            self.next()
            self.need(":")
        if self.at("if"):
            self.if_()
        elif self.at("match"):
            self.match()
        elif self.take("for"):
            self.memo("for", self.upto("{"), self.for_header)
            self.block()
        elif self.take("while"):
            self.memo("while", self.upto("{"), self.condition)
            self.block()
        elif self.take("loop"):
            self.block()
        else:
            self.take("unsafe")
            self.take("const")
            if self.take("async"):
                self.take("move")
            self.block()

    def for_header(self) -> None:
        self.pattern_or()
        self.need("in")
        self.tight(self.expression)

    def condition(self) -> None:
        self.tight(self.chain)

    def chain(self) -> None:
        while True:
            if self.take("let"):
                self.pattern_or()
                self.need("=")
                self.climb(3)
                if not self.take("&&"):
                    return
            else:
                self.expression()
                if not self.at("&&", "let"):
                    return
                self.take("&&")

    def if_(self) -> None:
        self.next()
        self.memo("if", self.upto("{"), self.condition)
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def match(self) -> None:
        self.next()
        self.memo("match", self.upto("{"), self.tight, self.expression)
        self.need("{")
        old, self.strict = self.strict, False
        self.items(self.arm, "}")
        self.next()
        self.strict = old

    def arm(self) -> None:
        self.memo("arm", self.upto(",", 2), self.one_arm)

    def one_arm(self) -> None:
        self.attributes()
        self.pattern_or()
        if self.take("if"):
            self.chain()
        self.need("=>")
        block = self.at("{")
        self.expression()
        if not self.take(",") and not block and not self.at("}"):
            self.fail("',' expected")

    def primary(self) -> None:
        t = self.t
        if t in (NUMBER, STRING) or self.at("true", "false"):
            self.next()
        elif t in self.PATH or t == "<" or self.at("::"):
            self.path()
            if self.at("!") and self.peek() in ("(", "[", "{"):
                self.next()
                self.tree()
            elif self.at("{") and not self.strict and self.struct_follows():
                self.next()
                self.loose(self.listed, self.field_value, "}")
        elif t == "(":
            self.next()
            self.loose(self.listed, self.argument, ")")
        elif t == "[":
            self.next()
            self.loose(self.array)
        elif t in self.BLOCKS or t == LIFETIME:
            self.loose(self.block_like) if not self.at("if", "match", "for", "while") else self.block_like()
        elif self.at("|", "||", "move", "static") or self.at("async") and self.peek() in ("|", kind("||"), kind("move")) and self.S[self.p + 2] in ("|", kind("||")):
            self.closure()
        elif self.at("async", "const"):
            self.block_like()
        elif self.at("return", "break"):
            self.next()
            if self.t == LIFETIME:
                self.next()
            if self.operand_follows():
                self.expression()
        elif self.take("continue"):
            if self.t == LIFETIME:
                self.next()
        elif self.at("let"):
            self.chain()
        else:
            self.fail("expression expected")

    def struct_follows(self) -> bool:
        a, b = self.peek(), self.peek(2)
        return a == "}" or a == kind("..") or a == "#" or a in (NAME, NUMBER) and b in (":", ",", "}")

    def field_value(self) -> None:
        self.attributes()
        if self.take(".."):
            self.expression()
            return
        if self.t == NUMBER:
            self.next()
        else:
            self.name()
        if self.take(":"):
            self.expression()

    def array(self) -> None:
        if self.take("]"):
            return
        self.expression()
        if self.take(";"):
            self.expression()
            self.need("]")
            return
        if self.take(","):
            self.listed(self.argument, "]")
        else:
            self.need("]")

    def closure(self) -> None:
        self.take("static")
        self.take("async")
        self.take("move")
        if not self.take("||"):
            self.need("|")
            while not self.at("|"):
                self.pattern()
                if self.take(":"):
                    self.type()
                if not self.take(","):
                    break
            self.need("|")
        if self.take("->"):
            self.type()
            self.block()
        else:
            self.expression()

    def path(self) -> None:
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.type()
            self.close_angle()
            if not self.at("::"):
                self.fail("'::' expected")
        self.take("::")
        while True:
            if self.t not in self.PATH:
                self.fail("name expected")
            self.next()
            if not self.at("::"):
                return
            self.next()
            if self.at("<"):
                self.generic_arguments()
                if not self.take("::"):
                    return


def parse(text: str):
    _, s = LEXER.lex(text.removeprefix("﻿"))
    return run(Rust(s)), LEXER
