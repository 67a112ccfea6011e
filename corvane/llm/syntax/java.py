"""Java."""

from __future__ import annotations

from .base import END, NAME, NUMBER, STRING, Lexer, Parser, kind, kinds, levels, run

_KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_SOFT = "var record sealed permits non yield when module"
_OPS = "++ -- && || == != <= >= << += -= *= /= %= &= |= ^= <<= -> :: ... + - * / % & | ^ ! ~ < > = ( ) [ ] { } , ; . : ? @"


class JavaLexer(Lexer):
    def word(self, token: str) -> str:
        return "B" if token[0] == "#" else NAME

    def other(self, token: str) -> str:
        c = token[0]
        if c in "\"'":
            return STRING if len(token) > 2 or token == '""' else "B"
        return NAME if c in "_$" else super().other(token)


LEXER = JavaLexer(
    r"(?:\s+|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|\x1a\Z)*+([^\W\d][\w$]*|\$[\w$]*|"
    r'"""[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?!"")(?:[^"\\\r\n]|\\.)*"|' + r"'(?:[^'\\\r\n]|\\(?:[btnfrs0\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'|"
    r"(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)|"
    r"<<=|\.\.\.|->|::|\+\+|--|&&|\|\||<<|[=!<>+\-*/%&|^]=|\S|\Z)",
    f"{_KEYWORDS} {_SOFT} {_OPS}",
)


class Java(Parser):
    MEMO: dict = {}
    NAMES = frozenset(NAME) | kinds(_SOFT)
    STARTS = kinds("if for while do switch try return throw break continue public private protected static final abstract class interface enum import synchronized")
    PRIMITIVE = kinds("boolean byte short int long char float double")
    BINARY = levels("||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %")
    ASSIGN = kinds("= += -= *= /= %= &= |= ^= <<=")
    MODIFIERS = kinds("public protected private static final abstract native synchronized transient volatile strictfp default sealed")

    def program(self) -> None:
        p = self.p
        if self.at("@"):
            self.attempt(self.modifiers)
            if not self.at("package"):
                self.back(p)
        if self.at("package"):
            self.guarded(self.package)
        while self.t != END:
            if self.t == "}":
                self.faults.append((self.p, "unmatched '}'"))
                self.next()
            elif self.take(";"):
                pass
            else:
                self.guarded(self.top)

    def package(self) -> None:
        self.next()
        self.qualified()
        self.need(";")

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def top(self) -> None:
        if self.take("import"):
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
            return
        self.modifiers()
        if not self.type_declaration():
            self.fail("class, interface, enum or record expected")

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek() != kind("interface"):
                self.annotation()
            elif self.t in self.MODIFIERS:
                if self.at("default") and self.peek() in (":", kind("->")):
                    return
                if self.at("sealed") and self.peek() not in kinds("class interface abstract public static"):
                    return
                self.next()
            elif self.at("non") and self.peek() == "-":
                self.next()
                self.next()
                self.need("sealed")
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            if not self.take(")"):
                if self.t in self.NAMES and self.peek() == "=":
                    self.listed(self.pair, ")", trailing=False)
                else:
                    self.element()
                    self.need(")")

    def pair(self) -> None:
        self.name()
        self.need("=")
        self.element()

    def element(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.take("{"):
            self.listed(self.element, "}")
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        if self.take("class"):
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.type()
            self.types("implements")
            self.types("permits")
            self.class_body()
        elif self.take("interface"):
            self.name()
            self.type_parameters()
            self.types("extends")
            self.types("permits")
            self.class_body()
        elif self.take("enum"):
            self.name()
            self.types("implements")
            self.need("{")
            while not self.at("}", ";"):
                self.enum_constant()
                if not self.take(","):
                    break
            if self.take(";"):
                self.items(self.member, "}")
            self.need("}")
        elif self.at("record") and self.peek() in self.NAMES and self.peek(2) in ("(", "<"):
            self.next()
            self.name()
            self.type_parameters()
            self.need("(")
            self.listed(self.parameter, ")", trailing=False)
            self.types("implements")
            self.class_body()
        elif self.at("@"):
            self.next()
            self.need("interface")
            self.name()
            self.class_body()
        else:
            return False
        return True

    def enum_constant(self) -> None:
        self.modifiers()
        self.name()
        if self.take("("):
            self.listed(self.expression, ")", trailing=False)
        if self.at("{"):
            self.class_body()

    def types(self, word: str) -> None:
        if self.take(word):
            self.type()
            while self.take(","):
                self.type()

    def class_body(self) -> None:
        self.need("{")
        self.items(self.member, "}")
        self.next()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("{") or self.at("static") and self.peek() == "{":
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.t in self.NAMES and self.peek() == "(":
            self.next()
            self.method_rest()
        elif self.t in self.NAMES and self.peek() == "{":
            self.next()
            self.block()
        else:
            if not self.take("void"):
                self.type()
            self.name()
            if self.at("("):
                self.method_rest()
            else:
                self.memo("field", self.upto(";"), self.declarators)

    def declarators(self) -> None:
        self.declarator()
        while self.take(","):
            self.name()
            self.declarator()
        self.need(";")

    def declarator(self) -> None:
        self.dimensions()
        if self.take("="):
            self.initializer()

    def dimensions(self) -> None:
        while True:
            while self.at("@"):
                self.annotation()
            if not (self.at("[") and self.peek() == "]"):
                return
            self.next()
            self.next()

    def initializer(self) -> None:
        if self.take("{"):
            self.listed(self.initializer, "}")
        else:
            self.expression()

    def method_rest(self) -> None:
        self.memo("parameters", self.upto("{"), self.parameters)
        if self.take("default"):
            self.element()
        if not self.take(";"):
            self.block()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)
        self.dimensions()
        self.types("throws")

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        while self.at("@"):
            self.annotation()
        self.take("...")
        if self.take("this"):
            return
        self.name()
        if self.take("."):
            self.need("this")
        self.dimensions()

    def type_parameters(self) -> None:
        if self.take("<"):
            self.listed(self.type_parameter, ">", trailing=False)

    def type_parameter(self) -> None:
        while self.at("@"):
            self.annotation()
        self.name()
        if self.take("extends"):
            self.type()
            while self.take("&"):
                self.type()

    def type(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.t in self.PRIMITIVE:
            self.next()
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.type_arguments()
                if not (self.at(".") and (self.peek() in self.NAMES or self.peek() == "@")):
                    break
                self.next()
                while self.at("@"):
                    self.annotation()
        self.dimensions()

    def type_arguments(self) -> None:
        self.need("<")
        self.listed(self.type_argument, ">", trailing=False)

    def type_argument(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.take("?"):
            if self.at("extends", "super"):
                self.next()
                self.type()
        else:
            self.type()

    # statements
    def block(self) -> None:
        self.need("{")
        self.items(self.statement, "}")
        self.next()

    def statement(self) -> None:
        rule = self.TABLE.get(self.t)
        if rule is not None:
            getattr(self, rule)()
        else:
            self.memo("simple", self.upto(";"), self.simple)

    def s_block(self) -> None:
        self.block()

    def s_empty(self) -> None:
        self.next()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def headed(self) -> None:
        self.next()
        self.memo("condition", self.upto("{"), self.condition)

    def body(self) -> None:
        p = self.p
        if self.t in self.NAMES or self.t in self.PRIMITIVE or self.at("final"):
            if self.attempt(self.local):
                self.back(p)
                self.fail("a declaration can't stand alone here")
        self.statement()

    def s_if(self) -> None:
        self.headed()
        self.body()
        if self.take("else"):
            self.body()

    def s_while(self) -> None:
        self.headed()
        self.body()

    def s_do(self) -> None:
        self.next()
        self.body()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.next()
        self.memo("for", self.upto("{"), self.for_header)
        self.body()

    def for_header(self) -> None:
        self.need("(")
        if self.attempt(self.for_each):
            return
        if not self.take(";"):
            if not self.attempt(self.local):
                self.expression()
                while self.take(","):
                    self.expression()
                self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")

    def for_each(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need(":")
        self.expression()
        self.need(")")

    def s_try(self) -> None:
        self.next()
        resources = self.take("(")
        if resources:
            while not self.at(")"):
                if not self.attempt(self.resource):
                    self.expression()
                if not self.take(";"):
                    break
            self.need(")")
        self.block()
        handlers = 0
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
            handlers += 1
        if self.take("finally"):
            self.block()
        elif not handlers and not resources:
            self.fail("catch or finally expected")

    def resource(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need("=")
        self.expression()

    def s_switch(self) -> None:
        self.switch()
        if self.at("."):
            self.postfix("value")
            self.need(";")

    def switch(self) -> None:
        self.headed()
        self.need("{")
        while not self.at("}"):
            if self.take("default"):
                pass
            elif self.take("case"):
                while True:
                    self.label()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            else:
                self.fail("'case' expected")
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    if self.t == END:
                        self.fail("'}' expected")
                    self.guarded(self.statement)
        self.next()

    def label(self) -> None:
        if self.take("default"):
            return
        if self.attempt(self.pattern):
            return
        self.ternary()

    def pattern(self) -> bool:
        self.modifiers()
        self.type()
        if self.take("("):
            self.listed(self.pattern, ")", trailing=False)
            if self.t in self.NAMES and not self.at("when"):
                self.next()
            return True
        self.name()
        return True

    def s_synchronized(self) -> None:
        self.next()
        self.condition()
        self.block()

    def s_declaration(self) -> None:
        self.modifiers()
        if not self.type_declaration():
            self.rest_of_local()

    def s_out_of_place(self) -> None:
        self.fail("statement expected")

    TABLE = {kind(w): f for ws, f in (("{", "s_block"), (";", "s_empty"), ("if", "s_if"), ("while", "s_while"), ("do", "s_do"), ("for", "s_for"), ("try", "s_try"), ("switch", "s_switch"), ("synchronized", "s_synchronized"), ("class interface enum abstract final static @", "s_declaration"), ("else case catch finally", "s_out_of_place")) for w in ws.split()}

    def simple(self) -> None:
        if self.at("record", "sealed") and self.peek() in self.NAMES | kinds("class interface") and (self.at("sealed") or self.peek(2) in ("(", "<")):
            self.modifiers()
            self.type_declaration()
            return
        if self.take("return"):
            if not self.at(";"):
                self.expression()
        elif self.take("throw"):
            self.expression()
        elif self.at("break", "continue"):
            self.next()
            if self.t in self.NAMES:
                self.next()
        elif self.take("assert"):
            self.expression()
            if self.take(":"):
                self.expression()
        elif self.at("yield") and self.peek() not in ("=", ".", "(", "[", kind("++"), kind("--")) :
            self.next()
            self.expression()
        elif self.t in self.NAMES and self.peek() == ":":
            self.next()
            self.next()
            self.statement()
            return
        elif (self.t in self.NAMES or self.t in self.PRIMITIVE) and self.attempt(self.local_head):
            self.declarators()
            return
        else:
            what = self.expression()
            if what not in ("assignment", "call", "update", "new"):
                self.fail("not a statement")
        self.need(";")

    def local_head(self) -> bool:
        self.type()
        self.name()
        return self.at("=", ",", ";", "[", ":")

    def local(self) -> None:
        self.modifiers()
        self.rest_of_local()

    def rest_of_local(self) -> None:
        self.type()
        self.name()
        self.declarators()

    # expressions
    def expression(self) -> str:
        if self.is_lambda():
            return self.lambda_()
        what = self.ternary()
        op = self.t in self.ASSIGN
        if not op and self.t == ">":
            n = 1
            while self.S[self.p + n] == ">":
                n += 1
            self.far = max(self.far, self.p + n)
            if n > 1 and self.S[self.p + n] == kind(">=") or self.peek() == kind(">="):
                self.p += n
                op = True
        if op:
            if what not in ("name", "field", "item"):
                self.fail("can't assign to what stands before")
            self.next()
            self.expression()
            return "assignment"
        return what

    def is_lambda(self) -> bool:
        if self.t in self.NAMES:
            return self.peek() == kind("->")
        if self.t == "(":
            close = self.closing()
            self.far = max(self.far, close + 1)
            return self.S[close + 1] == kind("->")
        return False

    def lambda_(self) -> str:
        if self.t in self.NAMES:
            self.next()
        else:
            self.next()
            if self.t in self.NAMES and self.peek() in (",", ")"):
                self.listed(self.name, ")", trailing=False)
            else:
                self.listed(self.parameter, ")", trailing=False)
        self.need("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return "lambda"

    def ternary(self) -> str:
        what = self.climb()
        if self.take("?"):
            self.expression()
            self.need(":")
            self.lambda_() if self.is_lambda() else self.ternary()
            return "ternary"
        return what

    def climb(self, least: int = 1) -> str:
        what = self.unary()
        while True:
            t, n = self.t, 1
            level = self.BINARY.get(t, 0)
            if t == ">":
                while n < 3 and self.S[self.p + n] == ">":
                    n += 1
                self.far = max(self.far, self.p + n)
                if self.S[self.p + n] == kind(">=") :
                    return what
                if n > 1:
                    level = self.BINARY[kind("<<")]
            if not level or level < least:
                return what
            for _ in range(n):
                self.next()
            if t == kind("instanceof"):
                self.take("final")
                if not self.attempt(self.pattern):
                    self.type()
            else:
                self.climb(level + 1)
            what = "binary"

    def unary(self) -> str:
        if self.at("++", "--"):
            self.next()
            if self.unary() not in ("name", "field", "item"):
                self.fail("a variable expected")
            return "update"
        if self.at("+", "-", "!", "~"):
            self.next()
            self.unary()
            return "unary"
        if self.t == "(" and self.attempt(self.cast):
            return "cast"
        what = self.postfix(self.primary())
        if self.at("++", "--"):
            if what not in ("name", "field", "item"):
                self.fail("a variable expected")
            self.next()
            return "update"
        return what

    OPERANDS = kinds("! ~ ( this super new switch true false null void boolean byte short int long char float double") | kinds(_SOFT) | {NAME, NUMBER, STRING}

    def cast(self) -> bool:
        self.next()
        primitive = self.t in self.PRIMITIVE
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        if self.is_lambda():
            self.lambda_()
            return True
        if not primitive and self.t not in self.OPERANDS:
            return False
        self.unary()
        return True

    def primary(self) -> str:
        t = self.t
        if t in (NUMBER, STRING) or self.at("true", "false", "null"):
            self.next()
            return "literal"
        if t == "(":
            self.next()
            what = self.expression()
            self.need(")")
            return what if what in ("name", "field", "item") else "group"
        if self.take("this"):
            if self.at("("):
                return self.call()
            return "value"
        if self.take("super"):
            if self.at("("):
                return self.call()
            if not self.at(".", "::"):
                self.fail("'.' expected")
            return "value"
        if self.take("new"):
            return self.new()
        if self.at("switch"):
            self.switch()
            return "value"
        if t in self.NAMES:
            if self.peek() in ("<", "[") and self.attempt(self.type_reference):
                return "value"
            self.next()
            if self.at("("):
                return self.call()
            return "name"
        if t in self.PRIMITIVE or self.at("void"):
            self.next()
            self.dimensions()
            if self.at("::"):
                return "value"
            self.need(".")
            self.need("class")
            return "value"
        if self.at("@"):
            self.annotation()
            return self.primary()
        self.fail("expression expected")

    def type_reference(self) -> bool:
        self.type()
        if self.at("."):
            self.next()
            return self.take("class")
        return self.at("::")

    def call(self) -> str:
        self.need("(")
        self.listed(self.expression, ")", trailing=False)
        return "call"

    def postfix(self, what: str) -> str:
        while True:
            if self.take("."):
                if self.at("<"):
                    self.type_arguments()
                if self.take("new"):
                    what = self.new()
                elif self.take("class") or self.take("this"):
                    what = "value"
                elif self.take("super"):
                    what = self.call() if self.at("(") else "value"
                else:
                    self.name()
                    what = self.call() if self.at("(") else "field"
            elif self.at("["):
                self.next()
                self.expression()
                self.need("]")
                what = "item"
            elif self.take("::"):
                if self.at("<"):
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
                what = "reference"
            else:
                return what

    def new(self) -> str:
        while self.at("@"):
            self.annotation()
        if self.at("<"):
            self.type_arguments()
        if self.t in self.PRIMITIVE:
            self.next()
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.next()
                    if not self.take(">"):
                        self.listed(self.type_argument, ">", trailing=False)
                if not self.take("."):
                    break
        if self.at("["):
            sized = False
            while self.at("["):
                self.next()
                if self.take("]"):
                    continue
                self.expression()
                self.need("]")
                sized = True
            if self.at("{"):
                if sized:
                    self.fail("sizes and values exclude each other")
                self.initializer()
            elif not sized:
                self.fail("size expected")
            return "array"
        self.call()
        if self.at("{"):
            self.class_body()
        return "new"


def parse(text: str):
    _, s = LEXER.lex(text.removeprefix("﻿"))
    return run(Java(s)), LEXER
