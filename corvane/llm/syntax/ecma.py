"""JavaScript modules, and TypeScript."""

from __future__ import annotations

import re

from .base import END, NAME, NUMBER, REGEX, STRING, TEMPLATE, Lexer, Parser, SyntaxFault, kind, kinds, levels, run, deeply

_PLAIN = r"(?:[^`\\$]|\\[\s\S]|\$(?!\{)"
_TEMPLATE = r"`" + _PLAIN + r"|\$\{(?:[^`{}]|\{[^`{}]*\})*\})*`"
for _ in range(2):  # templates in templates
    _TEMPLATE = r"`" + _PLAIN + r"|\$\{(?:[^`{}]|\{(?:[^`{}]|" + _TEMPLATE + r")*\}|" + _TEMPLATE + r")*\})*`"
_REGEX = r"/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?![\w$])"
_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum null true false await yield let static"
_SOFT = "async of get set from as target meta"
_TS = "type interface namespace module declare abstract readonly public private protected override implements keyof unique infer is asserts satisfies out accessor global"
_OPS = "=> ... ++ -- == === != !== <= >= && || ?? ?. ** << += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #"


class EcmaLexer(Lexer):
    def word(self, token: str) -> str:
        return NAME if token[0] != "#" or len(token) > 1 else "#"

    def other(self, token: str) -> str:
        c = token[0]
        if c == "`":
            return TEMPLATE if len(token) > 1 else "B"
        if c in "\"'":
            return STRING if len(token) > 1 else "B"
        if c == "\n":
            return "\n"
        if c.isdigit() or c == "." and token[1:2].isdigit():
            return NUMBER
        if c == "/" and len(token) > 1:
            return REGEX
        return "B"


def _lexer(words: str) -> EcmaLexer:
    # a regular expression is one where no operand stands before it
    return EcmaLexer(
        rf"(?:[ \t\r\f\v  ﻿]+|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|\A\#![^\n]*)*+(\n(?:\s+|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+|[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*|"
        r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|" + _TEMPLATE + "|"
        r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])|"
        rf"{_REGEX}|"
        r"\.\.\.|=>|===|!==|==|!=|<<=|\*\*=|\?\?=|&&=|\|\|=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|[+\-*/%&|^]=|[^ \t\r]|\Z)",
        f"{words} {_OPS}",
    )


JS, TS = _lexer(f"{_RESERVED} {_SOFT}"), _lexer(f"{_RESERVED} {_SOFT} {_TS}")
_OPERAND_ENDS = frozenset(NAME + NUMBER + STRING + TEMPLATE + REGEX + ")]}") | kinds("this super null true false ++ --") | kinds(_SOFT) | kinds(_TS)


def _lex(lexer: EcmaLexer, text: str) -> tuple[list[str], str]:
    tokens, s = lexer.lex(text)
    if REGEX in s and _SUSPECT.search(s):
        tokens, s = _relex(lexer, text)
    return tokens, s


_SUSPECT = re.compile("[" + re.escape("".join(_OPERAND_ENDS)) + "]\n?" + REGEX)


def _relex(lexer: EcmaLexer, text: str) -> tuple[list[str], str]:
    """Where a division looks like a regular expression: decided token by token."""
    tokens, kinds_, p, match = [], [], 0, lexer.re.match
    while p < len(text):
        m = match(text, p)
        if m is None or not m[1]:
            break
        token, k, p = m[1], lexer[m[1]], m.end()
        if k == REGEX and (last := next((x for x in reversed(kinds_) if x != "\n"), "")) in _OPERAND_ENDS and not (last == "}" and kinds_[-1] == "\n"):
            token = "/=" if token[1] == "=" else "/"
            k, p = kind(token), m.start(1) + len(token)
        tokens.append(token)
        kinds_.append(k)
    return tokens, "".join(kinds_)


class Ecma(Parser):
    MEMO: dict = {}
    ts = False
    NAMES = frozenset(NAME) | kinds(_SOFT) | kinds("let static yield await") - kinds("await yield")
    WORDS = NAMES | kinds(_RESERVED)
    STARTS = kinds("if for while do switch try return throw var let const function class import export break continue debugger")
    BINARY = levels("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in as satisfies", "<< >> >>>", "+ -", "* / %", "**")
    RIGHT = kinds("**")
    ASSIGN = kinds("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")

    # newlines stay in the string of kinds; the parser stands on other tokens only
    def __init__(self, s: str):
        super().__init__(s)
        if self.S[0] == "\n":
            self.p = 1

    def next(self) -> str:
        t = self.S[self.p]
        self.p += 1
        if self.S[self.p] == "\n":
            self.p += 1
        return t

    def peek(self, n: int = 1) -> str:
        q = self.p
        for _ in range(n):
            q += 1
            if q < len(self.S) and self.S[q] == "\n":
                q += 1
        q = min(q, len(self.S) - 1)
        self.far = max(self.far, q)
        return self.S[q]

    @property
    def nl(self) -> bool:
        return self.p > 0 and self.S[self.p - 1] == "\n"

    def peek_nl(self) -> bool:
        self.far = max(self.far, self.p + 1)
        return self.S[self.p + 1] == "\n"

    def semicolon(self) -> None:
        if self.take(";") or self.t in ("}", END) or self.nl:
            return
        self.fail("';' expected")

    def program(self) -> None:
        while self.t != END:
            if self.t == "}":
                self.faults.append((self.p, "unmatched '}'"))
                self.next()
            else:
                self.guarded(self.module_item)

    def module_item(self) -> None:
        if self.at("import") and self.peek() not in ("(", "."):
            self.memo("import", self.upto(";"), self.import_)
        elif self.at("export"):
            self.next()
            self.export()
        else:
            self.statement()

    def import_(self) -> None:
        self.next()
        if self.t == STRING:
            self.next()
            self.semicolon()
            return
        if self.ts and self.at("type") and (self.peek() in ("{", "*") or self.peek() in self.NAMES and self.peek() != kind("from") or self.peek() == kind("from") and self.peek(2) == kind("from")):
            self.next()
        more = True
        if self.t in self.NAMES:
            self.next()
            if self.ts and self.take("="):
                self.assign()
                self.semicolon()
                return
            more = self.take(",")
        if more:
            if self.take("*"):
                self.need("as")
                self.name()
            else:
                self.need("{")
                self.listed(self.specifier, "}")
        self.need("from")
        self.string()
        self.attributes()
        self.semicolon()

    def string(self) -> None:
        if self.t != STRING:
            self.fail("string expected")
        self.next()

    def attributes(self) -> None:
        if self.at("with") and not self.nl:
            self.next()
            self.need("{")
            self.object_rest()

    def specifier(self) -> None:
        if self.ts and self.at("type") and self.peek() in self.WORDS and self.peek() != kind("as"):
            self.next()
        if self.t == STRING or self.t in self.WORDS:
            self.next()
        else:
            self.fail("name expected")
        if self.take("as"):
            if self.t == STRING or self.t in self.WORDS:
                self.next()
            else:
                self.fail("name expected")

    def export(self) -> None:
        if self.ts and self.at("type") and self.peek() in ("{", "*"):
            self.next()
        if self.take("*"):
            if self.take("as"):
                self.next()
            self.need("from")
            self.string()
            self.attributes()
            self.semicolon()
        elif self.take("{"):
            self.listed(self.specifier, "}")
            if self.take("from"):
                self.string()
                self.attributes()
            self.semicolon()
        elif self.take("default"):
            if self.at("function") or self.at("async") and self.peek() == kind("function"):
                self.take("async")
                self.function(named=False)
            elif self.at("class", "@"):
                self.decorators()
                self.class_(named=False)
            elif self.ts and self.at("abstract", "interface") and self.peek() not in (".", "(", ";"):
                self.declaration()
            else:
                self.assign()
                self.semicolon()
        elif self.ts and self.take("="):
            self.assign()
            self.semicolon()
        elif self.at("var", "let", "const", "function", "class", "@") or self.at("async") or self.ts and self.at("type", "interface", "enum", "namespace", "module", "declare", "abstract", "import"):
            self.declaration()
        else:
            self.fail("declaration expected")

    def declaration(self) -> None:
        p = self.p
        self.statement()
        if self.S[p] == kind("async") and p == self.p:
            self.fail("declaration expected")

    def block(self) -> None:
        self.need("{")
        self.items(self.statement, "}")
        self.next()

    def end_of_simple(self) -> int:
        """Where a simple statement may end: after the first ';' or, without one, the line, and the token after."""
        i = self.S.find(";", self.p)
        return min(len(self.S), (i if i >= 0 else len(self.S)) + 3)

    def statement(self) -> None:
        t = self.t
        rule = self.TABLE.get(t)
        if rule is not None:
            getattr(self, rule)()
        else:
            self.memo("simple", self.end_of_simple(), self.simple)

    def s_block(self) -> None:
        self.block()

    def s_empty(self) -> None:
        self.next()

    def s_var(self) -> None:
        if self.at("let") and not (self.peek() in self.NAMES or self.peek() in "[{"):
            self.simple()
        elif self.ts and self.at("const") and self.peek() == kind("enum"):
            self.next()
            self.enum()
        else:
            self.memo("var", self.end_of_simple(), self.variables, True)

    def variables(self, statement: bool) -> None:
        const = self.at("const")
        self.next()
        while True:
            pattern = self.at("[", "{")
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assign()
            elif statement and (pattern or const) and not (self.ts and self.ctx == "d"):
                self.fail("'=' expected")
            if not self.take(","):
                break
        if statement:
            self.semicolon()

    def binding(self) -> None:
        if self.take("["):
            while not self.at("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding_default()
                if rest or not self.take(","):
                    break
            self.need("]")
        elif self.take("{"):
            self.listed(self.binding_property, "}")
        else:
            self.name()

    def binding_default(self) -> None:
        self.binding()
        if self.take("="):
            self.assign()

    def binding_property(self) -> None:
        if self.take("..."):
            self.name()
            return
        plain = self.t in self.NAMES
        self.property_name()
        if self.take(":"):
            self.binding_default()
        elif not plain:
            self.fail("':' expected")
        elif self.take("="):
            self.assign()

    def property_name(self) -> None:
        if self.take("["):
            self.assign()
            self.need("]")
        elif self.t in self.WORDS or self.t in (STRING, NUMBER):
            self.next()
        else:
            self.fail("property expected")

    def header(self, name: str, rule) -> None:
        self.memo(name, self.upto("{", 2), rule)

    def condition(self) -> None:
        self.next()
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.header("if", self.condition)
        self.body()
        if self.take("else"):
            self.body()

    def body(self) -> None:
        if self.at("const", "class", "import", "export") or self.at("let") and self.peek() in self.NAMES:
            self.fail("a declaration can't stand alone here")
        self.statement()

    def s_while(self) -> None:
        self.header("while", self.condition)
        self.loop()

    def loop(self) -> None:
        old, self.ctx = self.ctx, self.ctx + "l" * ("l" not in self.ctx)
        self.body()
        self.ctx = old

    def s_do(self) -> None:
        self.next()
        self.loop()
        if not self.at("while"):
            self.fail("'while' expected")
        self.condition()
        self.take(";")

    def s_for(self) -> None:
        self.header("for", self.for_header)
        self.loop()

    def for_header(self) -> None:
        self.next()
        self.take("await")
        self.need("(")
        if self.take(";"):
            return self.for_rest()
        if self.at("var", "const") or self.at("let") and (self.peek() in self.NAMES or self.peek() in "[{"):
            self.no_in += 1
            try:
                self.variables(False)
            finally:
                self.no_in -= 1
        else:
            self.no_in += 1
            try:
                self.expression()
            finally:
                self.no_in -= 1
        if self.take("of"):
            self.assign()
            self.need(")")
        elif self.take("in"):
            self.expression()
            self.need(")")
        else:
            self.need(";")
            self.for_rest()

    no_in = 0

    def for_rest(self) -> None:
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")

    def s_switch(self) -> None:
        self.header("switch", self.condition)
        self.need("{")
        old, self.ctx = self.ctx, self.ctx + "l" * ("l" not in self.ctx)
        seen = False
        while not self.at("}"):
            if self.take("case"):
                self.memo("case", self.upto(":"), self.expression)
            elif self.take("default"):
                if seen:
                    self.fail("a second default")
                seen = True
            else:
                self.fail("'case' expected")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.t == END:
                    self.fail("'}' expected")
                self.guarded(self.statement)
        self.next()
        self.ctx = old

    def s_try(self) -> None:
        self.next()
        self.block()
        if self.take("catch"):
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
            if self.take("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def s_function(self) -> None:
        self.function(named=True)

    def s_async(self) -> None:
        if self.peek() == kind("function") and not self.peek_nl():
            self.next()
            self.function(named=True)
        else:
            self.memo("simple", self.end_of_simple(), self.simple)

    def s_class(self) -> None:
        self.decorators()
        if self.ts and self.take("abstract"):
            pass
        if self.at("export"):
            return self.module_item()
        self.class_(named=True)

    def s_import(self) -> None:
        if self.peek() in ("(", "."):
            self.simple()
        else:
            self.fail("import is out of place")

    def s_out_of_place(self) -> None:
        self.fail("statement expected")

    TABLE = {kind(w): f for ws, f in (("{", "s_block"), (";", "s_empty"), ("var let const", "s_var"), ("if", "s_if"), ("while", "s_while"), ("do", "s_do"), ("for", "s_for"), ("switch", "s_switch"), ("try", "s_try"), ("function", "s_function"), ("async", "s_async"), ("class @", "s_class"), ("import", "s_import"), ("else case default catch finally", "s_out_of_place")) for w in ws.split()}

    def simple(self) -> None:
        t = self.t
        if t == kind("return"):
            if "f" not in self.ctx:
                self.fail("return outside of a function")
            restricted = self.peek_nl()
            self.next()
            if not restricted and self.t not in (";", "}", END):
                self.expression()
        elif t == kind("throw"):
            if self.peek_nl():
                self.fail("a line end after throw")
            self.next()
            self.expression()
        elif t in (kind("break"), kind("continue")):
            restricted = self.peek_nl()
            self.next()
            if not restricted and self.t in self.NAMES:
                self.next()
            elif "l" not in self.ctx:
                self.fail("outside of a loop")
        elif t == kind("debugger"):
            self.next()
        elif t in self.NAMES and self.peek() == ":":
            self.next()
            self.next()
            self.loop()
            return
        else:
            self.expression()
        self.semicolon()

    # functions and classes
    def function(self, named: bool) -> None:
        self.need("function")
        star = self.take("*")
        if named or self.t in self.NAMES:
            self.name()
        self.header("parameters", self.signature)
        self.function_body("s" if star else "")

    def signature(self) -> None:
        if self.ts and self.at("<"):
            self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.ts and self.take(":"):
            self.return_type()

    def parameter(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.ts:
            while self.at("public", "private", "protected", "readonly", "override") and (self.peek() in self.NAMES or self.peek() in "[{"):
                self.next()
            if self.at("this"):
                self.next()
                if self.take(":"):
                    self.type()
                return
        rest = self.take("...")
        self.binding()
        if self.ts:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.at("="):
            if rest:
                self.fail("a rest parameter has no default")
            self.next()
            self.assign()
        if rest and self.at(","):
            self.fail("a rest parameter must be last")

    def function_body(self, more: str = "") -> None:
        if self.ts and not self.at("{"):
            return self.semicolon()  # an overload
        old, self.ctx = self.ctx, "f"
        no_in, self.no_in = self.no_in, 0
        self.block()
        self.ctx, self.no_in = old, no_in

    def decorators(self) -> None:
        while self.at("@"):
            self.decorator()

    def decorator(self) -> None:
        self.next()
        if self.take("("):
            self.expression()
            self.need(")")
            return
        self.name()
        while self.take("."):
            self.property_name()
        if self.ts and self.at("<"):
            self.attempt(self.type_arguments)
        if self.take("("):
            self.arguments()

    def class_(self, named: bool) -> None:
        self.need("class")
        if named or self.t in self.NAMES and not (self.ts and self.at("implements")):
            self.name()
        if self.ts and self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.ts and self.at("<"):
                self.type_arguments()
        if self.ts and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        self.items(self.member, "}")
        self.next()

    MODIFIERS = kinds("static async get set public private protected readonly abstract override declare accessor")

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        p = self.p
        if self.at("static") and self.peek() == "{":
            self.next()
            old, self.ctx = self.ctx, ""
            self.block()
            self.ctx = old
            return
        abstract = False
        while self.t in self.MODIFIERS and (self.ts or not self.at("public", "private", "protected", "readonly", "abstract", "override", "declare")):
            n = self.peek()
            if n in "(=;}?!:" or n == "<" or self.peek_nl() and not self.at("static", "public", "private", "protected"):
                break
            abstract = abstract or self.at("abstract", "declare")
            self.next()
        star = self.take("*")
        if self.ts and self.at("[") and self.attempt(self.index_signature):
            self.semicolon()
            return
        self.property_name()
        if self.ts:
            if self.at("?", "!"):
                self.next()
        if self.at("(") or self.ts and self.at("<"):
            self.header("parameters", self.signature)
            if abstract and not self.at("{"):
                self.semicolon()
            else:
                self.function_body("s" if star else "")
            return
        if star or p == self.p:
            self.fail("'(' expected")
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            old, self.ctx = self.ctx, ""
            self.assign()
            self.ctx = old
        self.semicolon()

    # expressions
    def expression(self) -> str:
        what = self.assign()
        while self.take(","):
            self.assign()
            what = "comma"
        return what

    def assign(self) -> str:
        if self.t in self.NAMES:
            n = self.peek()
            if n == kind("=>"):
                self.next()
                return self.arrow()
            if self.at("async") and not self.peek_nl():
                if n in self.NAMES and self.peek(2) == kind("=>"):
                    self.next()
                    self.next()
                    return self.arrow()
                if n == "(" or self.ts and n == "<":
                    p = self.p
                    self.next()
                    if self.is_arrow():
                        return self.arrow_head()
                    self.back(p)
        elif self.at("yield"):
            restricted = self.peek_nl()
            self.next()
            if not restricted and (self.take("*") or self.t not in ")]},;:" + END):
                self.assign()
            return "yield"
        elif self.t == "(" or self.ts and self.t == "<":
            if self.is_arrow():
                return self.arrow_head()
        p = self.p
        what = self.climb()
        if self.take("?"):
            no_in, self.no_in = self.no_in, 0
            self.assign()
            self.no_in = no_in
            self.need(":")
            self.assign()
            return "ternary"
        if self.t in self.ASSIGN or self.t == ">" and self.shift_assign():
            if what not in ("reference", "pattern") or what == "pattern" and not self.at("="):
                self.back(p + (self.p - p))
                self.fail("can't assign to what stands before")
            self.next()
            self.assign()
            return "assignment"
        return what

    def shift_assign(self) -> bool:
        for w in (">>>=", ">>="):
            if self.S.startswith(">" * (len(w) - 2) + kind(">="), self.p):
                self.p += len(w) - 2
                return True
        return False

    def is_arrow(self) -> bool:
        p = self.p
        if self.t == "<":
            if not self.attempt(self.type_parameters) or self.t != "(":
                self.back(p)
                return False
        close = self.closing()
        q = close + 1
        if self.S[q] == "\n":
            q += 1
        self.far = max(self.far, q)
        ok = self.S[q] == kind("=>")
        if not ok and self.ts and self.S[q] == ":":
            at = self.p
            self.p = q
            ok = self.attempt(self.arrow_type)
            self.far = max(self.far, self.p)
            self.p = at
        self.back(p)
        return ok

    def arrow_type(self) -> bool:
        self.need(":")
        self.return_type()
        return self.at("=>")

    def arrow_head(self) -> str:
        self.signature()
        return self.arrow()

    def arrow(self) -> str:
        if self.nl:
            self.fail("a line end before '=>'")
        self.need("=>")
        if self.at("{"):
            self.function_body()
        else:
            self.assign()
        return "arrow"

    def climb(self, least: int = 1) -> str:
        if self.t == NAME and self.S[self.p][:1] == "#":
            self.next()
        what = self.unary()
        while True:
            t = self.t
            level = self.BINARY.get(t, 0)
            if not level or self.no_in and t == kind("in"):
                return what
            if t == ">":
                n = 1
                while self.S[self.p + n] == ">":
                    n += 1
                self.far = max(self.far, self.p + n)
                if self.S[self.p + n] == kind(">=") and n < 3:
                    return what
                if n > 1:
                    level = self.BINARY[kind(">>")]
            else:
                n = 1
            if t in self.AS:
                if not self.ts or self.nl:
                    return what
            if level < least:
                return what
            for _ in range(min(n, 3)):
                self.next()
            if t in self.AS:
                if not self.take("const"):
                    self.type()
                what = "reference" if t == kind("as") else "binary"
                continue
            if t == kind("**"):
                if what == "unary":
                    self.fail("a unary operator before '**' needs parentheses")
                self.climb(level)
            else:
                self.climb(level + 1)
            what = "binary"

    AS = kinds("as satisfies")
    UNARY = kinds("delete void typeof + - ~ !")

    def unary(self) -> str:
        if self.t in self.UNARY:
            self.next()
            self.unary()
            return "unary"
        if self.at("await"):
            self.next()
            self.unary()
            return "unary"
        if self.at("++", "--"):
            self.next()
            if self.unary() != "reference":
                self.fail("a reference expected")
            return "update"
        if self.ts and self.at("<"):
            self.next()
            self.type()
            self.need(">")
            self.unary()
            return "unary"
        what = self.postfix()
        if self.at("++", "--") and not self.nl:
            if what != "reference":
                self.fail("a reference expected")
            self.next()
            return "update"
        return what

    def postfix(self) -> str:
        if self.at("new"):
            what = self.new()
        elif self.take("super"):
            if not self.at("(", ".", "["):
                self.fail("'super' out of place")
            what = "call"
        elif self.take("import"):
            if self.take("."):
                self.name()
            else:
                self.need("(")
                self.arguments()
            what = "call"
        else:
            what = self.primary()
        return self.tail(what, True)

    def tail(self, what: str, calls: bool) -> str:
        while True:
            t = self.t
            if t == ".":
                self.next()
                if self.t not in self.WORDS:
                    self.fail("property expected")
                self.next()
                what = "reference"
            elif t == "[":
                self.next()
                no_in, self.no_in = self.no_in, 0
                self.expression()
                self.no_in = no_in
                self.need("]")
                what = "reference"
            elif t == "(" and calls:
                self.next()
                self.arguments()
                what = "call"
            elif t == kind("?.") and calls:
                self.next()
                if self.take("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.t in self.WORDS:
                    self.next()
                else:
                    self.fail("property expected")
                what = "chain"
            elif t == TEMPLATE:
                self.next()
                what = "call"
            elif self.ts and t == "!" and not self.nl and self.peek() != "=":
                self.next()
            elif self.ts and t == "<" and self.attempt(self.call_types):
                continue
            else:
                return what

    def call_types(self) -> bool:
        self.type_arguments()
        return self.at("(") or self.t == TEMPLATE or self.t in ";,)]:" or self.nl

    def new(self) -> str:
        self.next()
        if self.take("."):
            self.need("target")
            return "call"
        if self.at("new"):
            self.new()
        else:
            self.tail(self.primary(), False)
        if self.take("("):
            self.arguments()
        return "call"

    def arguments(self) -> None:
        no_in, self.no_in = self.no_in, 0
        self.listed(self.argument, ")")
        self.no_in = no_in

    def argument(self) -> None:
        self.take("...")
        self.assign()

    LITERALS = kinds("null true false this") | frozenset(NUMBER + STRING + TEMPLATE + REGEX)

    def primary(self) -> str:
        t = self.t
        if t in self.NAMES:
            if self.at("async") and self.peek() == kind("function") and not self.peek_nl():
                self.next()
                self.function(named=False)
                return "function"
            self.next()
            return "reference"
        if t in self.LITERALS:
            self.next()
            return "literal"
        if t == "(":
            self.next()
            no_in, self.no_in = self.no_in, 0
            what = self.expression()
            self.no_in = no_in
            self.need(")")
            return what if what == "reference" else "group"
        if t == "[":
            self.next()
            no_in, self.no_in = self.no_in, 0
            while not self.at("]"):
                if self.take(","):
                    continue
                self.argument()
                if not self.take(","):
                    break
            self.no_in = no_in
            self.need("]")
            return "pattern"
        if t == "{":
            self.next()
            no_in, self.no_in = self.no_in, 0
            self.object_rest()
            self.no_in = no_in
            return "pattern"
        if self.at("function"):
            self.function(named=False)
            return "function"
        if self.at("class", "@"):
            self.decorators()
            self.class_(named=False)
            return "class"
        self.fail("expression expected")

    def object_rest(self) -> None:
        self.listed(self.property, "}")

    def property(self) -> None:
        if self.take("..."):
            self.assign()
            return
        accessor = False
        while self.at("async", "get", "set") and self.peek() not in ("(", ",", ":", "}", "=") and not (self.ts and self.peek() == "<"):
            accessor = True
            self.next()
        star = self.take("*")
        plain = self.t in self.NAMES and not star and not accessor
        self.property_name()
        if self.at("(") or self.ts and self.at("<"):
            self.signature()
            self.function_body()
        elif star or accessor:
            self.fail("'(' expected")
        elif self.take(":"):
            self.assign()
        elif not plain:
            self.fail("':' expected")
        elif self.take("="):
            self.assign()

    def type_parameters(self) -> None:
        self.fail("types are not part of JavaScript")

    type = return_type = type_arguments = index_signature = enum = type_parameters


class TypeScript(Ecma):
    MEMO: dict = {}
    ts = True
    NAMES = Ecma.NAMES | kinds(_TS)
    WORDS = Ecma.WORDS | kinds(_TS)
    STARTS = Ecma.STARTS | kinds("interface enum")
    TABLE = Ecma.TABLE | {kind(w): f for w, f in (("type", "s_type"), ("interface", "s_interface"), ("enum", "s_enum"), ("namespace", "s_namespace"), ("module", "s_namespace"), ("declare", "s_declare"), ("abstract", "s_abstract"))}

    def simple_memo(self) -> None:
        self.memo("simple", self.end_of_simple(), self.simple)

    def s_type(self) -> None:
        if self.peek() in self.NAMES and not self.peek_nl():
            self.memo("type", self.end_of_simple(), self.alias)
        else:
            self.simple_memo()

    def alias(self) -> None:
        self.next()
        self.name()
        if self.at("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()

    def s_interface(self) -> None:
        if self.peek() not in self.NAMES or self.peek_nl():
            return self.simple_memo()
        self.next()
        self.name()
        if self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        self.object_type()

    def s_enum(self) -> None:
        self.enum()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        self.listed(self.enumerator, "}")

    def enumerator(self) -> None:
        self.property_name()
        if self.take("="):
            self.assign()

    def s_namespace(self) -> None:
        if not (self.peek() in self.NAMES or self.peek() == STRING) or self.peek_nl():
            return self.simple_memo()
        self.next()
        self.next()
        while self.take("."):
            self.name()
        if self.ctx == "d" and not self.at("{"):
            return self.semicolon()
        self.need("{")
        self.items(self.module_item, "}")
        self.next()

    def s_declare(self) -> None:
        if self.peek() in self.WORDS and not self.peek_nl():
            self.next()
            old, self.ctx = self.ctx, "d"
            if self.at("global"):
                self.next()
                self.need("{")
                self.items(self.module_item, "}")
                self.next()
            else:
                self.statement()
            self.ctx = old
        else:
            self.simple_memo()

    def s_abstract(self) -> None:
        if self.peek() == kind("class"):
            self.next()
            self.class_(named=True)
        else:
            self.simple_memo()

    # types
    def type_parameters(self) -> None:
        self.need("<")
        if self.at(">"):
            self.fail("type parameter expected")
        self.listed(self.type_parameter, ">")

    def type_parameter(self) -> None:
        while self.at("const", "in", "out") and self.peek() in self.NAMES:
            self.next()
        self.name()
        if self.take("extends"):
            self.type()
        if self.take("="):
            self.type()

    def type_arguments(self) -> None:
        self.need("<")
        if self.at(">"):
            self.fail("type expected")
        self.listed(self.type, ">")

    def return_type(self) -> None:
        if self.at("asserts") and self.peek() in (self.NAMES | kinds("this")) and not self.peek_nl():
            self.next()
            self.next()
            if self.take("is"):
                self.type()
            return
        if (self.t in self.NAMES or self.at("this")) and self.peek() == kind("is"):
            self.next()
            self.next()
        self.type()

    def type(self) -> None:
        if self.at("<") or self.at("new") or self.at("abstract") and self.peek() == kind("new"):
            self.take("abstract")
            self.take("new")
            self.function_type()
            return
        if self.at("(") and self.attempt(self.function_type):
            return
        self.union()
        if self.at("extends") and not self.nl:
            self.next()
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        self.take("|")
        while True:
            self.take("&")
            self.prefix_type()
            while self.take("&"):
                self.prefix_type()
            if not self.take("|"):
                return

    def prefix_type(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and (self.peek() in self.WORDS or self.peek() in "({["):
            infer = self.at("infer")
            self.next()
            if infer:
                self.name()
                return
        self.primary_type()
        while not self.nl and self.take("["):
            if not self.at("]"):
                self.type()
            self.need("]")

    def primary_type(self) -> None:
        t = self.t
        if t in (STRING, NUMBER, TEMPLATE) or self.at("null", "true", "false", "void"):
            self.next()
        elif t == "-" and self.peek() == NUMBER:
            self.next()
            self.next()
        elif t == "(":
            self.next()
            self.type()
            self.need(")")
        elif t == "[":
            self.next()
            self.listed(self.tuple_item, "]")
        elif t == "{":
            self.next()
            self.object_type()
        elif self.take("typeof"):
            if self.take("import"):
                self.need("(")
                self.string()
                self.need(")")
            else:
                self.property_name()
            self.type_name_rest()
        elif self.take("import"):
            self.need("(")
            self.string()
            self.need(")")
            self.type_name_rest()
        elif t in self.NAMES or self.at("this"):
            self.next()
            self.type_name_rest()
        else:
            self.fail("type expected")

    def type_name_rest(self) -> None:
        while self.take("."):
            self.property_name()
        if self.at("<") and not self.nl:
            self.type_arguments()

    def tuple_item(self) -> None:
        self.take("...")
        if self.t in self.NAMES and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
            self.next()
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def object_type(self) -> None:
        while not self.at("}"):
            self.type_member()
            if not (self.take(";") or self.take(",") or self.at("}") or self.nl):
                self.fail("';' expected")
        self.next()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.need(":")
        self.type()

    def mapped(self) -> None:
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.take("as"):
            self.type()
        self.need("]")
        if self.at("+", "-"):
            self.next()
        self.take("?")
        if self.take(":"):
            self.type()

    def type_member(self) -> None:
        if self.at("+", "-") and self.peek() == kind("readonly"):
            self.next()
        if self.at("readonly", "get", "set") and (self.peek() in self.WORDS or self.peek() == "[" or self.peek() == STRING):
            self.next()
        if self.at("[") and (self.attempt(self.index_signature) or self.attempt(self.mapped)):
            return
        if self.at("(", "<") or self.at("new") and self.peek() in ("(", "<"):
            self.take("new")
            self.signature()
            return
        self.property_name()
        self.take("?")
        if self.at("(", "<"):
            self.signature()
        elif self.take(":"):
            self.type()


_FIELD = re.compile(r"\$\{((?:[^`{}]|\{[^`{}]*\})*)\}|\\[\s\S]")


def parse(text: str, ts: bool = False):
    lexer = TS if ts else JS
    tokens, s = _lex(lexer, text)
    parser = (TypeScript if ts else Ecma)(s)
    run(parser)
    if TEMPLATE in s:
        for i, t in enumerate(tokens):
            if s[i] == TEMPLATE and "${" in t:
                for m in _FIELD.finditer(t):
                    if m[1] is not None:
                        inner = (TypeScript if ts else Ecma)(_lex(lexer, m[1])[1])

                        def field(inner=inner) -> None:
                            inner.p, inner.far, inner.ctx = 0, 0, "f"
                            inner.expression()
                            if inner.t != END:
                                inner.fail("'}' expected")

                        try:
                            deeply(field, inner.S)
                        except (SyntaxFault, RecursionError):
                            parser.faults.append((i, "template: expression expected"))
    return sorted(parser.faults), lexer
