"""Python 3: logical lines of kinds, each parsed once for all its recurrences, then the blocks they form."""

from __future__ import annotations

import re

from .base import BAD, END, NAME, NUMBER, STRING, Lexer, Parser, SyntaxFault, kind, kinds, levels, deeply

_FIELD = r"\{(?:[^{}\n\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"
_F = r"(?:[fFtT][rR]?|[rR][fFtT])"
_P = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_STRINGS = "|".join([
    rf'{_F}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', rf"{_F}'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''",
    rf'{_F}"(?!"")(?:[^"\\\n{{]|\\[\s\S]|\{{\{{|{_FIELD})*"', rf"{_F}'(?!'')(?:[^'\\\n{{]|\\[\s\S]|\{{\{{|{_FIELD})*'",
    rf'{_P}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', rf"{_P}'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''",
    rf'{_P}"(?!"")(?:[^"\\\r\n]|\\\r\n|\\[\s\S])*"', rf"{_P}'(?!'')(?:[^'\\\r\n]|\\\r\n|\\[\s\S])*'",
])
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"

_ZEROS, _BYTES = re.compile(r"0[\d_]*[1-9][\d_]*"), re.compile("[rR]?[bB][rR]?[\"']")

WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
SOFT = "match case type _ print"
OPERATORS = "** // >> << <= >= == != -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= := ... + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; ="

LEXER = Lexer(
    rf"(?:[ \t\f]+|\\\r?\n|\#[^\r\n]*+)*+((?:\r\n?|\n)(?:[ \t\f]*(?:\#[^\r\n]*)?(?:\r\n?|\n))*[ \t\f]*|[^\W\d]\w*+(?![\"'])|{_STRINGS}|{_NUMBER}|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|[<>=!+\-*/%@&|^:]=|->|[^\W\d]\w*|[^ \t\f]|\Z)",
    f"{WORDS} match case type {OPERATORS}",
)

ASSIGN = kinds("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")
ATOMS = kinds("False None True ...")
EXPR_STARTS = kinds("not lambda await yield - + ~ ( [ { False None True ... match case type *") | {NAME, NUMBER, STRING}
TARGETS = ("name", "attr", "item", "tuple", "star")


class Line(Parser):
    """One logical line."""

    MEMO: dict = {}
    NAMES = frozenset(NAME) | kinds("match case type")
    BINARY = levels("or", "and", "not in is < > <= >= == !=", "|", "^", "&", "<< >>", "+ -", "* / // % @")
    COMPARE, NOT = 3, 4

    # expressions; each returns what it is, so that targets can be told
    def unary(self) -> str:
        if self.take("not"):
            self.climb(self.COMPARE)
            return "not"
        if self.at("+", "-", "~"):
            self.next()
            self.unary_tight()
            return "unary"
        return self.power()

    def unary_tight(self) -> None:
        if self.at("not"):
            self.fail("operand expected")
        self.unary()

    def climb(self, least: int = 1) -> str:
        if least > self.COMPARE and self.at("not"):
            self.fail("operand expected")
        what = self.unary()
        if what == "not" and least <= self.COMPARE:
            least_right = self.COMPARE - 1  # not binds looser than a comparison
        else:
            least_right = 99
        while (level := self.BINARY.get(self.t, 0)) >= least and level <= least_right:
            op = self.next()
            if op == kind("not"):
                self.need("in")
            elif op == kind("is"):
                self.take("not")
            self.climb(level + 1)
            what = "binary"
        return what

    def power(self) -> str:
        awaited = self.take("await")
        what = self.primary()
        if self.take("**"):
            self.unary_tight()
            return "binary"
        return "await" if awaited else what

    def primary(self) -> str:
        what = self.atom()
        while True:
            if self.take("."):
                self.name()
                what = "attr"
            elif self.take("("):
                self.arguments()
                what = "call"
            elif self.take("["):
                if self.at("]"):
                    self.fail("subscript expected")
                self.listed(self.slice, "]")
                what = "item"
            else:
                return what

    def slice(self) -> None:
        if self.take("*"):
            self.climb(4)
            return
        if not self.at(":"):
            self.named()
            if not self.at(":"):
                return
        self.need(":")
        for last in (False, True):
            if not self.at(":", ",", "]"):
                self.test()
            if last or not self.take(":"):
                return

    def arguments(self, generator: bool = True) -> None:
        keyword = doubled = False
        first = True
        while not self.at(")"):
            if self.take("**"):
                self.test()
                keyword = doubled = True
            elif self.take("*"):
                if doubled:
                    self.fail("iterable argument after keyword ones")
                self.test()
            elif self.t in self.NAMES and self.peek() == "=":
                self.next()
                self.next()
                self.test()
                keyword = True
            else:
                if keyword:
                    self.fail("positional argument after a keyword one")
                self.named()
                if self.at("for", "async"):
                    if not generator:
                        self.fail("a class has no generator among its bases")
                    self.comprehension()
                    if not first or not self.at(")"):
                        if not self.at(")") and not (first and self.at(",") and self.peek() == ")"):
                            self.fail("generator must be parenthesised")
            first = False
            if not self.take(","):
                break
        self.need(")")

    def atom(self) -> str:
        t = self.t
        if t in self.NAMES:
            self.next()
            return "name"
        if t == NUMBER or t in ATOMS:
            self.next()
            return "literal"
        if t == STRING:
            while self.t == STRING:
                self.next()
            return "literal"
        if self.take("("):
            if self.take(")"):
                return "tuple"
            if self.at("yield"):
                self.yielded()
                self.need(")")
                return "group"
            return self.bracketed(")")
        if self.take("["):
            if self.take("]"):
                return "tuple"
            what = self.bracketed("]")
            return "other" if what == "comprehension" else "tuple" if what in TARGETS else "list"
        if self.take("{"):
            self.braces()
            return "other"
        self.fail("expression expected")

    def bracketed(self, close: str) -> str:
        n, good, what = 0, True, ""
        while True:
            what = self.starred()
            n, good = n + 1, good and what in TARGETS
            if n == 1 and self.at("for", "async"):
                self.comprehension()
                self.need(close)
                return "comprehension"
            if not self.take(","):
                self.need(close)
                if n == 1 and close == ")":
                    if what == "star":
                        self.fail("a starred expression can't stand alone")
                    return what if what in TARGETS else "group"
                return "tuple" if good else "group"
            if self.at(close):
                self.next()
                return "tuple" if good else "group"

    def braces(self) -> None:
        if self.take("}"):
            return
        first, pairs = True, None
        while not self.at("}"):
            if self.take("**"):
                self.climb(4)
                is_pair = True
            elif self.take("*"):
                self.climb(4)
                is_pair = False
            else:
                self.named()
                is_pair = self.take(":")
                if is_pair:
                    self.test()
            if pairs is not None and pairs != is_pair:
                self.fail("a dict and a set are mixed")
            pairs = is_pair
            if first and self.at("for", "async"):
                self.comprehension()
                break
            first = False
            if not self.take(","):
                break
        self.need("}")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.take("async")
            self.need("for")
            self.target_list("in")
            self.need("in")
            self.climb()
            while self.take("if"):
                self.climb()

    def target_list(self, end: str) -> None:
        while True:
            what = "star" if self.take("*") and self.power() else self.power()
            if what not in TARGETS:
                self.fail("can't assign to this")
            if not self.take(",") or self.at(end):
                return

    def test(self) -> str:
        if self.take("lambda"):
            self.parameters(":", lambda_=True)
            self.need(":")
            self.test()
            return "lambda"
        what = self.climb()
        if self.take("if"):
            self.climb()
            self.need("else")
            self.test()
            return "ternary"
        return what

    def named(self) -> str:
        if self.t in self.NAMES and self.peek() == kind(":="):
            self.next()
            self.next()
            self.test()
            return "walrus"
        return self.test()

    def starred(self) -> str:
        if self.take("*"):
            self.climb(4)
            return "star"
        return self.named()

    def yielded(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.test()
        elif not self.at(")", "=", ";") and self.t != END:
            self.exprs()

    def exprs(self) -> str:
        """Star expressions, as on either side of ``=``."""
        what, n, good = self.starred_plain(), 1, True
        good = what in TARGETS
        while self.take(","):
            n += 1
            if self.t not in EXPR_STARTS:
                return "tuple" if good else "other"
            good = (self.starred_plain() in TARGETS) and good
        return ("tuple" if good else "other") if n > 1 else what

    def starred_plain(self) -> str:
        if self.take("*"):
            self.climb(4)
            return "star"
        if self.t in self.NAMES and self.peek() == kind(":="):
            self.fail("':=' needs parentheses")
        return self.test()

    def parameters(self, close: str, lambda_: bool = False) -> None:
        default = star = slash = seen = False
        bare = False
        while not self.at(close):
            if self.take("**"):
                if bare:
                    self.fail("a named parameter must follow *")
                self.parameter(lambda_, False)
                self.take(",")
                if not self.at(close):
                    self.fail("nothing may follow a ** parameter")
                break
            if self.take("*"):
                if star:
                    self.fail("a second * parameter")
                star = True
                bare = self.at(",")
                if not bare:
                    self.parameter(lambda_, False, True)
            elif self.take("/"):
                if slash or star or not seen:
                    self.fail("/ out of place")
                slash = True
            else:
                has = self.parameter(lambda_, True)
                if default and not has and not star:
                    self.fail("parameter without a default after one with it")
                default = default or (has and not star)
                seen, bare = True, False
            if not self.take(","):
                break
        if bare:
            self.fail("a named parameter must follow *")

    def parameter(self, lambda_: bool, default: bool, starred: bool = False) -> bool:
        self.name()
        if not lambda_ and self.take(":"):
            if starred and self.take("*"):
                self.climb(4)
            else:
                self.test()
        if default and self.take("="):
            self.test()
            return True
        return False

    # lines
    def line(self) -> str:
        """What the line opens: '' for nothing, else the word of the block."""
        word = self.compound()
        if word is not None:
            if not self.take(":"):
                self.fail("':' expected")
            if self.t != END:
                self.simple_line()
                return word + "!"  # the body stands on the line
            return word
        self.simple_line()
        return ""

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";") or self.t == END:
                break
        if self.t != END:
            self.fail("end of line expected")

    def compound(self) -> str | None:
        word = next((w for w in ("if", "elif", "while", "else", "try", "finally", "for", "with", "def", "class", "except", "async", "match", "case", "@") if self.t == kind(w)), None)
        if word is None:
            return None
        if word in ("match", "case"):
            p = self.p
            if self.S[len(self.S) - 3] == ":" or word == "case" or ":" in self.S:
                try:
                    self.next()
                    if word == "match":
                        self.exprs()
                    else:
                        self.patterns()
                        if self.take("if"):
                            self.named()
                    if self.at(":"):
                        return word
                except SyntaxFault:
                    pass
            self.back(p)
            return None
        self.next()
        if word == "@":
            self.named()
            if self.t != END:
                self.fail("end of line expected")
            self.p -= 1
            return self.decorated()
        if word == "async":
            if not self.at("def", "for", "with"):
                self.fail("def, for or with expected")
            word = "def" if self.at("def") else "for" if self.at("for") else "with"
            self.next()
        if word in ("if", "elif", "while"):
            self.named()
        elif word == "for":
            self.target_list("in")
            self.need("in")
            self.exprs()
        elif word == "with":
            if not (self.at("(") and self.attempt(self.with_group)):
                while True:
                    self.with_item()
                    if not self.take(","):
                        break
        elif word == "except":
            group = self.take("*")
            if group or not self.at(":"):
                self.test()
                while self.take(","):
                    self.test()
                if self.take("as"):
                    self.name()
        elif word in ("def", "class"):
            self.name()
            if self.take("["):
                self.type_parameters()
            if word == "def":
                self.need("(")
                self.parameters(")")
                self.need(")")
                if self.take("->"):
                    self.exprs()
            elif self.take("("):
                self.arguments(generator=False)
        return word

    def decorated(self):
        raise _Decorator

    def type_parameters(self) -> None:
        if self.at("]"):
            self.fail("type parameter expected")
        self.listed(self.type_parameter, "]")

    def type_parameter(self) -> None:
        if self.at("*", "**"):
            self.next()
        self.name()
        if self.take(":"):
            self.test()
        if self.take("="):
            self.test()

    def with_group(self) -> bool:
        self.need("(")
        self.listed(self.with_item, ")")
        return self.at(":")

    def with_item(self) -> None:
        self.test()
        if self.take("as"):
            if self.starred() not in TARGETS:
                self.fail("can't assign to this")

    def patterns(self) -> None:
        while True:
            self.pattern()
            if not self.take(",") or self.at(":", "if"):
                return

    def pattern(self) -> None:
        if self.take("*"):
            self.name()
            return
        while True:
            self.closed_pattern()
            if not self.take("|"):
                break
        if self.take("as"):
            self.name()

    def closed_pattern(self) -> None:
        if self.take("-"):
            if self.t != NUMBER:
                self.fail("number expected")
        if self.t == NUMBER:
            self.next()
            if self.at("+", "-"):
                self.next()
                if self.next() != NUMBER:
                    self.fail("number expected")
        elif self.t == STRING:
            while self.t == STRING:
                self.next()
        elif self.at("None", "True", "False"):
            self.next()
        elif self.take("("):
            self.listed(self.pattern, ")")
        elif self.take("["):
            self.listed(self.pattern, "]")
        elif self.take("{"):
            self.listed(self.pattern_pair, "}")
        else:
            self.name()
            while self.take("."):
                self.name()
            if self.take("("):
                self.listed(self.pattern_argument, ")")

    def pattern_pair(self) -> None:
        if self.take("**"):
            self.name()
            return
        self.closed_pattern()
        self.need(":")
        self.pattern()

    def pattern_argument(self) -> None:
        if self.t in self.NAMES and self.peek() == "=":
            self.next()
            self.next()
        self.pattern()

    def simple(self) -> None:
        if self.at("pass", "break", "continue"):
            self.next()
        elif self.take("return"):
            if self.t != END and not self.at(";"):
                self.exprs()
        elif self.take("raise"):
            if self.t != END and not self.at(";"):
                self.test()
                if self.take("from"):
                    self.test()
        elif self.at("global", "nonlocal"):
            self.next()
            self.name()
            while self.take(","):
                self.name()
        elif self.take("del"):
            while True:
                if self.power() not in ("name", "attr", "item", "tuple"):
                    self.fail("can't delete this")
                if not self.take(",") or self.t == END:
                    break
        elif self.take("assert"):
            self.test()
            if self.take(","):
                self.test()
        elif self.take("import"):
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
        elif self.take("from"):
            dots = False
            while self.at(".", "..."):
                self.next()
                dots = True
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            if self.take("("):
                if self.at(")"):
                    self.fail("name expected")
                self.listed(self.alias, ")")
            else:
                while True:
                    self.alias()
                    if not self.take(","):
                        break
        elif self.at("type") and self.peek() in self.NAMES and self.attempt(self.type_alias):
            pass
        else:
            self.assignment()

    def type_alias(self) -> None:
        self.next()
        self.name()
        if self.take("["):
            self.type_parameters()
        self.need("=")
        self.test()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def alias(self) -> None:
        self.name()
        if self.take("as"):
            self.name()

    def assignment(self) -> None:
        if self.at("yield"):
            self.yielded()
            return
        what = self.exprs()
        if self.take(":"):
            if what not in ("name", "attr", "item"):
                self.fail("can't annotate this")
            self.test()
            if self.take("="):
                self.value()
        elif self.t in ASSIGN:
            if what not in ("name", "attr", "item"):
                self.fail("can't assign to this")
            self.next()
            self.value()
        else:
            while self.at("="):
                if what not in TARGETS:
                    self.fail("can't assign to this")
                self.next()
                what = self.value()

    def value(self) -> str:
        if self.at("yield"):
            self.yielded()
            return "yield"
        return self.exprs()


class _Decorator(Exception):
    """The line is a decorator."""


_KEPT: dict[str, tuple] = {}
_OPEN = kinds("( [ {")
_NEXT = {"elif": ("if", "elif"), "else": ("if", "elif", "while", "for", "try", "except"), "except": ("try", "except"), "finally": ("try", "except", "else-try")}
# texts in a field may hold braces; a quote in its format is none
_FIELDS = re.compile(r"\{\{|\}\}|\{((?:[^{}\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\})*)\}|\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}")
_SPEC = re.compile(r"=?\s*(?:![rsa]\s*)?(?::(?!=).*)?$", re.S)


def _of(line: str) -> tuple[str | None, int, str]:
    """Kind of the logical line; or None, where and why it fails."""
    hit = _KEPT.get(line)
    if hit is None:
        try:
            hit = (deeply(lambda: Line(line).line(), line), 0, "")
        except _Decorator:
            hit = ("@", 0, "")
        except SyntaxFault as e:
            hit = (None, e.at, e.message)
        except RecursionError:
            hit = (None, 0, "nested too deeply")
        if len(_KEPT) > 200_000:
            _KEPT.clear()
        _KEPT[line] = hit
    return hit


def _fields(token: str) -> bool:
    """Whether the replacement fields of an f-string are well formed."""
    body = token[2 if token[1] in "\"'" or token[1:2].isalpha() else 1 :]
    if not any(q in body.strip("\"'") for q in "\"'") and set("{}") & set(_FIELDS.sub("", body)):
        return False  # a brace that belongs to no field
    for m in _FIELDS.finditer(token):
        inner = m[1] if m[1] is not None else m[2]
        if inner is None:
            continue
        tokens, s = LEXER.lex(inner)
        kept = [(k, t) for k, t in zip(s, tokens) if t.strip()]
        p = Line("".join(k for k, _ in kept))
        try:
            if not p.at("yield"):
                p.exprs()
                rest = [t for _, t in kept[p.p :]]
                if rest[:1] == ["="]:
                    rest = rest[1:]
                if rest[:1] == ["!"]:
                    if rest[1:2] not in (["r"], ["s"], ["a"]):
                        return False
                    rest = rest[2:]
                if rest and rest[0][0] != ":" and not (rest[0] == "!=" or "!=" in inner):
                    return False
        except SyntaxFault:
            return False
    return True


def parse(text: str):
    tokens, s = LEXER.lex(text.removeprefix("﻿"))
    faults: list[tuple[int, str]] = []
    # kinds of line ends are all one: "\n"
    marks = [i for i, t in enumerate(tokens) if t[:1] in "\r\n"] if "\r" in text or "\n" in text else []
    if "B" in s or marks:
        k = list(s)
        for i in marks:
            k[i] = "\n"
        s = "".join(k)
    if BAD in s:
        i = s.index(BAD)
        faults.append((i, "unterminated string" if tokens[i][0] in "\"'" else "illegal character"))
    for i, t in enumerate(tokens):
        if s[i] == STRING and "{" in t and t[0] in "fFrRtT" and ("f" in (h := t[:2].lower()) or "t" in h) and not _fields(t):
            faults.append((i, "f-string: expression expected"))
        elif t[0] == "0" and len(t) > 1 and s[i] == NUMBER and _ZEROS.fullmatch(t):
            faults.append((i, "leading zeros in a number"))
        elif s[i] == STRING and t[0] in "bBrR" and _BYTES.match(t):
            if not t.isascii():
                faults.append((i, "bytes can only hold ASCII characters"))
            if s[i + 1 : i + 2] == STRING and not _BYTES.match(tokens[i + 1]) or i and s[i - 1] == STRING and not _BYTES.match(tokens[i - 1]):
                faults.append((i, "bytes and text side by side"))
    # logical lines: (indent, first token, kinds)
    lines, start, indent, depth, part, at = [], 0, "", 0, [], 0
    if marks and marks[0] == 0:
        indent, start = re.split("[\r\n]", tokens[0])[-1], 1
    elif text[:1] in " \t":
        indent = re.match(r"[ \t]*", text)[0]
        if tokens and tokens[0][:1] in "\r\n":
            indent = ""
    begun, piece = start, start
    stack: list[str] = []
    broken = False
    for i in [*[m for m in marks if m >= start], len(tokens)]:
        chunk = s[piece:i]
        if stack or "(" in chunk or "[" in chunk or "{" in chunk or ")" in chunk or "]" in chunk or "}" in chunk:
            for j, c in enumerate(chunk, piece):
                if c in "([{":
                    stack.append(c)
                elif c in ")]}":
                    if not stack or stack[-1] + c not in ("()", "[]", "{}"):
                        if not broken:
                            faults.append((j, f"unmatched {c!r}"))
                        broken = True
                        stack = []
                    else:
                        stack.pop()
        part.append(chunk)
        piece = i + 1
        if stack and i < len(tokens):
            continue
        if stack:
            faults.append((begun, f"{stack[0]!r} was never closed"))
        line = "".join(part)
        if line:
            lines.append((indent, begun, line))
        part, begun = [], piece
        if i < len(tokens):
            indent = re.split("[\r\n]", tokens[i])[-1] if len(tokens[i]) > 1 else ""
    # blocks
    levels_, want, decorated = [(0, 0)], None, False
    last: list[str] = [""]  # per level, the clause before
    for indent, at, line in lines:
        col, alt = _columns(indent)
        if want is not None:
            if col <= levels_[-1][0]:
                faults.append((at, f"an indented block expected after {want!r}"))
            else:
                levels_.append((col, alt))
                last.append("in " + want)
            want = None
        elif col > levels_[-1][0]:
            faults.append((at, "unexpected indent"))
            levels_.append((col, alt))
            last.append("")
        if (col == levels_[-1][0]) != (alt == levels_[-1][1]):
            faults.append((at, "inconsistent use of tabs and spaces"))
        if col < levels_[-1][0]:
            while len(levels_) > 1 and col < levels_[-1][0]:
                levels_.pop()
                if last.pop() in ("try", "try!"):
                    faults.append((at, "except or finally expected"))
            if col != levels_[-1][0]:
                faults.append((at, "unindent matches no outer level"))
        word, where, why = _of(line)
        before = last[-1]
        if word is None:
            faults.append((at + where, why))
            last[-1] = ""
            if line[-1:] == ":":
                want = "this line"
            continue
        if decorated and word.rstrip("!") not in ("def", "class", "@"):
            faults.append((at, "a definition must follow a decorator"))
        decorated = word == "@"
        clause = word.rstrip("!")
        if clause in _NEXT:
            if before.rstrip("!") not in _NEXT[clause]:
                faults.append((at, f"{clause!r} without what it belongs to"))
        elif before.rstrip("!") == "try":
            faults.append((at, "except or finally expected"))
        if clause == "case" and before not in ("in match", "case", "case!"):
            faults.append((at, "'case' outside of match"))
        elif before == "in match" and clause != "case":
            faults.append((at, "'case' expected"))
        if clause == "else" and before.rstrip("!") in ("try", "except"):
            if before.rstrip("!") == "try":
                faults.append((at, "'else' before except"))
            clause = "else-try"
        last[-1] = clause
        if word and word != "@" and not word.endswith("!"):
            want = word
    if want is not None:
        faults.append((max(0, len(tokens) - 1), f"an indented block expected after {want!r}"))
    if decorated:
        faults.append((max(0, len(tokens) - 1), "a definition must follow a decorator"))
    if any(x == "try" for x in last):
        faults.append((max(0, len(tokens) - 1), "except or finally expected"))
    return sorted(faults), LEXER


def _columns(indent: str) -> tuple[int, int]:
    col = 0
    if "\t" not in indent and "\f" not in indent:
        return len(indent), len(indent)
    indent = indent.rpartition("\f")[2]
    for c in indent:
        col = col // 8 * 8 + 8 if c == "\t" else col + 1
    return col, len(indent)
