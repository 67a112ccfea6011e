"""What the parsers share: tokens as a string of kinds, memoised rules, panic-mode recovery.

A lexer turns a text into one character per token: keywords and operators have their own, names,
numbers and strings share one each. Parsers walk this string by recursive descent, expressions by
precedence climbing. As names and values are abstracted, short stretches of the string recur all
over a corpus; a rule that looked at no token beyond such a stretch gives the same result wherever
it recurs, so that result is kept by the stretch (``Parser.memo``) and most statements cost one look-up.
"""

from __future__ import annotations

import re
import sys
import threading
from bisect import bisect_right
from typing import NamedTuple

NAME, NUMBER, STRING, TEMPLATE, REGEX, LIFETIME, BAD, END = "i", "n", "s", "t", "r", "l", "B", "\0"
#: Characters that stand for keywords and operators of several characters, handed out as they are first named.
CH: dict[str, str] = {}
KEPT = 200_000
#: Depth of unmatched brackets from which not all faults of a text are looked for.
DEEPEST = 1_000


class _Kinds(dict):
    def __missing__(self, token: str) -> str:
        self[token] = k = token if len(token) == 1 and not token.isalnum() and token != "_" else CH.setdefault(token, chr(0x4E00 + len(CH)))
        return k


_KINDS = _Kinds()


def kind(token: str) -> str:
    return _KINDS[token]


def kinds(words: str) -> frozenset[str]:
    return frozenset(kind(w) for w in words.split())


def shown(k: str) -> str:
    return {NAME: "name", NUMBER: "number", STRING: "string", TEMPLATE: "template", REGEX: "regular expression", LIFETIME: "lifetime", BAD: "illegal character", END: "end of file", "\n": "end of line"}.get(k) or next((w for w, c in CH.items() if c == k), k)


class SyntaxFault(Exception):
    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


class Fault(NamedTuple):
    line: int
    message: str


class Lexer(dict):
    """``pattern`` has one group, the token; what it skips before is space and comments."""

    def __init__(self, pattern: str, fixed: str, flags: int = 0):
        self.re = re.compile(pattern, flags)
        self.fixed = {w: kind(w) for w in fixed.split()} | {"\n": "\n", "": ""}
        self.update(self.fixed)

    def __missing__(self, token: str) -> str:
        c = token[0]
        if c.isalpha() or c in "_$#":
            k = self.word(token)
            if len(self) > KEPT:
                self.clear()
                self.update(self.fixed)
            self[token] = k
            return k
        return self.other(token)

    def word(self, token: str) -> str:
        return STRING if token[-1] in "\"'" else NAME

    def other(self, token: str) -> str:
        c = token[0]
        if c in "\"'":
            return STRING if len(token) > 1 else BAD
        if c.isdigit() or c == "." and token[1:2].isdigit():
            return NUMBER
        return BAD

    def lex(self, text: str) -> tuple[list[str], str]:
        tokens = self.re.findall(text)
        while tokens and not tokens[-1]:
            tokens.pop()
        return tokens, "".join(map(self.__getitem__, tokens))

    def lines(self, text: str) -> list[int]:
        """The line of each token."""
        ends = [m.start() for m in re.finditer("\n", text)]
        return [bisect_right(ends, m.start(1) - 1) + 1 for m in self.re.finditer(text)]


class Parser:
    MEMO: dict
    #: Kinds that begin a statement; panic mode stops before them.
    STARTS: frozenset[str] = frozenset()
    #: Whether what is nested too deeply is a fault; else it is parsed again with more frames.
    SHALLOW = False

    def __init__(self, s: str):
        self.S, self.p, self.far, self.faults, self.ctx = s + END + END, 0, 0, [], ""

    # tokens
    @property
    def t(self) -> str:
        return self.S[self.p]

    def next(self) -> str:
        self.p += 1
        return self.S[self.p - 1]

    def peek(self, n: int = 1) -> str:
        q = min(self.p + n, len(self.S) - 1)
        self.far = max(self.far, q)
        return self.S[q]

    def at(self, *words: str) -> bool:
        t = self.S[self.p]
        for w in words:
            if _KINDS[w] == t:
                return True
        return False

    def take(self, word: str) -> bool:
        if self.S[self.p] == _KINDS[word]:
            self.next()
            return True
        return False

    def need(self, word: str) -> None:
        if self.S[self.p] != _KINDS[word]:
            self.fail(f"{word!r} expected")
        self.next()

    def name(self) -> None:
        if self.t not in self.NAMES:
            self.fail("name expected")
        self.next()

    NAMES = frozenset(NAME)

    def fail(self, message: str):
        raise SyntaxFault(self.p, f"{message}, {shown(self.t)} found")

    def back(self, p: int) -> None:
        self.far = max(self.far, self.p)
        self.p = p

    def attempt(self, rule, *a) -> bool:
        """Whether ``rule`` holds here; if not, nothing has been read."""
        p, n = self.p, len(self.faults)
        try:
            if rule(*a) is not False:
                return True
        except SyntaxFault:
            pass
        del self.faults[n:]
        self.back(p)
        return False

    def closing(self) -> int:
        """Position of the bracket that closes the one here."""
        depth, p = 0, self.p
        for m in _BRACKETS.finditer(self.S, p):
            depth += 1 if m[0] in "([{" else -1
            if depth <= 0:
                self.far = max(self.far, m.start())
                return m.start()
        self.far = len(self.S) - 1
        return len(self.S) - 2

    def memo(self, name: str, end: int, rule, *a):
        """``rule``, or its kept result if the same kinds, up to before ``end``, were met before."""
        p = self.p
        key = (name, self.ctx, self.S[p:end])
        if (hit := self.MEMO.get(key)) is not None:
            self.p = p + hit[0]
            return hit[1]
        far, n = self.far, len(self.faults)
        self.far = p
        result = rule(*a)
        reached = max(self.far, self.p)
        if reached < end and len(self.faults) == n:
            if len(self.MEMO) > KEPT:
                self.MEMO.clear()
            self.MEMO[key] = (self.p - p, result)
        self.far = max(far, reached)
        return result

    def upto(self, word: str, more: int = 1) -> int:
        i = self.S.find(word, self.p)
        return min(len(self.S), (i if i >= 0 else len(self.S)) + more)

    # statements
    def items(self, rule, close: str) -> None:
        """``rule`` again and again until ``close``; after a fault, panic mode goes on to the next statement."""
        while self.t != close:
            if self.t == END:
                self.fail(f"{shown(close)!r} expected")
            self.guarded(rule)

    def guarded(self, rule) -> None:
        p = self.p
        try:
            rule()
        except SyntaxFault as e:
            self.faults.append((e.at, e.message))
            self.panic(p)
        except RecursionError:
            if not self.SHALLOW:
                raise
            self.faults.append((p, "nested too deeply"))
            self.p = len(self.S) - 2

    def panic(self, began: int) -> None:
        depth = 0
        self.p = max(self.p, began)
        while (t := self.t) != END:
            if t in "([{":
                depth += 1
            elif t in ")]}":
                if t == "}" and depth <= 0:
                    if self.p == began:
                        self.next()
                    return
                depth = max(0, depth - 1)
            elif depth == 0 and self.p > began and t in self.STARTS:
                return
            self.next()
            if t == ";" and depth == 0:
                return

    def program(self) -> None:
        raise NotImplementedError

    def listed(self, rule, close: str, *, trailing: bool = True) -> None:
        """Comma-separated items; reads the closing token."""
        close = kind(close)
        while self.t != close:
            rule()
            if not self.take(","):
                break
            if not trailing and self.t == close:
                self.fail("item expected")
        if self.t != close:
            self.fail(f"',' or {shown(close)!r} expected")
        self.next()

    # expressions
    BINARY: dict[str, int] = {}
    RIGHT: frozenset[str] = frozenset()

    def climb(self, least: int = 1):
        """Precedence climbing over BINARY; the result says what kind of operand was met."""
        what = self.unary()
        while (level := self.BINARY.get(self.t, 0)) >= least:
            op = self.next()
            self.climb(level if op in self.RIGHT else level + 1)
            what = "binary"
        return what


_BRACKETS = re.compile(r"[()\[\]{}]")


def levels(*rows: str) -> dict[str, int]:
    """Binary operators by precedence, the loosest first."""
    return {kind(w): i for i, row in enumerate(rows, 1) for w in row.split()}


def _hopeless(s: str) -> bool:
    """Whether brackets don't match, which is a fault for certain, and are nested more than DEEPEST deep."""
    opened, deepest, match = [], 0, True
    for m in _BRACKETS.finditer(s):
        if m[0] in "([{":
            opened.append(m[0])
            deepest = max(deepest, len(opened))
        else:
            match &= bool(opened) and opened.pop() + m[0] in ("()", "[]", "{}")
    return deepest > DEEPEST and not (match and not opened)


def deeply(task, s: str):
    """``task()``; where that takes more frames than there are, again in a thread that has enough for all tokens of ``s``.
    Where unmatched brackets lie very deep the RecursionError is left to the caller: the text is faulty anyhow."""
    try:
        return task()
    except RecursionError:
        if _hopeless(s):
            raise
    result: list = []

    def again() -> None:
        try:
            result.append((task(), None))
        except BaseException as e:  # noqa: BLE001
            result.append((None, e))

    limit, size = sys.getrecursionlimit(), threading.stack_size(256 << 20)
    sys.setrecursionlimit(limit + 40 * len(s))
    try:
        thread = threading.Thread(target=again)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(limit)
    value, error = result[0]
    if error is not None:
        raise error
    return value


def run(parser: Parser) -> list[tuple[int, str]]:
    start = dict(vars(parser))

    def parse() -> None:
        vars(parser).update(start, faults=[])
        parser.program()

    try:
        try:
            deeply(parse, parser.S)
        except (RecursionError, MemoryError):
            parser.SHALLOW = True
            parse()
    except SyntaxFault as e:
        parser.faults.append((e.at, e.message))
    except RecursionError:
        parser.faults.append((parser.p, "nested too deeply"))
    return sorted(parser.faults)
