"""Definitions in languages with braces, found by their heads at the outer level and by matching brackets.

Comments and strings are blanked first, so what they hold neither opens nor closes anything. This takes
the place of a grammar where none is at hand: it needs no well-formed file, only balanced brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from typing import NamedTuple

_ID = r"[^\W\d][\w$]*"
_TEXTS = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?|\"(?:[^\"\\\n]|\\[\s\S])*\"?"
#: Per family: what is blanked, how definitions begin (kind by keyword), imports and exports.
FAMILIES = {"js": "ecma", "jsx": "ecma", "mjs": "ecma", "cjs": "ecma", "ts": "ecma", "tsx": "ecma", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "c", "cc": "c", "hpp": "c", "cs": "java", "php": "php", "sh": "bash", "bash": "bash", "zsh": "bash", "rb": "ruby"}
_BLANK = {
    "ecma": _TEXTS + r"|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?|(?<=[=(,:;!&|?{}\[])[ \t]*/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/",
    "go": _TEXTS + r"|`[^`]*`?|'(?:[^'\\\n]|\\.)+'",
    "rust": _TEXTS + r"|r(#*)\"[\s\S]*?\"\1|'(?:[^'\\\n]|\\[^\n]{1,8})'",
    "java": r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\")?|" + _TEXTS + r"|'(?:[^'\\\n]|\\.)+'",
    "c": _TEXTS + r"|'(?:[^'\\\n]|\\.)+'",
    "php": _TEXTS + r"|#[^\n]*|'(?:[^'\\]|\\[\s\S])*'?",
    # a label of a case ends in a bracket that nothing opens
    "bash": r"(?<!\S)#[^\n]*|\"(?:[^\"\\]|\\[\s\S])*\"?|'[^']*'?|\$\{[^{}\n]*\}|(?<=\n)[ \t]*[^\s(){}]+\)(?![ \t]*\{)",
    "ruby": r"#[^\n]*|(?<=\n)=begin\b[\s\S]*?(?:\n=end\b[^\n]*|$)|\"(?:[^\"\\]|\\[\s\S])*\"?|'(?:[^'\\]|\\[\s\S])*'?",
}
_HEAD = {
    "ecma": rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?P<c>class|interface|enum|namespace)\s+(?P<cn>{_ID})|(?:async\s+)?function\s*\*?\s*(?P<fn>{_ID})?|type\s+(?P<tn>{_ID})\b|(?:const|let|var)\s+(?P<vn>{_ID})[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^()]*\)[^=\n]*=>|{_ID}\s*=>))",
    "go": rf"func\s*(?:\([^()]*\)\s*)?(?P<fn>{_ID})|(?P<c>type)\s+(?P<cn>{_ID})\b",
    "rust": rf"(?:pub\s*(?:\([^()]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*(?:fn\s+(?P<fn>{_ID})|(?P<c>struct|enum|trait|union|mod)\s+(?P<cn>{_ID})|(?P<i>impl)\b[^{{;]*?(?P<in>{_ID})(?:<[^{{;]*>)?\s*(?:where[^{{;]*)?(?=\{{)|macro_rules!\s*(?P<mn>{_ID}))",
    "java": rf"(?:@{_ID}(?:\([^()\n]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp|internal|partial)\s+)*(?P<c>class|interface|enum|record|struct|namespace|@interface)\s+(?P<cn>{_ID})",
    "php": rf"(?:(?:abstract|final|readonly)\s+)*(?:(?P<c>class|interface|trait|enum)\s+(?P<cn>{_ID})|function\s+&?(?P<fn>{_ID}))",
    "bash": r"(?:function\s+(?P<fn>[\w:.-]+)\s*(?:\(\s*\))?|(?P<vn>[\w:.-]+)\s*\(\s*\))\s*(?=\{)",
    "ruby": r"(?:(?P<c>class|module)\s+(?P<cn>[\w:]+)|def\s+(?P<fn>[\w.]+[?!=]?|[^\s\w(]+))",
    "c": rf"(?:template\s*<[^;{{}}]*>\s*)?(?:(?P<c>struct|class|enum|namespace)\s+(?P<cn>{_ID})[^;{{}}()=]*(?=\{{)|(?:[\w:*&<>,]+[\s*&]+)+(?P<fn>[\w:~]+)\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{))",
}
_IMPORT = {"ecma": r"^import\s[^;\n]*", "go": r"^import\s+(?:\"[^\"]*\"|\([^)]*\))", "rust": r"^(?:pub\s+)?(?:use|mod)\s[^;{]*;", "java": r"^(?:import|using)\s[^;\n]*;", "php": r"^(?:use|require|include)(?:_once)?\b[^;\n]*;", "c": r"^#include\s[^\n]*", "bash": r"^(?:source|\.)\s[^\n]*", "ruby": r"^require(?:_relative)?\b[^\n]*"}
_EXPORT = {"ecma": r"^export\s+(?:\*|\{)[^;\n]*"}
_BRACKET = re.compile(r"[()\[\]{}]")


class Definition(NamedTuple):
    start: int  # lines, from 1
    end: int
    kind: str
    name: str
    body: tuple[int, int] | None  # offsets of the braces of a function


@cache
def _compiled(family: str) -> tuple[re.Pattern, re.Pattern]:
    return re.compile(_BLANK[family]), re.compile(r"^[ \t]*+(?:" + _HEAD[family] + ")", re.M)


def blanked(text: str, family: str) -> str:
    return _compiled(family)[0].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_TOP_LEVEL = {"go": re.compile(r"^(?:func|type|var|const|import)\b", re.M)}


def closings(code: str, family: str = "") -> tuple[dict[int, int], list[tuple[int, int]]]:
    """For each opening bracket the one that closes it, and the braces at the outer level. In Go a declaration that begins a
    line is at the outer level, so what is open there was left open and encloses nothing that follows."""
    ends, outer, open_ = {}, [], []
    resets = [m.start() for m in _TOP_LEVEL[family].finditer(code)] if family in _TOP_LEVEL else []
    next_reset = 0
    for m in _BRACKET.finditer(code):
        while next_reset < len(resets) and resets[next_reset] < m.start():
            open_.clear()
            next_reset += 1
        if m[0] in "([{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.start()
            if not open_:
                outer.append((next(reversed(ends)), m.start()))  # the one just closed is the last entry
    return ends, outer


def definitions(text: str, family: str, nested: bool = False) -> list[Definition]:
    """Outermost definitions in order, or with ``nested`` all."""
    code = blanked(text, family)
    if family == "ruby":
        return _ended(code, nested)
    ends, outer = closings(code, family)
    starts = [a for a, _ in outer]
    line_ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(line_ends, at - 1) + 1
    found: list[Definition] = []
    done = -1
    for m in _compiled(family)[1].finditer(code):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if not nested:
            k = bisect_right(starts, at) - 1
            if at < done or k >= 0 and outer[k][0] < at < outer[k][1]:
                continue
        g = m.groupdict()
        name = next((g[k] for k in ("cn", "fn", "tn", "vn", "in", "mn") if g.get(k)), "")
        kind = "class" if g.get("c") or g.get("i") or g.get("tn") else "function"
        brace, semi = code.find("{", m.end()), code.find(";", m.end())
        flat = code.find("\n", m.end())
        # parameters may hold braces of their own
        paren = code.find("(", m.start())
        if kind == "function" and 0 <= paren and (brace < 0 or paren < brace) and paren in ends and ends[paren] >= m.end() - 1:
            brace, semi = code.find("{", ends[paren]), code.find(";", ends[paren])
        if brace >= 0 and brace in ends and (semi < 0 or brace < semi or kind == "function" and family == "go"):
            end, body = ends[brace] + 1, (brace, ends[brace]) if kind == "function" else None
        elif semi >= 0 and not 0 <= brace < semi:  # else its body was left open
            end, body = semi + 1, None
        else:
            end, body = flat if flat >= 0 else len(text), None
        done = end
        found.append(Definition(line(at), line(max(at, end - 1)), kind, name, body))
    return found


def _ended(code: str, nested: bool) -> list[Definition]:
    """Definitions that a line ``end``, indented as they are, closes; without one, or with a body after ``=``, they are a line long."""
    begin = [0, *(m.end() for m in re.finditer("\n", code))]
    ends: dict[str, list[int]] = {}
    for m in re.finditer(r"^([ \t]*)end\b", code, re.M):
        ends.setdefault(m[1], []).append(bisect_right(begin, m.start()))
    found: list[Definition] = []
    for m in _compiled("ruby")[1].finditer(code):
        first = bisect_right(begin, m.start() + len(m[0]) - len(m[0].lstrip()))
        if not nested and found and first <= found[-1].end:
            continue
        closing = ends.get(re.match(r"[ \t]*", m[0])[0], [])
        k = bisect_right(closing, first)
        stop = code.find("\n", m.end())
        short = m["fn"] and re.search(r"(?<![=!<>])=(?![=~>])", re.sub(r"\([^()]*\)", "", code[m.end() : stop if stop >= 0 else len(code)]))
        last = first if short or k == len(closing) else closing[k]
        body = (begin[first] - 1, begin[last - 1]) if m["fn"] and last > first + 1 else None
        found.append(Definition(first, last, "class" if m["c"] else "function", m["cn"] or m["fn"], body))
    return found


def signatures(text: str, family: str) -> list[tuple[str, int]]:
    """The heads of definitions, and of methods one level deeper, in order."""
    begin = [0, *(m.end() for m in re.finditer("\n", text))]
    outer = definitions(text, family)
    inner = [m for m in methods(text, family) if any(d.start < m.start <= d.end for d in outer if d.kind == "class")]
    found = []
    for depth, d in sorted([*((0, d) for d in outer), *((1, m) for m in inner)], key=lambda x: (x[1].start, x[0])):
        at = begin[d.start - 1]
        head = text[at : d.body[0]] if d.body else re.split("[{;]" if family != "ruby" else "\n", text[at : begin[d.end] if d.end < len(begin) else len(text)])[0]
        found.append((" ".join(head.split()), depth))
    return found


def imports(text: str, family: str) -> tuple[list[str], list[str]]:
    """Import and export lines."""
    one = lambda p: [" ".join(m[0].split()) for m in re.finditer(p, text, re.M)]
    return one(_IMPORT[family]), one(_EXPORT[family]) if family in _EXPORT else []


#: Methods inside of classes; a body must follow the parameters.
_METHOD = {
    "ecma": re.compile(rf"^[ \t]++(?:(?:static|async|get|set|public|private|protected|override|readonly)[ \t]+)*\*?(#?{_ID})[ \t]*(?:<[^<>\n]*>)?(?=\()", re.M),
    "java": re.compile(rf"^[ \t]++(?:(?:public|private|protected|static|final|synchronized|default|native)[ \t]+)*(?:<[^;{{}}()=\n]*>[ \t]*)?(?:[\w.$]+(?:<[^;{{}}()=\n]*>)?(?:\[\])*[ \t]+)?({_ID})[ \t]*(?=\()", re.M),
}
_CONTROL = frozenset("if for while switch catch return new throw else do try synchronized function super this await typeof with".split())
_BODY = re.compile(r"(?:\s*:[^;{}=]*(?:\{[^{}]*\}[^;{}=]*)?|\s*throws\s[^;{}]*)?\s*\{")


def methods(text: str, family: str) -> list[Definition]:
    if family not in _METHOD:
        return []
    code = blanked(text, family)
    ends, _ = closings(code)
    line_ends = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(line_ends, at - 1) + 1
    found = []
    for m in _METHOD[family].finditer(code):
        words = m[0].split()
        if m[1] in _CONTROL or words[0] in _CONTROL or m.end() not in ends:
            continue
        after = _BODY.match(code, ends[m.end()] + 1)
        if after and (brace := after.end() - 1) in ends:
            found.append(Definition(line(m.end()), line(ends[brace]), "function", m[1], (brace, ends[brace])))
    return found


def skeleton(text: str, family: str, keep: frozenset[str] = frozenset(), lines: frozenset[int] = frozenset()) -> str:
    """``text`` with the bodies of its functions left out, but for those named or on ``lines``."""
    out, last = [], len(text)
    every = sorted([*definitions(text, family, nested=True), *methods(text, family)], key=lambda d: d.body or (0, 0))
    cuts = [d for d in every if d.body and d.end > d.start and d.name not in keep and not lines & set(range(d.start, d.end + 1))]
    outermost: list[Definition] = []
    for d in cuts:
        if not outermost or d.body[0] > outermost[-1].body[1]:
            outermost.append(d)
    for d in reversed(outermost):
        a, b = d.body
        begin = text.rfind("\n", 0, a) + 1
        indent = re.match(r"[ \t]*", text[begin:a])[0]
        if family == "ruby":
            out.append("\n" + indent + "  # ...\n" + text[b:last])
        else:
            out.append("{\n" + indent + f"    {'#' if family == 'bash' else '//'} ...\n" + indent + text[b:last])
        last = a
    return text[:last] + "".join(reversed(out))
