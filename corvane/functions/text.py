"""Scalar functions on text as native expressions, which stay in the JVM and take whole columns."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Affixes that make further tokens, in the order they are tried.
SUFFIXES = ("able", "ible", "tion", "sion", "ment", "ness", "ing", "ed", "er", "est", "ly", "ful", "less", "ize", "ise", "ify", "ous", "ive", "al", "ial", "ian")
PREFIXES = ("use", "get", "set", "is", "has", "can", "on", "pre", "post", "un", "re")
# Words, humps and numbers of a token; (?U) and (?d) give \W and $ the meaning Python has.
HUMPS = r"(?Ud)([A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\W|$)|\d+)"
RAW = r"([a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)*)"
# Languages by extension.
LANGUAGES = {
    "python": "py pyw pyi", "javascript": "js jsx mjs cjs", "typescript": "ts", "tsx": "tsx", "go": "go", "rust": "rs", "c": "c h", "cpp": "cpp cc cxx hpp hxx", "java": "java",
    "ruby": "rb", "php": "php", "c_sharp": "cs", "markdown": "md markdown", "html": "html htm", "css": "css", "json": "json", "yaml": "yaml yml", "toml": "toml", "bash": "sh bash zsh",
}

ARRAY = "array<string>"
#: Tokens that the frame of a file takes.
FRAME = 50


def raw_tokens(text: Column) -> Column:
    """ASCII words with the dots between them."""
    return F.regexp_extract_all(text, F.lit(RAW), F.lit(1))


def humps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HUMPS), F.lit(1))


def _parts(tokens: Column, separator: str) -> Column:
    return F.flatten(F.transform(tokens, lambda x: F.split(x, re.escape(separator))))


def _clean(tokens: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tokens, F.lower), lambda x: F.length(x) > 1))


# a suffix that ends in one tried before it never comes to be tried; of the others at most one fits
_SUFFIXED = "^(.{3,})(?:" + "|".join(a for k, a in enumerate(SUFFIXES) if not any(a.endswith(b) for b in SUFFIXES[:k])) + ")$"
_PREFIXED = "^(?:" + "|".join(PREFIXES) + ")(.{3,})$"


def affix_roots(tokens: Column) -> Column:
    """What is left of tokens without their suffix, and without their prefix: the first affix that leaves more than two letters."""
    both = F.concat(F.transform(tokens, lambda t: F.regexp_extract(t, _SUFFIXED, 1)), F.transform(tokens, lambda t: F.regexp_extract(t, _PREFIXED, 1)))
    return F.filter(both, lambda r: F.length(r) > 2)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def code_tokens(text: Column) -> Column:
    """The distinct tokens of a text: humps, raw words, their parts at dots and underscores, and roots."""
    plain = _let(raw_tokens(text), lambda r: _clean(F.concat(humps(text), r, _parts(r, "_"), _parts(r, "."))))
    return _let(plain, lambda p: F.array_distinct(F.concat(p, affix_roots(p))))


def trigrams(text: Column) -> Column:
    """Distinct strings of three code points, in time linear in the text; none for shorter texts."""
    c = F.split(text, "")
    n = F.length(text)
    shifted = F.zip_with(F.slice(c, F.lit(1), n - 2), F.slice(c, F.lit(2), n - 2), lambda a, b: F.concat(a, b))
    return F.when(n >= 3, F.array_distinct(F.zip_with(shifted, F.slice(c, F.lit(3), n - 2), lambda ab, d: F.concat(ab, d)))).otherwise(F.array().cast(ARRAY))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a 1-based character position."""
    before = F.substring(text, F.lit(1), offset - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def context_of(text: Column, line: Column, before: int = 2, after: int = 3) -> Column:
    lines = F.split(text, "\n", -1)
    first = F.greatest(line - before, F.lit(1))
    return F.concat_ws("\n", F.slice(lines, first, F.least(line + after, F.size(lines)) - first + 1))


def regex_literals(pattern: str, least: int = 3) -> list[str]:
    """Runs of literal characters at the top level of a regular expression; none where case is ignored."""
    parser = __import__("re._parser", fromlist=["parse"])
    tree = parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return []
    runs, now = [], []
    for op, arg in [*tree, (None, None)]:
        if str(op) == "LITERAL":
            now.append(chr(arg))
        else:
            runs.append("".join(now))
            now = []
    return [r for r in runs if len(r) >= least]


def repo_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.md5(F.format_string("%s:%d-%d", path, start, end))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def token_estimate(content: Column) -> Column:
    """Four characters to a token, and what a file's frame takes."""
    return (F.ceil(F.length(content) / 4) + FRAME).cast("bigint")


def token_count(content: Column, count: Callable[[str], int] | None = None) -> Column:
    """Tokens by ``count``, a tokenizer that works on the workers, and what a file's frame takes; without one the estimate."""
    if count is None:
        return token_estimate(content)

    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else count(t) + FRAME)

    return F.pandas_udf(counted, "bigint")(content)


def escape_xml(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#x27;")] * quotes
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit("")) if quotes else text


def preview(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of an extension; null for others."""
    table = F.create_map(*(F.lit(x) for name, es in LANGUAGES.items() for e in es.split() for x in (e, name)))
    return table[extension(path)]


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def stripped(text: Column) -> Column:
    """Without white space, of any kind, at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def valid_text(content: Column) -> Column:
    """Bytes as UTF-8 text, without what isn't valid; a replacement character that the text has itself stays."""
    # U+FFFD of the text is set aside first, by a code point that no text in UTF-8 holds as such bytes
    aside = F.call_function("regexp_replace", F.decode(content, "ISO-8859-1"), F.lit("\u00ef\u00bf\u00bd"), F.lit("\u00ef\u00b7\u0090"))
    valid = F.translate(F.call_function("make_valid_utf8", F.encode(aside, "ISO-8859-1").cast("string")), "\ufffd", "")
    return F.when(F.contains(content, F.lit(b"\xef\xbf\xbd")), F.translate(valid, "\ufdd0", "\ufffd")).otherwise(F.translate(F.call_function("make_valid_utf8", content.cast("string")), "\ufffd", ""))


# Names that are no missing symbols, and the patterns of references and definitions.
BUILTINS = (
    "print len str int float bool list dict set tuple range enumerate zip map filter sorted reversed any all min max sum abs round open isinstance hasattr getattr setattr type super property "
    "staticmethod classmethod None True False self cls args kwargs console window document Promise Array Object String Number Boolean Math JSON Date Error Map Set undefined null this async await "
    "export import require module default i j k x y n err error result data value key item items name path file content msg message text"
).split()
REFERENCES = [
    r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", r"\bnew\s+([A-Z][A-Za-z0-9_]*)\s*\(", r"[:\-]\s*>?\s*([A-Z][A-Za-z0-9_]*)", r"\[([A-Z][A-Za-z0-9_]*)",
    r"\b([A-Z][A-Za-z0-9_]+)\.[a-z_]", r"from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+import", r"import\s+([A-Za-z_][A-Za-z0-9_]*)",
]
DEFINITIONS = [
    r"\b(?:def|class|async\s+def)\s+([A-Za-z_][A-Za-z0-9_]*)", r"\b(?:function|class|interface|type|enum)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=", r"^([A-Z][A-Za-z0-9_]*)\s*=",
]


def _every(text: Column, patterns: list[str]) -> Column:
    # (?U): \b and \s know more than ASCII; (?md): ^ stands after \n only
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?Umd)" + p), F.lit(1)) for p in patterns))))


def references(text: Column) -> Column:
    found = F.array_except(_every(text, REFERENCES), F.array(*map(F.lit, BUILTINS)))
    return F.filter(found, lambda s: F.length(s) > 2)


def definitions(text: Column) -> Column:
    return _every(text, DEFINITIONS)


def missing_symbols(text: Column) -> Column:
    return F.array_except(references(text), definitions(text))
