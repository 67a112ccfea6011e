import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def brute_tokens(text):
    """The tokens again, by Python's own regular expressions."""
    out = []

    def add(t):
        t = t.lower()
        if len(t) > 1 and t not in out:
            out.append(t)

    raw = re.findall(X.RAW, text)
    for t in [*re.findall(X.HUMPS.replace("(?Ud)", ""), text), *raw, *(p for r in raw for p in r.split("_")), *(p for r in raw for p in r.split("."))]:
        add(t)
    for affixes, cut in ((X.SUFFIXES, lambda t, a: t[: -len(a)] if t.endswith(a) else None), (X.PREFIXES, lambda t, a: t[len(a) :] if t.startswith(a) else None)):
        roots = []
        for t in plain if "plain" in locals() else (plain := list(out)):
            for a in affixes:
                left = cut(t, a)
                if left is not None and len(t) > len(a) + 2:
                    roots += [left] * (len(left) > 2)
                    break
        for r in roots:
            if r not in out:
                out.append(r)
    return out


@pytest.mark.parametrize("text", ["useDraggablePane", "HTTPServer2 snake_case.name", "notification", "a b", "", "ABCé ABC naïve_word.x", "useToast isReady", "x1.y2_z3"])
def test_code_tokens(spark, text):
    assert one(spark, X.code_tokens, text) == brute_tokens(text)


def test_code_tokens_of_null(spark):
    assert one(spark, X.code_tokens, None) is None


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="aAbBzZ09_. é-", max_size=40))
def test_code_tokens_of_any_text(spark, text):
    assert one(spark, X.code_tokens, text) == brute_tokens(text)


def test_the_first_affix_alone_is_tried(spark):
    assert "dragg" in one(spark, X.code_tokens, "useDraggablePane")
    assert one(spark, lambda c: X.affix_roots(F.array(c)), "sing") == []


@pytest.mark.parametrize("text, n", [("", 0), ("ab", 0), ("abc", 1), ("abcd", 2), ("aaaa", 1), ("a\U0001f600bc", 2), (None, 0)])
def test_trigrams(spark, text, n):
    assert len(one(spark, X.trigrams, text)) == n


@pytest.mark.parametrize("pattern, found", [(r"function\s+login", ["function", "login"]), (r"useState\(.+\)", ["useState("]), (r"\d+", []), (r"class [A-Z]\w+", ["class "]), ("abc|def", []), ("(?i)hello", [])])
def test_literals_of_a_regex(pattern, found):
    assert X.regex_literals(pattern) == found


def test_lines_and_context(spark):
    text = "a\nb\nc\nd\ne\nf\ng"
    df = spark.createDataFrame([(text, 7)], "t string, p int")
    assert df.select(X.line_of(F.col("t"), F.col("p"))).first()[0] == 4
    assert df.select(X.context_of(F.col("t"), F.lit(4))).first()[0] == "b\nc\nd\ne\nf\ng"
    assert df.select(X.context_of(F.col("t"), F.lit(1))).first()[0] == "a\nb\nc\nd"


def test_names_of_things(spark):
    assert len(one(spark, X.repo_hash, "/r")) == 16
    assert one(spark, X.language, "a/b.TSX") == "tsx" and one(spark, X.language, "a/b") is None
    assert one(spark, X.token_estimate, "x" * 9) == 53
    assert one(spark, lambda c: X.escape_xml(c, True), "<a b='\"&'>") == "&lt;a b=&#x27;&quot;&amp;&#x27;&gt;"
    assert one(spark, lambda c: X.escape_xml(c, True), None) == ""
    assert one(spark, X.valid_text, bytearray(b"A\xffB"), "binary") == "AB"
    assert one(spark, lambda c: X.relative(c, "/r/x"), "/r/x/a.py") == "a.py" and one(spark, lambda c: X.relative(c, "/r/x"), "/r/xy") == "/r/xy"
    assert one(spark, X.stripped, "  a b\x1c\n") == "a b"


def test_symbols(spark):
    code = "class Foo:\n    pass\nBAR = 1\nx = new Widget(Foo(1))\nprint(helper(2))\nfrom mod.sub import y\n"
    assert set(one(spark, X.definitions, code)) == {"Foo", "BAR"}
    assert set(one(spark, X.missing_symbols, code)) == {"Widget", "helper", "mod.sub"}
