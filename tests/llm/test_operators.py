import glob
import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import docpairs, hot as hot_keys, leakage, packing, pii, provenance, queries, splitting, termfreq, validity

SF = "/root/testdata/sf0.001"


# 1: terms
def brute_terms(rows):
    places, records = defaultdict(set), defaultdict(set)
    for term, record, place in rows:
        if term is not None and record is not None:
            places[term].add((record, -1 if place is None else place))
            records[term].add(record)
    every = len(set().union(*records.values())) if records else 0
    return {t: (len(places[t]), len(records[t]), "rare" if len(records[t]) == 1 else "common" if len(records[t]) > every / 2 else None) for t in places}


def term_rows(n=4000):
    r = random.Random(5)
    for i in range(n):
        hot = r.random() < 0.35
        yield ("   " if hot else "".join(r.choices("abc\n é", k=r.choice([0, 1, 3, 3, 3, 9]))), None if r.random() < 0.02 else r.randrange(40), None if r.random() < 0.02 else r.randrange(500))
    yield from [(None, 1, 1), (None, None, None), ("", 1, 0), ("one", 7, 3), ("one", 7, 3), ("\U0001f600ab", 3, 3)]


@pytest.mark.parametrize("buffer, container, routes", [(1_000_000, 128, 4), (50, 2, 1)])
def test_terms(spark, monkeypatch, buffer, container, routes):
    monkeypatch.setattr(termfreq, "BUFFER", buffer)
    monkeypatch.setattr(termfreq, "ROUTES", routes)
    rows = list(term_rows())
    df = spark.createDataFrame(rows * 2, "term string, file_id long, pos int").repartition(5).withColumns({"route": F.lit(1), "n": F.lit("x")})
    got = {r.term: (r.occurrences, r.records, r.mark) for r in termfreq.term_frequencies(df, "term", "file_id", "pos").collect()}
    assert got == brute_terms(rows)


def test_terms_without_places_and_without_rows(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 1)], "t string, r long, p int")
    assert {r.term: r.occurrences for r in termfreq.term_frequencies(df, "t", "r").collect()} == {"a": 1, "b": 1}
    assert termfreq.term_frequencies(df.limit(0), "t", "r", "p").collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=6), max_size=300), st.integers(1, 5))
def test_burst_trie(terms, limit):
    trie = termfreq.BurstTrie(limit)
    slots = [trie.slot(t) for t in terms]
    assert [trie.terms[s] for s in slots] == terms and len(set(trie.terms)) == len(trie.terms)


def test_records_are_numbers(spark):
    with pytest.raises(TypeError):
        termfreq.term_frequencies(spark.createDataFrame([("a", "b")], "t string, r string"), "t", "r")


def test_common_beginnings_are_passed_over(spark):
    partial = spark.createDataFrame([(f"https://a.example/long/way/{i:03}/{k}", 1, 10) for i in range(40) for k in range(3)], "term string, record long, n int")
    heavy, salts, bursts = termfreq._routes(partial, 4)
    assert not heavy and salts == 1 and [d for d, _ in bursts] == [1, 29]
    routed = partial.withColumn("route", termfreq._route(heavy, salts, bursts)).groupBy("route").count().collect()
    assert sorted(r["count"] for r in routed) == [30] * 4 and [d for d, _ in termfreq._routes(partial, 10)[2]] == [1, 29, 30]


def test_long_terms_route(spark):
    df = spark.createDataFrame([("prefix" * 30 + str(i % 70), i % 9, i) for i in range(3000)], "t string, r long, p int")
    assert termfreq.term_frequencies(df, "t", "r", "p").agg(F.sum("occurrences"), F.count("*")).first()[:] == (3000, 70)


# 2: files that don't parse
def test_files_without_ids(spark):
    bad = "def f(:\n"
    rows = [(None, "r1", "r1/a.py", bad), (None, "r2", "r2/a.py", bad), (None, "r1", "r1/a.py", bad), (None, None, "x.py", "ok = 1"), (1, "r1", "r1/a.py", bad), (1, "r1", "r1/a.py", bad), (2, "r1", None, bad), (3, "r1", "a.md", bad), (4, "r1", "b.py", None), (5, "r1", "b.py", " ")]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string").withColumns({"other": F.lit("x"), "language": F.lit(1)})
    verdicts = validity.syntax_verdicts(files)
    assert Counter((r.file_id, r.repo, r.faults > 0) for r in verdicts.collect()) == {(None, "r1", True): 1, (None, "r2", True): 1, (None, None, False): 1, (1, "r1", True): 1}
    assert {(r.repo, r.files, r.faulty, r.rate) for r in validity.fault_rates(verdicts).collect()} == {("r1", 2, 2, 1.0), ("r2", 1, 1, 1.0), (None, 1, 0, 0.0)}
    assert validity.syntax_verdicts(files.limit(0)).count() == 0


# 3: documentation
PAIRS = [
    ("python", 'def a(x):\n    """Adds one to what it is given.\n\n    :param x: the value to which one is added\n    """\n', ["a"]),
    ("python", "# Adds one to what is given.\n@deco(\n    1\n)\ndef b(): pass\n", ["b"]),
    ("python", "# Adds one to what is given.\n@deco(\n" + "    1,\n" * 90 + ")\ndef b(): pass\n", ["b"]),
    ("python", "# Adds one to what is given.\n\ndef b(): pass\n", []),
    ("python", "# Adds one to what is given.\nx = 1\ndef b(): pass\n", []),
    ("python", 'class A:\n    """This class does a great many things."""\n    def m(self): pass\n    async def n(\n        self,\n    ) -> dict[str, int]:\n        r\'\'\'Returns the first of many other things.\'\'\'\n', ["n"]),
    ("python", 'def outer():\n    """Says what it does:\n\n    >>> def inner(a, b, c, d):\n    ...     """\n    return "def fake(): pass"\n', ["outer"]),
    ("python", 'def f():\n    "TODO: document"\n', []),
    ("python", 'def f():\n    """:param a: one two three four five six"""\n', []),
    ("ecma", "/** Adds one to what is given. */\nexport async function a(b) {\n}\n", ["a"]),
    ("ecma", "// Adds one to what is given.\nconst b = async (x) => {\n};\n", ["b"]),
    ("ecma", "// Adds one to\n// what is given.\nexport const c = (x: number): Map<string, number> => {\n};\n", ["c"]),
    ("ecma", "class A {\n  /**\n   * Adds one to what is given.\n   * @param x many words about this one value\n   */\n  @dec()\n  static async d(x: number): Promise<void> {\n  }\n  if (x) {\n  }\n}\n", ["d"]),
    ("ecma", "class A {\n  /**\n   * @param x many words about this one value\n   */\n  e(x) {\n  }\n}\n", []),
    ("ecma", "const s = `\n// Adds one to what is given.\nfunction fake() {\n}`;\n", []),
    ("ecma", "x = 1; // Adds one to what is given.\nfunction f() {\n}\n", []),
    ("go", "// A adds one to what is given.\nfunc (s *T) A(x int) (int, error) {\n}\n", ["A"]),
    ("rust", "/// Adds one to what is given.\n#[inline]\n#[cfg(\n  test\n)]\npub(crate) fn a<'x>(x: &'x u64) -> u64 {\n}\n", ["a"]),
    ("java", "class A {\n  /** Adds one to what is given. */\n  @Override\n  @SuppressWarnings(\"unchecked\")\n  public <T> Map<String, T> m(int x) throws E {\n    if (x > 1) {\n    }\n    return foo(x);\n  }\n  // Adds one to what is given.\n  A(int x) {\n  }\n}\n", ["m", "A"]),
]


@pytest.mark.parametrize("family, text, names", PAIRS)
def test_documentation(family, text, names):
    assert [n for n, _, _ in docpairs.pairs(text, family)] == names
    assert [n for n, _, _ in docpairs.pairs(text.replace("\n", "\r\n"), family)] == names


# names that are words elsewhere, heads over several lines or behind decorators, members in all the forms they are written in
FURTHER = [
    ("python", '# Adds one to what is given.\ndef delete(self): pass\n', ['delete']),
    ("python", '# Adds one to what is given.\ndef new(cls): pass\n# Adds one to what is given.\ndef of(x): pass\n', ['new', 'of']),
    ("python", 'def f[T: (int, str)](x: T) -> T:\n    """Adds one to what is given."""\n', ['f']),
    ("python", 'def f(x) -> dict[\n    str, list[int]\n]:\n    """Adds one to what is given."""\n', ['f']),
    ("python", 'def f(x) \\\n    -> int:\n    """Adds one to what is given."""\n', ['f']),
    ("python", '# Adds one to what is given.\n@deco(\n  1\n)  # noqa\ndef f(x): pass\n', ['f']),
    ("python", '# Adds one to what is given.\n@deco(\n  1\n).bar\ndef f(x): pass\n', ['f']),
    ("python", '# Adds one to what is given.\ndef f(x) -> {1: 2}: pass\n', ['f']),
    ("python", '# Adds one to what is given.\ndef f(x\n', ['f']),
    ("rust", '/// Adds one to what is given.\npub fn new(x: u64) -> Self {\n}\n', ['new']),
    ("rust", '/// Adds one to what is given.\n#[inline] pub fn with(x: u64) {}\n', ['with']),
    ("rust", '/// Adds one to what is given.\npub /* why */ unsafe extern "C" fn r#try(x: u64) {}\n', ['try']),
    ("rust", '/// Adds one to what is given.\n#[cfg(\n test)] fn a() {}\n', ['a']),
    ("go", '// Adds one to what is given.\nfunc (s *Store) delete(k string) {\n}\n// Adds one to what is given.\nfunc new(x int) {\n}\n// Adds one to what is given.\nfunc do() {}\n', ['delete', 'new', 'do']),
    ("go", '// Adds one to what is given.\nfunc (s *(Store)) A(k string) {\n}\n// Adds one to what is given.\nfunc /* x */ B[T any](x T) {\n}\n', ['A', 'B']),
    ("go", '// Adds one to what is given.\nfunc (s Set[K, V]) A(k string) {\n}\n', ['A']),
    ("java", 'class A {\n/** Adds one to what is given. */\nstatic <T> A of(T x) {\n}\n/** Adds one to what is given. */\nvoid delete(int x) {\n}\n/** Adds one to what is given. */\npublic A with(int y);\n/** Adds one to what is given. */\nvoid await() throws E {}\n}\n', ['of', 'delete', 'with', 'await']),
    ("java", 'class A {\n/** Adds one to what is given. */\npublic @Nullable String foo(int x) {\n}\n/** Adds one to what is given. */\n@A(x = @B(1)) void b() {\n}\n/** Adds one to what is given. */\n@A(\n 1\n) public void c() {\n}\n}\n', ['foo', 'b', 'c']),
    ("java", 'class A {\n/** Adds one to what is given. */\npublic A.B<X>.C<Y> foo(@P(1) int x) // c\n{\n}\n/** Adds one to what is given. */\n@Inject private Foo foo;\nvoid bar() {\n}\n}\n', ['foo']),
    ("java", 'class iPhone {\n/** Adds one to what is given. */\niPhone(int x) {\n}\n}\nrecord R(int a) {\n/** Adds one to what is given. */\npublic R {\n}\n/** Adds one to what is given. */\nR {\n}\n}\n', ['iPhone', 'R', 'R']),
    ("java", 'class A {\nvoid m() {\n/** Adds one to what is given. */\nif (x) {\n}\n/** Adds one to what is given. */\nelse if (x) {\n}\n/** Adds one to what is given. */\nsynchronized (x) {\n}\n/** Adds one to what is given. */\nreturn foo(x);\n/** Adds one to what is given. */\nnew Foo(x) {\n};\n/** Adds one to what is given. */\nFoo x = new Foo(y) {\n};\n/** Adds one to what is given. */\ndo foo(x); while (y);\n}\n}\n', []),
    ("ecma", "class A {\n/** Adds one to what is given. */\ndelete(id) {\n}\n/** Adds one to what is given. */\nstatic of(x) {\n}\n/** Adds one to what is given. */\ncatch(f) {\n}\n/** Adds one to what is given. */\nif(f) {\n}\n/** Adds one to what is given. */\nasync *[Symbol.iterator]() {\n}\n/** Adds one to what is given. */\n'foo-bar'(x) {\n}\n/** Adds one to what is given. */\nfunction(x) {\n}\n}\n", ['delete', 'of', 'catch', 'if', '[Symbol.iterator]', 'foo-bar', 'function']),
    ("ecma", '/** Adds one to what is given. */\ndelete(id) {\n}\n', ['delete']),
    ("ecma", 'function f() {\n/** Adds one to what is given. */\nif (x) {\n}\n/** Adds one to what is given. */\nfor (x of y) {\n}\n/** Adds one to what is given. */\nswitch (x) {\n/** Adds one to what is given. */\ncase (x): {\n}\n/** Adds one to what is given. */\ndefault: {\n}\n}\n/** Adds one to what is given. */\nfoo(x);\n/** Adds one to what is given. */\nwhile (x) {\n}\n/** Adds one to what is given. */\nwith (x) {\n}\n/** Adds one to what is given. */\nreturn (x) ? foo(a) : {};\ntry {\n}\n/** Adds one to what is given. */\ncatch (e) {\n}\n}\n', []),
    ("ecma", '// Adds one to what is given.\nconst f: (x: number) => string = (x) => {\n};\n// Adds one to what is given.\nexport const g = <T extends Foo<U>>(\n  x: T\n): Promise<{\n a: string;\n b: number }> => {\n};\n// Adds one to what is given.\nlet h = async function* name(x) {\n};\n// Adds one to what is given.\nconst i = x => x;\n// Adds one to what is given.\nconst j = (x)(y);\n// Adds one to what is given.\nconst k = (x) + 1;\n', ['f', 'g', 'h', 'i']),
    ("ecma", 'class A {\n// Adds one to what is given.\nm<T extends Record<string, X>>(x: T): (y: number) => void {\n}\n// Adds one to what is given.\nn(x: T): { a: { b: string }; c: number } | { d: X } {\n}\n// Adds one to what is given.\np = async x => {\n};\n// Adds one to what is given.\nq: Foo = function (x) {\n};\n// Adds one to what is given.\nr: (x: number) => void;\n// Adds one to what is given.\nabstract s(x): void;\n// Adds one to what is given.\nt(x?: string);\n// Adds one to what is given.\n@dec() u(x) {\n}\n// Adds one to what is given.\n@dec({\n a: 1\n}) v(x) {\n}\n// Adds one to what is given.\n#w(x): x is Foo {\n}\n// Adds one to what is given.\n*y(x) {}\n// Adds one to what is given.\nz(x): -1 | 1;\n}\n', ['m', 'n', 'p', 'q', 's', 't', 'u', 'v', '#w', 'y', 'z']),
    ("ecma", 'interface A {\n// Adds one to what is given.\nm(x: number): void\n// Adds one to what is given.\nn(x): {\n a: string;\n}\n// Adds one to what is given.\np: (x: number) => void;\n// Adds one to what is given.\nnew (x: number): A;\n// Adds one to what is given.\nq?(x): void,\n}\n', ['m', 'n', 'q']),
    ("ecma", 'type A<T> = {\n// Adds one to what is given.\nm(x: number): void\n// Adds one to what is given.\np: (x: number) => void;\n}\n', ['m']),
    ("ecma", "export default {\n// Adds one to what is given.\na: function (x) {\n},\n// Adds one to what is given.\nb: async (x) => {\n},\nmethods: {\n// Adds one to what is given.\nc: x => x,\n// Adds one to what is given.\n'd': (x) => x,\n// Adds one to what is given.\ne(x) {\n},\n// Adds one to what is given.\nif(x) {\n},\n// Adds one to what is given.\nf: foo(x),\n}\n};\n", ['a', 'b', 'c', 'd', 'e', 'if']),
    ("ecma", '// Adds one to what is given.\nexports.a = function (x) {\n};\n// Adds one to what is given.\nFoo.prototype.b =\n function (x) {\n};\n// Adds one to what is given.\nmodule.exports = function c(x) {\n};\n// Adds one to what is given.\nmodule.exports = (x) => {\n};\n// Adds one to what is given.\nthis.d = e.f = async () => {\n};\n// Adds one to what is given.\nx.y = z(1);\n', ['a', 'b', 'c', 'd']),
    ("ecma", '// Adds one to what is given.\nfunction /* n */ foo /* a */ (x) {\n}\n// Adds one to what is given.\n/* istanbul ignore next */ function bar(x) {\n}\n// Adds one to what is given.\nfunction $(x) {\n}\n// Adds one to what is given.\nexport default async function of(x) {\n}\n', ['foo', 'bar', '$', 'of']),
    ("ecma", 'foo(a,\n// Adds one to what is given.\nfunction (x) {\n});\nfoo({ a:\n// Adds one to what is given.\nfunction (x) {\n}});\nfunction g(\n// Adds one to what is given.\ncb: (x: number) => void,\n) {\n}\n', []),
]


@pytest.mark.parametrize("family, text, names", FURTHER)
def test_documentation_of_further_forms(family, text, names):
    assert [n for n, _, _ in docpairs.pairs(text, family)] == names
    assert [n for n, _, _ in docpairs.pairs(text.replace("\n", "\r\n"), family)] == names


def test_documentation_of_chunks(spark):
    good = "// Adds one to what is given.\nfunc A(x int) int {\n}\n"
    rows = [("1", "a.go", good, " Function "), ("1", "a.go", good, "function"), ("2", "a.go", good, "block"), ("3", "a.go", None, "class"), ("4", "a.go", "", "class"), ("5", None, good, "class"), ("6", "a.md", good, "class"), ("7", "a.go", good, None), (None, "a.go", good, "CLASS"), (None, "a.go", good, "CLASS"), (None, "b.go", good, "CLASS"), ("8", "a.go", good * 3000, "class")]
    chunks = spark.createDataFrame(rows, "id string, file_path string, content string, type string").withColumns({"line": F.lit(1), "family": F.lit(2)})
    found = docpairs.documented_functions(chunks).collect()
    assert Counter(r.id for r in found) == {"1": 1, None: 2, "8": 3000}
    assert found[0].description == "Adds one to what is given."
    assert docpairs.documented_functions(chunks.limit(0)).count() == 0


# 4: provenance
HAND = "import os\n\n\ndef compute_totals(rows):\n    total = 0\n    for row in rows:\n        total += row.amount * row.factor\n    return total\n\n\ndef report(rows):\n    print('the total of all rows is', compute_totals(rows))\n    return os.getcwd()\n"


@pytest.mark.parametrize(
    "path, text, reason",
    [
        ("r/a.py", HAND, None), ("r/vendor/x/a.py", HAND, "vendored"), ("r/vendor_portal/a.py", HAND, None), ("r/src/third_party/a.go", "package a", "vendored"), ("r/builders/a.py", HAND, None),
        ("r/a.py", "# Code generated by x 1.2. DO NOT EDIT.\n" + HAND, "generated"), ("r/a.py", HAND + "# AUTOGENERATED - manual changes will be overwritten\n", "generated"), ("r/a.py", HAND + "X = 'Code generated by x'\n", None),
        ("r/a.py", "# Feeds the generated report; edit the journal here.\n" + HAND, None), ("r/a.py", "# Copyright the tool owners\n#\n# @generated from x.schema\n" + HAND, "generated"), ("r/a.ts", "// Fichier produit par outil, ne pas modifier\nlet x = 1;\n", "generated"),
        ("r/a.py", "# Imported verbatim from lib 1.2; send changes upstream.\n" + HAND, "vendored"), ("r/a.py", "# lib v2.3.1 - copied from upstream, see https://x\n" + HAND, "vendored"), ("r/a.py", "# Works around a bug in the third party library.\n" + HAND, None),
        ("r/a.min.js", "let a=1", "minified"), ("r/a.js", "var a=" + "+".join(f"b{i}.c(d)" for i in range(300)) + ";", "minified"), ("r/a.py", "# " + "long comment " * 100 + "\n" + HAND, None), ("r/a.pb.go", "package a", "generated"),
        ("r/a.py", "DATA = [\n" + "".join(f"    {i}, {i * 7}, {i * 13},\n" for i in range(80)) + "]\n", "data"), ("r/a.py", "TABLE = [1, 2, 3, 4, 5, 6]\n" + HAND, None), ("r/a.rs", 'pub const B: &str = "' + "Ab9" * 300 + '";\n', "data"),
        ("r/a.py", "".join(f"def get_x{i}(m):\n    return m[{i}]\n\n" for i in range(12)), None), ("r/a.py", "", None), ("r/a.py", "# only a comment\n", None),
    ],
)
def test_verdicts(path, text, reason):
    assert (provenance.verdict(path, text)[2] is None) == (reason is None)
    assert provenance.verdict(path, text)[0] == reason
    assert provenance.verdict(path, text.replace("\n", "\r\n"))[0] == reason


@pytest.mark.parametrize(
    "line, tools, others",
    [
        ("// Code generated by protoc-gen-go. DO NOT EDIT.", 1, 0), ("# This file is automatically generated.", 1, 0), ("/* AUTO-GENERATED FILE. DO NOT MODIFY. */", 1, 0), (" * Diese Datei wurde von werkzeug automatisch erzeugt.", 1, 0), ("# Este archivo fue generado por x; no editar", 1, 0),
        ("// Ce fichier est généré automatiquement", 1, 0), ("// Generated using x.y 2.0", 1, 0), ("# Generated by Django 4.2 on 2023-01-01", 1, 0), ("// <auto-generated />", 1, 0), ("// Changes to this generated file will be lost", 1, 0), ("# Compiled from grammar.y; do not edit", 1, 0),
        ("# id is generated by the digest", 0, 0), ("// Feeds the generated report; edit the journal here.", 0, 0), ("// The reports are created by the scheduler", 0, 0), ("# Written by the platform team", 0, 0), ("# Created by Jane on a Monday", 0, 0), ("# This file was created automatically by x", 1, 0), ("// Use the built image, see the wiki", 0, 0), ("# Never edit the queue while it runs", 0, 0),
        ("// Copied from https://example.org/x under the MIT licence", 0, 1), ("# Vendored snapshot of lib@1.2.3", 0, 1), ("/* This is a fork of lib 4.5 */", 0, 1), ("# lib v1.2 - mirrored from upstream", 0, 1), ("// Do this here until it is maintained upstream", 0, 1), ("// the offset is copied from upstream rows", 0, 0), ("# Keeps a copy of the rows", 0, 0), ("// Copyright 2.0 the authors", 0, 0),
    ],
)
def test_notices(line, tools, others):
    assert (provenance._tools(line), provenance._others(line)) == (bool(tools), bool(others))


@pytest.mark.parametrize("share, hot", [(0.8, 500_000), (0.3, 500_000), (0.3, 1), (0.5, 7), (1.0, 500_000)])
def test_containment(spark, monkeypatch, share, hot):
    """Against all pairs of contents."""
    monkeypatch.setattr(hot_keys, "HOT", hot)
    r = random.Random(8)
    lines = [f"a line of code, number {i:03}" for i in range(60)]
    rows = []
    for i in range(90):
        of = r.sample(lines, r.randrange(1, 25)) if i % 3 else lines[: r.randrange(3, 50)]
        rows.append((i if i % 7 else None, f"r{r.randrange(4)}", f"x/{'vendor/' if r.random() < 0.4 else ''}f{i}.py", "\n".join(of) + r.choice(["", "\n}", "\r\n"])))
    files = spark.createDataFrame(rows + rows[:9], "file_id long, repo string, path string, content string")
    repos, split = defaultdict(set), {c: {x.strip() for x in c.splitlines() if len(x.strip()) >= 12} for _, _, _, c in rows}
    for _, repo, path, c in rows:
        repos[c, "vendor/" in path].add(repo)
    want = {}
    for _, repo, path, c in rows:
        if "vendor/" not in path:
            found = [len(split[c] & split[t]) / len(split[c]) for t, inside in repos if inside and (len(repos[c, False] | repos[t, True]) > 1)]
            if found and max(found) >= share:
                want[path] = max(found)
    got = provenance.containment(files, share).collect()
    assert {r.path: r.containment for r in got} == want and len(got) == len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_containment_in_the_tables(spark):
    """A small share, which many files reach, against SQL."""
    import duckdb

    files = SF.replace("sf0.001", "sf0.01") + "/files.parquet"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW files AS SELECT * FROM '{files}'")
    want = {k: v for k, v in duck.execute(queries.contained_sql(0.1)).fetchall()}
    got = {r.file_id: round(r.containment, 9) for r in provenance.containment(spark.read.parquet(files), 0.1).collect()}
    assert got == want and len(got) > 30


@pytest.mark.parametrize("hot", [500_000, 1])
def test_edited_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(hot_keys, "HOT", hot)
    body = "".join(f"def function_number_{i}(a, b):\n    return a * {i} + b ** {i + 1}\n\n\n" for i in range(0, 40, 2))
    edited = "# Copyright the other authors\n" + body.replace("a * 6 +", "a - 6 +")
    rows = [
        (1, "r1", "r1/vendor/lib/a.py", body), (2, "r2", "r2/src/b.py", edited), (2, "r2", "r2/src/b.py", edited), (3, "r3", "r3/src/c.py", body), (4, "r1", "r1/src/d.py", HAND), (5, "r4", "r4/x.json", "{}"), (6, "r4", "r4/n.py", None), (7, "r4", "r4/e.py", " "), (8, "r4", None, HAND),
        (9, "r2", "r2/src/k.py", "# Copyright the r2 team\n" + body), *((100 + i, "r9", f"r9/copy{i}.py", HAND) for i in range(30)),
    ]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string").withColumns({"reason": F.lit(1), "lines": F.lit(2)})
    got = {r.file_id: r for r in provenance.provenance(files).collect()}
    assert {k: r.reason for k, r in got.items() if k < 100} == {1: "vendored", 2: "vendored", 3: None, 4: None, 9: None}
    assert got[3].containment == 1.0 and got[2].containment > 0.9 and got[9].containment > 0.9 and got[4].containment is None and len(got) == 35
    assert provenance.provenance(files.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [500_000, 1])
def test_copies_of_what_many_hold(spark, monkeypatch, hot):
    monkeypatch.setattr(hot_keys, "HOT", hot)
    body = "".join(f"def function_number_{i}(a, b):\n    return a * {i} + b ** {i + 1}\n\n\n" for i in range(0, 40, 2))
    versions = [(i, f"v{i}", f"v{i}/vendor/lib/a.py", body + f"RELEASED_AS = 'version {i}'\n") for i in range(provenance.RARE + 5)]
    # the licence is common too, but makes no copy of what holds little else
    licence = "".join(f"# a line of the licence that everyone has, number {i}\n" for i in range(30))
    versions += [(200 + i, f"w{i}", f"w{i}/vendor/lib/b.py", licence + f"A_NAME_OF_LIBRARY = {i}\n") for i in range(provenance.RARE + 5)]
    copy = "# Copyright the other authors\n" + body.replace("a * 6 +", "a - 6 +")
    files = spark.createDataFrame([*versions, (100, "r1", "r1/src/c.py", copy), (101, "r1", "r1/src/d.py", licence + HAND * 3 + "".join(f"own_name_{i} = {i}\n" for i in range(20)))], "file_id long, repo string, path string, content string")
    got = {r.file_id: r for r in provenance.provenance(files).collect()}
    assert got[100].reason == "vendored" and got[100].containment > 0.9
    assert got[101].reason is None and got[101].containment is None


# 5: splitting
def check_pieces(text, pieces, limit=800, overlap=160):
    assert "".join(p[0] for p in pieces) == text
    for k, (content, start, end, context) in enumerate(pieces):
        assert content and len(content) + (len(context) if k else 0) <= limit
        before = text[: sum(len(p[0]) for p in pieces[:k])]
        assert start == 10 + before.count("\n") and end == start + content[:-1].count("\n")
        if k:
            tail = pieces[k - 1][0][-overlap:]
            assert context == (pieces[k - 1][0] if len(pieces[k - 1][0]) <= overlap else "..." + tail)


def split(spark, texts, **how):
    rows = [(str(i), "p", t, 10, "own") for i, t in enumerate(texts)]
    out = defaultdict(list)
    for r in splitting.split_oversized(spark.createDataFrame(rows, "id string, file_path string, content string, start_line int, context_prev string"), **how).orderBy("id", "piece").collect():
        out[int(r.id)].append((r.content, r.start_line, r.end_line, r.context_prev))
    return out


def long_texts():
    r = random.Random(3)
    yield from ["x" * 801, "é" * 5000, "word " * 400, "a\n" * 900, "\r\n".join("w" * r.randrange(150) for _ in range(60)), "\n" * 2000, " " * 3000, "a" * 700 + "\n" + "b" * 700, "\U0001f600" * 900, "x" * 100_000 + " y" * 300]
    for _ in range(30):
        yield "".join(r.choice(["def f(a):\n", "    return " + "x" * r.randrange(90) + "\n", "\n", "    y = " + "zz " * r.randrange(200) + "\n", "}\n"]) for _ in range(r.randrange(40, 200)))


def test_pieces(spark):
    texts = [t for t in long_texts() if len(t) > 800]
    got = split(spark, texts)
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        check_pieces(t, got[i])


def test_pieces_are_the_greedy_ones(spark):
    """Pointer doubling against one cut after the other."""
    for text in [t for t in long_texts() if len(t) > 800][:25]:
        [fast] = splitting.cuts([text])
        at, rank = splitting.boundaries(text, 800 - 163)
        where = {int(p): i for i, p in enumerate(at)}
        now, slow = 0, [0]
        while now < len(text):
            reach = 800 if now == 0 else 637
            far = [p for p in at if now < p <= now + reach]
            line = [p for p in far if rank[where[int(p)]] >= 1]
            block = [p for p in far if rank[where[int(p)]] >= 2 and p > now + reach / 2]
            now = int(len(text) if len(text) - now <= reach else (block or line or far)[-1])
            slow.append(now)
        assert fast.tolist() == slow


def test_natural_places(spark):
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 20 + "\n" for i in range(20))
    assert all(p[0].startswith("def f") for p in split(spark, [text])[0])
    assert split(spark, ["x" * 800, "", "short"]) == {} and len(split(spark, ["x" * 31], limit=10, overlap=0)[0]) == 4


def test_chunks_that_are_not_clean(spark):
    rows = [("1", None, "y" * 900, None, None), ("1", None, "y" * 900, None, None), (None, "p", "z\n" * 500, 1, None), (None, "p", "z\n" * 500, 1, None), (None, "q", "z\n" * 500, 1, None), ("2", "p", None, 1, None)]
    chunks = spark.createDataFrame(rows, "id string, file_path string, content string, start_line int, context_prev string").withColumns({"piece": F.lit(9), "end_line": F.lit(9)})
    got = splitting.split_oversized(chunks).collect()
    assert Counter(r.id for r in got) == {"1": 2, None: 4} and all(r.start_line is None for r in got if r.id == "1")
    assert splitting.split_oversized(chunks.limit(0)).count() == 0


# 6: packing
def test_boundaries_are_optimal():
    r = random.Random(2)
    import itertools

    
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 40), 7)))
        counts = np.array([r.randrange(1, 9) for _ in lengths])
        for k in (1, 2, 3, 7, 20):
            pad = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))  # noqa: E731, B023
            best = min(pad((*x, lengths[-1])) for m in range(min(k, 7)) for x in itertools.combinations(lengths[:-1], m))
            found = packing.boundaries(lengths, counts, k)
            assert len(found) <= k and pad(found) == best


def test_boundaries_of_many_lengths():
    """Against the dynamic programme without bounds."""
    r = np.random.default_rng(3)
    for n, k in ((60, 5), (200, 30), (333, 100)):
        lengths, counts = np.sort(r.choice(np.arange(1, 2049), n, False)), r.integers(1, 1000, n)
        number, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
        cost = lambda i, j: lengths[j] * (number[j + 1] - number[i]) - (total[j + 1] - total[i])  # noqa: E731, B023
        best = [cost(0, j) for j in range(n)]
        for _ in range(k - 1):
            best = [min([best[j], *(best[i - 1] + cost(i, j) for i in range(1, j + 1))]) for j in range(n)]
        ends = packing.boundaries(lengths, counts, k)
        assert sum(c * (ends[np.searchsorted(ends, x)] - x) for x, c in zip(lengths, counts)) == best[-1]


@pytest.mark.parametrize("sizes", [[], [0, 0], [5], [2048] * 3, [2049, 5000, 1], [1100] * 40 + [900] * 40, [random.Random(1).randrange(1, 700) for _ in range(900)], [7] * 3000])
def test_windows(spark, sizes):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(10**6, None)], "k long, s long").withColumns({"bucket": F.lit("x"), "window": F.lit(1)})
    got = packing.pack(df, "k", "s").collect()
    by, parts = defaultdict(int), defaultdict(list)
    for r in got:
        by[r.window_id] += r["size"]
        parts[r.k].append((r.part, r.start, r["size"]))
    assert all(v <= 2048 for v in by.values()) and set(parts) == set(range(len(sizes)))
    for k, ps in parts.items():
        assert sum(p[2] for p in ps) == sizes[k] and (len(ps) == 1) == (sizes[k] <= 2048) and len({(p[0], p[1]) for p in ps}) == len(ps)
    least = -(-sum(sizes) // 2048)
    if len(sizes) > 100:
        assert len(by) <= 1.05 * least + 1


def test_tokens(spark):
    vocabulary = packing.VOCABULARY
    if not os.path.exists(vocabulary):
        pytest.skip("no vocabulary")
    e = packing.encoding(vocabulary)
    r = random.Random(4)
    mixed = "".join(r.choices(["word", " ", "  ", "\n", "'s", "12", "...", "é", "\u00a0", "longerword", "\x1c"], k=40_000))
    for text in ("", "hello world", "naïve <|endoftext|> text", "x" * 3000, "some words " * 30_000, "y" * 250_000, "ab1" * 90_000, " " * 210_000 + "end", mixed, "a b" * 60_000):
        assert packing.count_tokens(text) == len(e.encode_ordinary(text))
    assert packing.count_tokens(" " * 2_000_000) == packing.count_tokens(" " * 2_000_000 + "\nend") - 2 > 0
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "word " * 5000)], "doc_id long, text string").withColumn("size", F.lit("x"))
    got = packing.windows_of_documents(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 4} and packing.fill(packing.windows_of_documents(docs)).first().windows == 3


# 7: leakage
def brute_leaks(docs, items):
    known = defaultdict(set)
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - 11):
            known[tuple(w[k : k + 12])].add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t or "")] for k in range(len(w) - 11) for i in known.get(tuple(w[k : k + 12]), ())}


def leak_tables(spark):
    r = random.Random(9)
    pick = lambda n: " ".join(r.choice(["alpha", "Beta", "gamma", "x1", "ÉTÉ", "straße", "the"]) + r.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, pick(r.randrange(5, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "one two three four five six seven eight nine ten eleven twelve"), (93, "one two three four five six seven eight nine ten eleven twelve")]
    docs = []
    for d in range(120):
        i, t = r.choice(items[:30])
        w = t.split()
        a = r.randrange(max(1, len(w) - 5))
        docs.append((d, pick(20) + " -- " + " ".join(w[a : a + r.randrange(8, 30)]).upper() + " -- " + pick(10)))
    docs += [(500, None), (501, ""), (502, "ONE-two_three four;five six seven eight nine ten eleven TWELVE"), (503, "one two three four five CHANGED seven eight nine ten eleven twelve"), (504, "x " * 100_000), (502, "ONE-two_three four;five six seven eight nine ten eleven TWELVE")]
    schema = "{} long, text string"
    return docs, items, spark.createDataFrame(docs, schema.format("doc_id")).withColumn("run", F.lit(1)), spark.createDataFrame(items, schema.format("item_id"))


def brute_overlaps(docs, items):
    """Longest overlap, where it begins and the most equal words within one, by looking at every alignment."""
    out = {}
    for (d, dt), (i, it) in itertools.product(docs, items):
        a, b = leakage.words(dt or ""), leakage.words(it or "")
        best = None
        for shift in range(-len(a) + 12, len(b) - 11):
            low, high = max(0, -shift), min(len(a), len(b) - shift)
            same = [a[k] == b[k + shift] for k in range(low, high)]
            good = [sum(same[k : k + 12]) >= 9 for k in range(len(same) - 11)]
            at = 0
            for ok, group in itertools.groupby(good):
                n = len(list(group))
                if ok:
                    inside = same[at : at + n + 11]
                    run = max(len(list(g)) for x, g in itertools.groupby(inside) if x)
                    best = (max(best[0] if best else 0, run), max(best[1] if best else (0, 0), (n + 11, -(low + at))))
                at += n
        if best:
            out[d, i] = (best[0], best[1][0], -best[1][1])
    return out


@pytest.mark.parametrize("few, hot", [(100_000, 500_000), (0, 500_000), (0, 3)])
def test_leaks(spark, monkeypatch, few, hot):
    monkeypatch.setattr(leakage, "FEW", few)
    monkeypatch.setattr(hot_keys, "HOT", hot)
    docs, items, d, i = leak_tables(spark)
    got = leakage.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.run >= 12} == brute_leaks(docs, items)
    assert Counter((r.doc_id, r.item_id) for r in got).most_common(1)[0][1] == 1
    near = brute_overlaps([x for x in docs if x[0] % 6 == 0 and x[0] != 504 or x[0] == 503], items)
    assert {(r.doc_id, r.item_id): (r.run, r.overlap, r.at_word) for r in got if r.doc_id % 6 == 0 or r.doc_id == 503} == near
    changed = [r for r in got if r.doc_id == 503]
    assert {r.item_id for r in changed} == {92, 93} and all(r.run == 6 and r.overlap == 12 for r in changed)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_no_filter_loses_a_leak(spark, monkeypatch):
    """A Bloom filter that is far too small lets more pass, and nothing less."""
    monkeypatch.setattr(leakage, "LARGEST", 1 << 10)
    docs, items, d, i = leak_tables(spark)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).filter("run >= 12").collect()} == brute_leaks(docs, items)


def leaked(spark, texts, item):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.run, r.overlap, r.at_word) for r in leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}


def test_every_substitution_is_met(spark):
    words = [f"w{i}" for i in range(12)]
    texts = ["x y " + " ".join("other" if i in gone else w for i, w in enumerate(words)) + " z" for n in (1, 2, 3, 4) for gone in itertools.combinations(range(12), n)]
    got = leaked(spark, texts, " ".join(words))
    assert set(got) == set(range(12 + 66 + 220)) and all(x[1:] == (12, 2) for x in got.values())


def test_every_fourth_word_substituted(spark):
    words = [f"w{i}" for i in range(200)]
    got = leaked(spark, [" ".join("other" if i % 4 == phase else w for i, w in enumerate(words)) for phase in range(4)], " ".join(words))
    assert got == {phase: (3, 200, 0) for phase in range(4)}


def test_the_longest_overlap_of_any_alignment(spark):
    words = [f"w{i}" for i in range(60)]
    # an exact run of ten words with too few equal ones around, then a long overlap with a shorter run
    text = [*words[:10], *["other"] * 20, *("other" if i % 5 == 0 else words[i] for i in range(15, 55))]
    brute = brute_overlaps([(0, " ".join(text))], [(7, " ".join(words))])[0, 7]
    assert leaked(spark, [" ".join(text)], " ".join(words)) == {0: brute} and brute[1] > 36


def test_rows_without_ids(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, item + " a"), (None, item + " b"), (None, item + " a"), (1, item)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, item + " thirteen"), (5, item)], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()) == {(None, None): 4, (None, 5): 2, (1, None): 2, (1, 5): 1}


# 8: personal information
TEXTS = [
    ("Contact: jane.doe+x@mail.acme.example.org.", [("email", "jane.doe+x@mail.acme.example.org")]),
    ("mailto:support @ acme.example\nteam-a AT acme dot example, x_y [at] acme [dot] test; <bob(at)acme.example>", [("email", "support @ acme.example"), ("email", "team-a AT acme dot example"), ("email", "x_y [at] acme [dot] test"), ("email", "bob(at)acme.example")]),
    ("git@forge.invalid:a/b.git pinned kit@1.2.3, @decorator.name, ping @bob; The decorator @a.b hides", []),
    ("Call me on (212) 555-0144 ext. 7 or +49 (0)30 23125-019, 646.555.0140; Tel. 030/23125 118, 01.99.00.41.58", [("phone", "(212) 555-0144 ext. 7"), ("phone", "+49 (0)30 23125-019"), ("phone", "646.555.0140"), ("phone", "030/23125 118"), ("phone", "01.99.00.41.58")]),
    ("Version 288.5.13, ports 306-1303-64, row 2024-51770670, checksum 920:32480370:3614, 192.0.2.5:3733, Serial QQ-831-7", []),
    ("SSN=955-99-7397 and 905 20 6604, NINO QQ 05 68 33 C or QQ898519A, NIR 3 92 13 99 023 378 92, Steuer-ID is 00 088 836 027, DNI 00064159-G, passport no. XK00779688", [("idnum", x) for x in ("955-99-7397", "905 20 6604", "QQ 05 68 33 C", "QQ898519A", "3 92 13 99 023 378 92", "00 088 836 027", "00064159-G", "XK00779688")]),
    ("Ship to 88 Saltmarsh Road, Apt 1B, Port Ellory, ZZ 00440. Flat 21, 210 Alder Row, Tarnfield, WX0 0ZZ; 69 Cinder Ave.", [("address", "88 Saltmarsh Road, Apt 1B, Port Ellory, ZZ 00440"), ("address", "Flat 21, 210 Alder Row, Tarnfield, WX0 0ZZ"), ("address", "69 Cinder Ave")]),
    ("Adresse : 132 bis rue des Tilleuls,\n00517 Roquelune\n\nAnschrift: Am Torfgraben 5a, 00239 Klein Wieden. Domicilio: Avda. de las Salinas 183, 2.º B, 00736 Costanera del Mar", [("address", "132 bis rue des Tilleuls,\n00517 Roquelune"), ("address", "Am Torfgraben 5a, 00239 Klein Wieden"), ("address", "Avda. de las Salinas 183, 2.º B, 00736 Costanera del Mar")]),
    ("The Harbor Street release train. See section 12 Main Thread, step 5. 789 stops at Lane 7.", []),
    ("cc Brandetti, Amara, Oskar van Dunvold\nMrs. Elena B. Morari and R. Pellvold; Signed-off-by: Nadia Velvold-Ulvari <x@y.example>", [("person", "Brandetti, Amara"), ("person", "Oskar van Dunvold"), ("person", "Elena B. Morari"), ("person", "R. Pellvold"), ("person", "Nadia Velvold-Ulvari"), ("email", "x@y.example")]),
    ("The Elena Scheduler module. Dear Lantern Team, branch elena/x-1. Thanks, all. Elena alone.", []),
    ("Thanks go to Oluwaseun Adebayo. We spoke with Xiaoming Zhang about it. Reviewed with Thandiwe Nkosi. Ibrahim Traoré reported it. cc Aoife Byrne, Siddharth Rao", [("person", x) for x in ("Oluwaseun Adebayo", "Xiaoming Zhang", "Thandiwe Nkosi", "Ibrahim Traoré", "Aoife Byrne", "Siddharth Rao")]),
    ("We moved from San Francisco to New York. The Jonas Scheduler asked for memory. Thanks to the Harbor Team. Fixed by Monday Morning, FOR GAUGE NUMBER 7. It reads from Parcel Sampler, the parcel sampler.", []),
    ("Geändert von Rudari, Elena\nElena\u00a0Pellvold asked", [("person", "Rudari, Elena"), ("person", "Elena\u00a0Pellvold")]),
]
KNOWN = pii.Known({"amara", "oskar", "elena", "nadia"}, {"pellvold", "brandetti"})


@pytest.mark.parametrize("text, want", TEXTS)
def test_mentions(text, want):
    spans = pii.mentions(text, KNOWN)
    assert [(k, text[s:e]) for s, e, k in spans] == want
    red = pii.redact(text, spans)
    assert all(v not in red for _, v in want) and sum(red.count(p) for p in pii.PLACEHOLDERS.values()) == len(want)


@pytest.mark.parametrize("text", ["+49 30\n        1234567", "+1 212\n            555 0144", "\n    +44 20\n        7946 0958 more", "+1 212\r\n      555 0144", "+\n                44 20 7946 0958", "(212) 555-0144,\n                  ext. 71 more"])
def test_numbers_over_indented_lines(text):
    assert [(k, text[s:e]) for s, e, k in pii.mentions(text, KNOWN)] == [("phone", text.strip().removesuffix(" more"))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789", "12", "345", "6789", " ", "\n      ", "\r\n     ", "-", ".", "/", "(", ")", "(0)", "+", "+44", "A", "XY", "a", ",", ":", " ext. ", "x", "Durchwahl "]), max_size=30).map("".join))
def test_no_pattern_reads_beyond_a_stretch(text):
    spans = [m.span() for m in pii._STRETCH.finditer(text) if pii._digits(m[0]) >= 6]
    for p in [*pii._IDS, *pii._PHONES]:
        for m in p.finditer(text):
            assert pii._digits(m[0]) < 6 or any(s <= m.start() and m.end() <= e for s, e in spans)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA bE@.,+()0123456789-\nRoadApt\u00e9:", max_size=80))
def test_mentions_of_any_text(text):
    spans = pii.mentions(text, KNOWN)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(0 <= s < e <= len(text) for s, e, _ in spans)


@pytest.mark.parametrize("people, hot", [(200_000, 500_000), (2, 500_000), (2, 1)])
def test_redaction(spark, monkeypatch, people, hot):
    monkeypatch.setattr(pii, "PEOPLE", people)
    monkeypatch.setattr(hot_keys, "HOT", hot)
    docs = spark.createDataFrame([(1, "cc Zugor Pellvold, Xanti Qwerty\nx@y.example"), (2, ""), (3, None), (4, "a " * 50_000), (5, "nothing"), (5, "nothing"), (6, "Zugor Qwerty is here"), (6, "Zugor Qwerty is here"), (None, "Xanti Pellvold is here")], "doc_id long, text string").withColumns({"mentions": F.lit(1), "redacted": F.lit(2)})
    known = spark.createDataFrame([("Zugor", "Pellvold"), (None, None), ("Xanti", "Qwerty"), ("Ab", "Cd"), ("Zugor", "Pellvold"), ("", " ")], "given_name string, family_name string")
    rows = pii.find_pii(docs, known).collect()
    got = {r.doc_id: r.redacted for r in rows}
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, None: 1}
    assert got[1] == "cc [PERSON], [PERSON]\n[EMAIL]" and got[2] == "" and got[3] is None and got[5] == "nothing" and got[6] == "[PERSON] is here" and got[None] == "[PERSON] is here"
    assert {(r.pii_type, r.value) for r in pii.found_pii(docs, known).collect()} == {("person", x) for x in ("Zugor Pellvold", "Xanti Qwerty", "Zugor Qwerty", "Xanti Pellvold")} | {("email", "x@y.example")}
    assert pii.found_pii(docs.limit(0), known).count() == 0 and pii.found_pii(docs, known.limit(0)).count() >= 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_joined_names_give_the_same(spark, monkeypatch):
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "contributors"))
    sent = sorted(map(repr, pii.find_pii(docs, known).collect()))
    monkeypatch.setattr(pii, "PEOPLE", 5)
    assert sorted(map(repr, pii.find_pii(docs, known).collect())) == sent


# all
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name.endswith("_found"):
        assert got and len(set(got)) == len(got)
    if name in queries.SQL:
        import duckdb

        c = duckdb.connect()
        for p in glob.glob(SF + "/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert got == sorted(map(repr, c.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()))
