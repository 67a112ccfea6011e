import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.errors import CorvaneError
from corvane.functions import text as X
from corvane.operators import bm25, braces, chunking, delta, graph, grep, outline, pack, probe
from corvane.sources import files as sources


def brute_fold(text):
    if not text.strip():
        return []
    lines, out, now, size, start = text.split("\n"), [], [], 0, 0
    for i, line in enumerate([*lines, None]):
        if line is None or size >= 800:
            body = "\n".join(now)
            if now and len(body.strip()) >= 50:
                out.append((start + 1, i, body))
            now, size, start = [], 0, i
        if line is not None:
            now.append(line)
            size += len(line) + 1
    return out


def texts():
    r = random.Random(1)
    yield from ["", " \n\t", None, "x" * 49, "x" * 50, "a" * 2000, "a" * 799 + "\n" + "b" * 60, "a" * 798 + "\n" + "b" * 10, "k\r\n" * 400, "é" * 800 + "\n", "\n" * 900 + "z" * 60]
    for _ in range(20):
        yield "\n".join("w" * r.randrange(0, 120) for _ in range(r.randrange(1, 60)))


def test_fold(spark):
    rows = list(enumerate(texts()))
    got = chunking.chunk_lines(spark.createDataFrame(rows, "path int, content string")).collect()
    assert sorted((r.path, r.start_line, r.end_line, r.content) for r in got) == sorted((i, a, b, c) for i, t in rows if t is not None for a, b, c in brute_fold(t))


PY = '"""Doc."""\nimport os\n\n\n' + "X = 1  # a value that is long enough to be kept as a block of its own\n\n\n@deco\ndef one(a, b=2):\n    return a + b + one(1, 2) + two(3)  # padding\n\n\nclass Two(Base):\n    def m(self):\n        return 'a text that makes this long enough'\n"


def test_definitions(spark):
    files = spark.createDataFrame([("a.py", PY), ("bad.py", "def f(:\n" + "x" * 60), ("t.md", "# title\n" + "words " * 20), ("e.py", ""), ("n.py", None)], "path string, content string")
    got = {(r.path, r.type, r.name) for r in chunking.chunk_definitions(files).collect()}
    assert got == {("a.py", "anchor", ""), ("a.py", "block", ""), ("a.py", "function", "one"), ("a.py", "class", "Two"), ("bad.py", "block", ""), ("t.md", "block", "")}
    full = chunking.neighbours(chunking.chunk_definitions(files), files)
    one = full.filter("name = 'one'").first()
    assert "# ... (context from lines" in one.content and "# ... (continues at line" in one.content and one.context_next.startswith("class Two")
    stored = chunking.indexed(chunking.chunk_definitions(files))
    assert stored.count() == stored.select("id").distinct().count() == 6


def test_long_definitions_are_split(spark):
    code = "def f():\n" + "".join(f"    x{i} = {i} * 'some words to fill the line'\n\n" for i in range(60))
    parts = chunking.chunk_definitions(spark.createDataFrame([("a.py", code)], "path string, content string")).filter("type = 'function'").orderBy("start_line").collect()
    assert len(parts) > 2 and all(len(p.content) < 900 for p in parts)
    assert [p.start_line for p in parts[1:]] == [p.end_line + 1 for p in parts[:-1]]


def brute_bm25(docs, query, overlap=True):
    n, avg = len(docs), sum(len(set(d)) for d in docs.values()) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in query}
    idf = {t: math.log((n + 1) / f) for t, f in df.items() if f}
    out = {}
    for k, d in docs.items():
        hit = [t for t in idf if t in d]
        if hit or not overlap:
            out[k] = 0.5 * sum(idf.values()) + sum(idf[t] for t in hit) * 2.5 / (1.5 * (0.25 + 0.75 * len(set(d)) / avg) + 1)
    return out


@pytest.mark.parametrize("overlap", [True, False])
def test_bm25(spark, overlap):
    docs = {1: "alpha beta gamma", 2: "beta beta delta", 3: "alpha", 4: "zeta eta theta iota", 5: ""}
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda x: x != "")
    got = {r.id: r.score for r in bm25.score_all(df, words(F.col("text")), ["alpha", "beta", "absent"], require_overlap=overlap).collect()}
    want = brute_bm25({k: set(v.split()) for k, v in docs.items()}, ["alpha", "beta", "absent"], overlap)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert bm25.score_all(df, words(F.col("text")), ["absent"]).count() == 0
    assert bm25.score_all(df, words(F.col("text")), []).count() == 0


def test_many_searches_agree_with_one(spark):
    df = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcdefgh", k=6))) for i in range(40)], "id int, text string")
    words = lambda c: F.array_distinct(F.split(c, " "))
    posting = bm25.postings(df, "id", words(F.col("text")))
    n, avg = df.agg(F.count("*"), F.avg(F.size(words(F.col("text"))))).first()
    q = spark.createDataFrame([("q", "a"), ("q", "c")], "qid string, term string")
    many = {r.id: r.score for r in bm25.search_many(posting, n, avg, q, "id", 100).collect()}
    one = {r.id: r.score for r in bm25.score_all(df, words(F.col("text")), ["a", "c"]).collect()}
    low = min(one[k] - many[k] for k in one)
    assert many.keys() == one.keys() and all(abs(one[k] - many[k] - low) < 1e-9 for k in one)


def test_grep(spark):
    files = spark.createDataFrame([("a", "aaaaa\nx"), ("b", "first\nsecond line\nfirst again"), ("c", "first\n" * 9), ("d", None), ("e", ""), ("f", "q.q\nqxq")], "path string, content string")
    assert [(r.file, r.line) for r in grep.grep_literal(files, "aaa").collect()] == [("a", 1)] * 3
    assert [(r.file, r.line) for r in grep.grep_literal(files, "first").collect()] == [("b", 1), ("b", 3), *(("c", i) for i in range(1, 6))]
    assert grep.grep_literal(files, "q.q").count() == 1
    posting = grep.postings(files)
    for p in ("first", "aaa", "second line"):
        assert grep.grep_literal(files, p, None, posting).exceptAll(grep.grep_literal(files, p, None)).isEmpty()
    assert [(r.line, r.match) for r in grep.grep_regex(files, r"^fir\w+", 3).collect()] == [(1, "first"), (3, "first"), (1, "first")]
    assert grep.grep_regex(files, "(?i)FIRST", None).count() == 7
    for per_file in (None, 60):
        assert grep.grep_literal(files, "first", None, per_file=per_file).count() == 11 and grep.grep_literal(files, "aa", None, per_file=per_file).count() == 4
        assert sorted(map(repr, grep.grep_literal(files, "first", None, per_file=per_file).collect())) == sorted(map(repr, grep.grep_literal(files, "first", None, per_file=9).collect()))
    assert grep.grep_regex(files, "first", None, per_file=None).count() == 11
    many = spark.createDataFrame([(f"f{i:03}", "raise ValueError\ncall(1)\n") for i in range(300)], "path string, content string")
    for pattern in ("raise ValueError", "(?i)RAISE valueerror", r"\w+\(\d\)", "(raise|throw) \\w"):
        assert grep.grep_regex(many, pattern, None).count() == 300 and grep.grep_regex(many, pattern, None, grep.postings(many)).count() == 300
    assert grep.grep_literal(many, "ra", None).count() == 300 and grep.grep_literal(many, "ra", None, unfiltered=100).count() == 100
    assert "second line" in grep.grep_literal(files, "second").first().context
    for bad in ("", "  "):
        with pytest.raises(CorvaneError):
            grep.grep_literal(files, bad)
    with pytest.raises(CorvaneError):
        grep.grep_regex(files, "(")
    assert grep.stats(files, posting).first().files == 6


def test_long_literals(spark):
    long = "".join(chr(97 + i % 26) + chr(65 + i // 26) + str(i % 7) for i in range(60))
    files = spark.createDataFrame([("a", "x " + long), ("b", long[:-1] + "!"), ("c", long[1:])], "path string, content string")
    posting = grep.postings(files)
    assert len(grep.grams([long])) > 60
    assert [r.content_hash for r in grep.candidates(posting, grep.grams([long])).collect()] == [files.filter("path = 'a'").select(X.content_hash(F.col("content"))).first()[0]]


def test_equal_contents_are_all_found(spark):
    files = spark.createDataFrame([("a", "needle here"), ("b", "needle here")], "path string, content string")
    assert grep.grep_literal(files, "needle", None, grep.postings(files)).count() == 2


def test_delta(spark):
    now = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), ("e", 0.5)], "path string, mtime double")
    old = spark.createDataFrame([("b", 1.0), ("c", 0.5), ("d", 1.0), ("e", 1.0)], "path string, mtime double")
    got = {r.path: r.action for r in delta.plan(now, old).collect()}
    assert got == {"a": "add", "b": "keep", "c": "modify", "d": "remove", "e": "keep"}
    chunks = spark.createDataFrame([("1", "b"), ("2", "c"), ("3", "d")], "id string, file_path string")
    fresh = spark.createDataFrame([("4", "a"), ("5", "c"), ("5", "c")], "id string, file_path string")
    assert {r.id for r in delta.apply(chunks, delta.plan(now, old), fresh).collect()} == {"1", "4", "5"}
    assert {r.id for r in delta.upsert(chunks, fresh, "file_path").collect()} == {"1", "3", "4", "5"}
    assert delta.delete(chunks, now.withColumnRenamed("path", "file_path"), "file_path").count() == 1


CODE = [
    ("app/__init__.py", ""), ("app/main.py", "import os\nfrom . import util\nfrom .core import run\nfrom ..lib.x import y\nimport app.core.deep\nfrom missing import z\n"), ("app/util.py", "from .main import go\n"),
    ("app/core/__init__.py", "from .deep import a\n"), ("app/core/deep.py", "import json\nimport lib.x, os\n"), ("lib/x.py", ""), ("src/pkg/m.py", "import app.util\n"), ("src/pkg/__init__.py", ""), ("t.py", "import pkg.m\n"),
    ("web/a.ts", "import { b } from './b';\nimport c from '@/c';\nexport * from './dir';\nconst d = require('./d.service');\nimport 'http://x'\n"), ("web/b.ts", "import './a'\n"), ("web/dir/index.ts", ""), ("web/d.service.ts", ""),
    ("src/c.ts", ""), ("r/main.rs", "mod part;\nuse std::io;\n"), ("g/m.go", 'import (\n\t"g/n"\n)\n'), ("g/n/main.go", ""), ("n.py", None),
]


def test_imports(spark):
    files = spark.createDataFrame(CODE, "path string, content string")
    got = {}
    for r in graph.resolve(files).orderBy("src", "ord").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got["app/main.py"] == ["app/__init__.py", "app/core/__init__.py", "lib/x.py", "app/core/deep.py"]
    assert got["app/util.py"] == ["app/main.py"] and got["app/core/deep.py"] == ["lib/x.py"] and got["t.py"] == ["src/pkg/m.py"]
    assert got["web/a.ts"] == ["web/b.ts", "src/c.ts", "web/dir/index.ts", "web/d.service.ts"]
    assert got["g/m.go"] == ["g/n/main.go"] and "r/main.rs" not in got
    settings = spark.createDataFrame([('{ // paths\n"compilerOptions": {"baseUrl": "web", "paths": {"#/*": ["dir/*"]}} /* end */}',)], "content string")
    aliases = sources.aliases(settings)
    assert [tuple(r) for r in aliases.collect()] == [("#/", "web/dir/", 0)]
    more = spark.createDataFrame([*CODE, ("web/z.ts", "import q from '#/index'\n")], "path string, content string")
    assert [r.dst for r in graph.resolve(more, aliases=aliases).filter("src = 'web/z.ts'").collect()] == ["web/dir/index.ts"]


def test_imports_in_texts_are_none(spark):
    rows = [
        ("a.py", '"""\nimport hidden\nfrom also import hidden\n"""\nimport one, two.three as t\nfrom . import four\nfrom ..five import six\ndef f():\n    import seven\n'), ("bad.py", "import one\ndef f(:\n"),
        ("a.ts", "// import x from './no'\nconst s = `\nimport y from './no'`;\nimport z from './yes';\nexport * from './re';\n/* require('./no') */ require('./req');\n"), ("a.go", '/*\nimport "no"\n*/\nimport "yes"\nimport (\n\t"p/q"\n\tx "r"\n)\n'), ("a.rs", "// use no::a;\nuse yes::b;\n  mod part;\n"), ("n.py", None), ("x.md", "import no"),
    ]
    found = {}
    for r in graph.syntax_imports(spark.createDataFrame(rows, "path string, content string")).orderBy("src", "ord").collect():
        found.setdefault(r.src, []).append(r["import"])
    assert found == {"a.py": ["one", "two.three", ".", "..five", "seven"], "bad.py": ["one"], "a.ts": ["./yes", "./re", "./req"], "a.go": ["yes", "p/q", "r"], "a.rs": ["yes::b", "part"]}
    plain = {(r.src, r["import"]) for r in graph.raw_imports(spark.createDataFrame(CODE, "path string, content string")).collect()}
    tree = {(r.src, r["import"]) for r in graph.syntax_imports(spark.createDataFrame(CODE, "path string, content string")).collect()}
    assert tree - plain == {("app/core/deep.py", "os")} and plain <= tree  # the second name of one statement


def test_traversal(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "f"), ("c", "f"), ("x", None), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reach(edges, start, 2).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2), ("e", 2)}
    assert {(r.node, r.depth) for r in graph.reach(edges, start, 9).collect()} >= {("f", 3)}
    hit = spark.createDataFrame([("f",)], "node string")
    assert {(r.path, r.depth, r.kind) for r in graph.impact(edges, hit, 2).collect()} == {("c", 1, "direct"), ("e", 1, "direct"), ("b", 2, "transitive"), ("d", 2, "transitive")}
    assert graph.reach(edges.limit(0), start, 3).count() == 1


def ranked(spark, rows):
    return spark.createDataFrame(rows, "rank int, path string, start_line int, end_line int, name string, score double, content string").withColumn("reason", F.lit("r"))


def test_merging(spark):
    rows = [(3, "a", 1, 10, "x", 1.0, "c"), (1, "a", 15, 20, "y", 3.0, "c"), (2, "a", 26, 30, "z", 2.0, "c"), (4, "a", 2, 4, "in", 9.0, "c"), (5, "b", 1, 2, "o", 1.0, "one")]
    files = spark.createDataFrame([("a", "\n".join(str(i) for i in range(1, 41))), ("b", "p\r\nq")], "path string, content string")
    got = {(r.path, r.start_line): r for r in pack.merge(ranked(spark, rows), files).collect()}
    assert set(got) == {("a", 1), ("a", 26), ("b", 1)}
    assert got["a", 1].end_line == 20 and got["a", 1].name == "x" and got["a", 1].score == 9.0 and got["a", 1].content.startswith("1\n2\n")
    assert got["b", 1].content == "one"


def test_budgets(spark):
    r = ranked(spark, [(i, "p", i, i, "", 1.0, "x" * n) for i, n in enumerate([40, 30, 50, 10], 1)])
    cost = F.length("content")
    ranks = lambda df: [x.rank for x in df.orderBy("rank").collect()]
    assert ranks(pack.chunk_budget(r, cost, 70)) == [1, 2] and ranks(pack.chunk_budget(r, cost, 39)) == [] and ranks(pack.chunk_budget(r, cost, None)) == [1, 2, 3, 4]
    assert ranks(pack.file_budget(r, cost, 41)) == [1, 2] and ranks(pack.file_budget(r, cost, 1)) == [1] and ranks(pack.file_budget(r, cost, 10, used=50)) == [1]
    assert ranks(pack.at_most(pack.page(r, 2, 1), 2)) == [2, 3]
    with pytest.raises(CorvaneError):
        pack.chunk_budget(r, cost, 0)
    s = pack.summary(r.select(F.lit(1).alias("lines"), cost.alias("chars"), cost.alias("tokens")), 9, 4, 0, "max_chunks").first()
    assert s.truncated and s.has_more and s.next_offset == 4 and s.total_tokens == 130 and "8 chunks" in s.suggestion


def test_probe(spark):
    rows = [("1", "a.py", "def helper_one(): pass  # definition", 1, 1, "helper_one", "function"), ("2", "b.py", "unrelated words", 1, 1, "", "block")]
    chunks = spark.createDataFrame(rows, "id string, file_path string, content string, start_line int, end_line int, name string, node_type string")
    assert [(r.symbol, r.id) for r in probe.best(chunks, ["helper_one", "nothing_like"]).filter("symbol = 'helper_one'").collect()] == [("helper_one", "1")]


def test_outline_and_skeleton(spark):
    assert outline.signatures_of("a.py", PY) == [("def one(a, b=2):", 0), ("class Two(Base):", 0), ("def m(self):", 1)]
    assert [s for s, _ in outline.signatures_of("a.go", "func F(a int) int {\n}\ntype T struct {\n}\n")] == ["func F(a int) int", "type T struct"]
    s = outline.skeleton(PY)
    assert "return a + b" not in s and "class Two(Base):" in s and s.count("...") == 2
    compile(s, "x", "exec")
    assert "return a + b" in outline.skeleton(PY, frozenset({"one"})) and outline.skeleton("def f(:") == "def f(:"
    files = spark.createDataFrame([("a.py", PY), ("b.md", "x"), ("c.py", None)], "path string, content string")
    lines = [r.line for r in outline.shown(outline.signatures(files), 2).orderBy("at").collect()]
    assert lines == ["def one(a, b=2):", "class Two(Base):", "... (1 more)"]
    assert {r.path: r.skeleton for r in outline.skeletonize(files).collect()}["b.md"] == "x"


def test_tree(spark):
    paths = spark.createDataFrame([("a/b.py",), ("a/.h/x",), ("node_modules/q.js",), ("a/c/d.py",), ("z",)], "path string")
    got = {(r.path, r.parent, r.depth, r.is_file) for r in sources.tree(paths).collect()}
    assert got == {("a", "", 1, False), ("a/b.py", "a", 2, True), ("a/c", "a", 2, False), ("a/c/d.py", "a/c", 3, True), ("z", "", 1, True)}


@pytest.mark.parametrize("path, out", [(".git/x", True), ("a/.git/x", False), ("node_modules/a/b.js", True), ("pkg/node_modules/a.js", False), ("x.pyc", True), ("a/b/x.pyc", True), ("a/yarn.lock", True), ("a/x.min.js", True), ("a/xmin.js", False), ("build/a", True), ("rebuild/a", False), ("vendor/", True)])
def test_excluded(spark, path, out):
    assert spark.range(1).select(sources.excluded(F.lit(path))).first()[0] is out


def test_read_tree(spark, tmp_path, monkeypatch):
    for name, data in {"a.py": b"x = 1", "__init__.py": b"y", "_d/z.py": b"z", ".h/q.py": b"q", "big": b"x" * ((1 << 20) + 1), "fit": b"x" * (1 << 20), "zero": b"", "nul": b"a\x00b", "late": b"a" * 8192 + b"\x00", "bad": b"A\xffB", "fffd": "a\ufffdb".encode() + b"\xff", "node_modules/k.js": b"k", "d/node_modules/k.js": b"k"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for k in range(40):
        (tmp_path / f"deep/{k % 7}/{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"deep/{k % 7}/{k % 3}/{k}.py").write_text(str(k))
    monkeypatch.setattr(sources, "LISTED", 5)
    got = {r.path: r.content for r in sources.read_tree(spark, str(tmp_path)).collect()}
    assert {p for p in got if not p.startswith("deep/")} == {"a.py", "__init__.py", "_d/z.py", ".h/q.py", "fit", "late", "bad", "fffd", "d/node_modules/k.js"} and got["bad"] == "AB" and got["fffd"] == "a\ufffdb"
    assert sum(p.startswith("deep/") for p in got) == 40 and got["deep/3/1/10.py"] == "10"
    assert "big" in {r.path for r in sources.read_tree(spark, str(tmp_path), sizes=False).collect()}
    assert "fit" not in {r.path for r in sources.read_tree(spark, str(tmp_path), most=1000).collect()}
    assert sources.read_tree(spark, str(tmp_path / "absent")).count() == 0


BRACED = {
    "a.ts": ("import x from 'y';\nexport { q };\n\n/** doc { */\nexport class A extends B {\n  x = '}';\n  async m(a: { b: number }): Promise<void> {\n    if (a) {\n      return;\n    }\n  }\n}\n\nexport const f = (a = {}) => {\n  return `}${a}`;\n};\ntype T = { a: 1 };\n", [("class", "A", 5, 12), ("function", "f", 14, 16), ("class", "T", 17, 17)]),
    "a.go": ('package p\nimport (\n\t"x"\n)\n\nfunc (s *T) F(a int) (int, error) {\n\tx := "}"\n\treturn a, nil\n}\n\ntype T struct {\n\ta int\n}\n', [("function", "F", 6, 9), ("class", "T", 11, 13)]),
    "a.rs": ("use a::b;\n\npub(crate) fn f<'a>(x: &'a str) -> u8 {\n    '}'\n}\nimpl<T> Tr for S<T> {\n    fn g() {\n        1\n    }\n}\nstruct U;\n", [("function", "f", 3, 5), ("class", "S", 6, 10), ("class", "U", 11, 11)]),
    "A.java": ("package p;\nimport a.B;\n\npublic class A {\n    @Override\n    public <T> int m(int x) throws E {\n        return \"}\".length();\n    }\n}\n", [("class", "A", 4, 9)]),
    "a.cs": ("using System;\n\nnamespace N {\n  class A {\n    public int m(int x) {\n      return \"}\".length();\n    }\n  }\n}\n", [("class", "N", 3, 9)]),
    "a.php": ("<?php\nuse A\\B;\n\nfunction f($a) {\n  return '}';\n}\nfinal class C {\n}\n", [("function", "f", 4, 6), ("class", "C", 7, 8)]),
    "a.c": ("#include <x.h>\n\nstatic int f(int a) {\n  return a;\n}\n", [("function", "f", 3, 5)]),
}
OTHER = {
    "a.sh": ("#!/bin/sh\nset -e # { no\n\nbuild() {\n  case \"$1\" in\n    all) make ;;\n    x|y) echo '}' ;;\n  esac\n  echo ${PATH}\n}\n\nfunction clean {\n  rm -r out\n}\nbuild\n", [("function", "build", 4, 10), ("function", "clean", 12, 14)], ["build()", "function clean"]),
    "a.rb": ("require 'set'\n\nmodule Shop\n  class Cart\n    # def no\n    def add(item, n = 1)\n      if item\n        @items << item\n      end\n      \"def no\"\n    end\n\n    def empty? = @items.empty?\n  end\nend\n\ndef total(cart)\n  cart.sum\nend\n", [("class", "Shop", 3, 15), ("function", "total", 17, 19)], ["module Shop", "def total(cart)"]),
}


@pytest.mark.parametrize("path", OTHER)
def test_shell_and_ruby(spark, path):
    text, want, heads = OTHER[path]
    family = braces.FAMILIES[path.rpartition(".")[2]]
    assert [(d.kind, d.name, d.start, d.end) for d in braces.definitions(text, family)] == want
    assert [s for s, _ in outline.signatures_of(path, text)] == heads and braces.imports(text, family)[0] == (["require 'set'"] if family == "ruby" else [])
    bare = outline.skeleton_of(path, text)
    assert "# ..." in bare and "make ;;" not in bare and "@items << item" not in bare and bare.count("end\n") == (text.count("end\n") - 1 if family == "ruby" else 0)
    for broken in (text[: len(text) // 2], text.replace("}", "").replace("end", ""), "", "end\nend", "def", "f() {", "class"):
        braces.definitions(broken, family)
        outline.skeleton_of(path, broken)
    long = text.replace("make", "make " + "words " * 12).replace("cart.sum", "cart.sum # " + "words " * 12)
    assert {(r.type, r.name) for r in chunking.chunk_definitions(spark.createDataFrame([(path, long)], "path string, content string")).collect()} >= {(want[0][0], want[0][1]), ("anchor", "")}


@pytest.mark.parametrize("path", BRACED)
def test_braced_definitions(path):
    text, want = BRACED[path]
    family = braces.FAMILIES[path.rpartition(".")[2]]
    assert [(d.kind, d.name, d.start, d.end) for d in braces.definitions(text, family)] == want
    bare = outline.skeleton_of(path, text)
    assert bare.count("{") - bare.count("}") == text.count("{") - text.count("}") or "'}'" in text or '"}"' in text
    assert "// ..." in bare and "return a, nil" not in bare and ".length()" not in bare
    assert braces.imports(text, family)[0]
    assert outline.skeleton_of(path, text, frozenset({"f", "F", "m", "g"})) == text
    for broken in (text[: len(text) // 2], text.replace("}", ""), "", "{{{", "}}}", "func ("):
        braces.definitions(broken, family)
        outline.skeleton_of(path, broken)


def test_what_is_left_open_encloses_nothing():
    text = "package p\n\nfunc A() {\n\tif x {\n\t\treturn\n\n// doc\nfunc B(a int) int {\n\treturn a\n}\n\ntype T struct {\n\tx int\n}\n"
    assert [(d.name, d.start, d.end) for d in braces.definitions(text, "go")] == [("A", 3, 3), ("B", 8, 10), ("T", 12, 14)]


def test_braced_chunks(spark):
    files = spark.createDataFrame([(p, t.replace("return", "return /* words that make it long enough to stay */")) for p, (t, _) in BRACED.items()], "path string, content string")
    got = {(r.path, r.type, r.name) for r in chunking.chunk_definitions(files).collect()}
    assert {("a.ts", "class", "A"), ("a.ts", "function", "f"), ("a.go", "function", "F"), ("A.java", "class", "A"), ("a.ts", "anchor", "")} <= got
    assert [s for s, _ in outline.signatures_of("a.ts", BRACED["a.ts"][0])][:2] == ["export class A extends B", "async m(a: { b: number }): Promise<void>"]


def test_stems(spark):
    from corvane.functions.stem import stem, stemmed_tokens

    pairs = "consigned consign consistency consist consolatory consolatori conspiring conspir knightly knight knives knive skies sky generously generous hoping hope hopping hop"
    words = pairs.split()
    assert all(stem(a) == b for a, b in zip(words[::2], words[1::2]))
    got = spark.createDataFrame([("notifications useToasts",), (None,), ("",)], "t string").select(stemmed_tokens(F.col("t")).alias("s")).collect()
    assert {"notif", "toast"} <= set(got[0].s) and got[1].s is None and got[2].s == []


def test_cached_edges(spark):
    cache = spark.createDataFrame([("a", 1.0, "b"), ("c", 1.0, "d"), ("gone", 1.0, "x")], "src string, mtime double, dst string")
    files = spark.createDataFrame([("a", 1.005), ("c", 2.0)], "path string, mtime double")
    assert [r.src for r in graph.still_valid(cache, files).collect()] == ["a"]
