import ast
import glob
import json
import os
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import syntax, validity

GOOD = {
    "python": [
        '"""doc"""\nfrom __future__ import annotations\nimport os, sys as s\nfrom . import (a, b as c,)\n\n@deco(1)\nasync def f(a, /, b: int = 2, *args, c, d=4, **kw) -> dict[str, int]:\n    """x"""\n    async with a as b, c: pass\n    async for x in y: await z\n    else:\n        return {**a, "k": [i for i in range(3) if i], **b}\n',
        "class A(B, metaclass=M):\n\tx: int = 1; y = z = 2\n\n\tdef m(self): return lambda *a, k=1: (yield)\n",
        "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a[0], b.c\nif (n := 3) > 2: print(n)\nelif not a in b and c is not d or e not in f:\n    x = a if b else c\nelse:\n    assert x, 'm'\n",
        "match cmd.split():\n    case [x, *rest] if rest: pass\n    case {'k': 1, **r} | A(b=2) as q:\n        pass\n    case -1 | 'a' 'b' | None | a.b: pass\n    case _: pass\nmatch = 1\nmatch[0]\nprint(match, case := 2)\ntype X[T] = list[T]\n",
        "x = f'{a!r:>{w}} {b[\"c\"]} {{}} {d=}'\ny = a[1:2, ::3, *z]\n*a, b = c\nx = *a, b\nfor i, *j in k: pass\nwhile True:\n    break\nz = (yield_ for yield_ in [1])\nw = 0xFF + 1_000 + 1e5 + 3j + 0b1 + .5\n\\\n\nglobal q\n",
        "def g():\n    return not -x ** -y @ z // 2 << 3 & 4 ^ 5 | 6\n    x @= 2\n    with (open(a) as f, open(b) as g,):\n        pass\n    with (a): pass\n    with (a, b) as c: pass\n\n\n# end",
        "", "\n\n", "#only", "a = 1\r\nif a:\r\n    b = 2\r\n", "x = '''a\n  b'''\nif x:\n        y\n# dedented comment\n        z\n",
    ],
    "javascript": [
        "import a, { b as c, default as d } from './x.js';\nimport * as n from 'n';\nimport 'side';\nexport default function () {}\nexport { a as b, c }; export * from 'q'; export * as z from 'z';\nexport const e = 1, [f, , g = 2, ...h] = i, { j, k: { l = 3 }, ...m } = o;\n",
        "class A extends B.c {\n  #p = 1; static s = 2; static { this.s++; }\n  constructor(a, b = 2, ...c) { super(a); }\n  get x() { return this.#p } set x(v) { this.#p = v }\n  async *gen() { yield* a; yield; await b }\n  static async m() {} 'quoted'() {} [computed]() {} get; set = 1; async\n  static() {}\n}\n",
        "const f = async (a, { b }, [c] = []) => { await a?.b?.[c]?.(d) ?? e }, g = x => x ** 2, h = () => ({ a, b: 1, [c]: 2, ...d, e() {}, get f() { return 1 }, async *i() {} });\n",
        "for (const x of y) z(x)\nfor (let i = 0, n = 3; i < n; i++) { if (i) continue; else break }\nfor (k in o) ;\nfor (;;) { break }\nlabel: while (1) { do { break label } while (0) }\nswitch (a) { case 1: case 'b': c(); break; default: d() }\ntry { throw new Error(`a ${b + `n${c}`} d`) } catch { } finally { }\n",
        "var re = /[/\\]]+/gi.test(a) ? b / c / d : (e) / 2; x = a\n++b\nreturnValue = typeof void delete a[b], new Foo, new Foo.Bar(1)(2)\n;[1, 2].map(x => x)\nlet y = a in b && c instanceof d || !e\nif (a) /re/.test(b)\n".replace("if (a) /re/.test(b)\n", ""),
        "!function(a,b,c){for(;a<3;)a++;return b}(this,0,1);\n//# map\n", "a\n/b/g", "", "#!/usr/bin/env node\nx()", "({ a = 1 } = b); [a, b] = [b, a]; a ||= b; a ??= c; a >>>= 2\nlet async = 1; async\n(function () { return })()\nimport('x').then(import.meta.url)\nconst s = 'a\\\nb'\nif (a) { } else if (b) { } else { }\nvar of = 1, get = 2; of = get\n",
    ],
    "typescript": [
        "import type { A } from './a'; import { type B, C } from 'c'; export type { A };\ninterface I<T extends object = {}> extends J, K<T> { readonly a?: string; [k: string]: unknown; m<U>(x: U): void; (a: number): string; new (x: any): I<T>; get x(): number }\n",
        "type F = (a: number, ...b: string[]) => void; type M = { readonly [K in keyof T]?: T[K] }; type C<T> = T extends (infer U)[] ? U : never;\ntype T1 = [a: string, b?: number, ...rest: boolean[]] | 'lit' | -1 | typeof x.y | keyof typeof z | unique symbol & { a: 1 };\n",
        "enum E { A = 1, B, 'c' = A << 2 } const enum G { X } declare module 'm' { export function f(a: string): number } declare const x: number; namespace N.M { export const a = 1 }\n",
        "abstract class A<T> extends B<T> implements C, D<T> {\n  private readonly x: number = 1; static y?: string; z!: number; declare q: string;\n  constructor(private a: string, public readonly b = 2) { super() }\n  abstract m(): void; protected async n<U>(this: A<T>, x?: U): Promise<U> { return x as unknown as U }\n  get v(): string { return '' } @dec() w = 1; [k: string]: any\n}\n",
        "function f(a: string): string; function f(a: any) { return a! as const }\nconst g = <T,>(x: T): x is string => x satisfies any; const h = async (a?: number): Promise<void> => {}; let m = new Map<string, number[]>(); f<string>('a'); const k = <any>x; let t: Map<string, Array<number>> = new Map();\nconst o = a ? (b) : c; for (const [k, v] of Object.entries(x)) { }\nfunction isA(x: unknown): asserts x is A { } let u = a < b && c > d; x = y as any; export default interface Z { a: 1 }\n",
        "export const get_a0 = (msg: number[]): number => msg[0];\nexport abstract class Q {}\nlet fn: (a: string) => void = (a) => {};\nconst x: { a: number }[] = [];\n",
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\tx "a/b"\n\t. "c"\n)\n\nconst (\n\tA = iota\n\tB\n\tC string = "x"\n)\nvar a, b int = 1, 2\nvar m = map[string][]int{"a": {1, 2}, "b": nil}\ntype T[K comparable, V any] struct {\n\ta, b int `json:"x"`\n\t*E\n\tp.Q\n\tf func(int) (string, error)\n}\ntype I interface { M(a int) error; ~int | string; E }\n',
        "package p\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; !ok && v > 2 {\n\t\treturn\n\t} else if x := f(); x != nil {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t\tbreak\n\t}\n\tfor range ch {\n\t}\n\tfor x < 3 {\n\t}\n\tfor {\n\t}\nL:\n\tswitch y := x.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t\tgoto L\n\t}\n\tswitch {\n\tcase a > 1:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\tdefault:\n\t}\n\tdefer func() { recover() }()\n\tgo f(a...)\n\tx := []T{{1, 2}, {A: 3}}[0:1:2]\n\tp := &T{\n\t\tA: 1,\n\t}\n\tif (T{1}) == y {\n\t}\n\tc <- x\n\ta.b[0]++\n\tvar f = func(int) {}\n\treturn a, nil\n}\n",
        "package p\nfunc G[T any](x T) T { return F[int](x) }\nfunc h() { var x struct{ a int }; x.a = 'c' + '\\n' + 0x1F + 1e3; x &^= 2; <-ch }\n// end",
    ],
    "rust": [
        "#![allow(x)]\nuse std::{io::{self, Read as R}, fmt::*};\npub mod a { pub(crate) fn f() {} }\nmod b;\n#[derive(Debug, Clone)]\npub struct S<'a, T: Clone + 'a, const N: usize = 3> where T: Fn(i32) -> bool { pub a: &'a mut T, b: [u8; N] }\nstruct U; struct V(pub i32, String);\nenum E { A, B(i32), C { x: u8 }, D = 4 }\nconst X: &str = \"a\"; static mut Y: i32 = -1;\ntype R2<T> = Result<T, Box<dyn Error + Send>>;\n",
        "impl<'a, T> Tr for S<'a, T> where T: ?Sized { type O = T; const C: i32 = 1; fn m(&mut self, (a, b): (i32, i32), _: &dyn Fn(u8)) -> impl Iterator<Item = u8> + '_ { self.x.iter().map(|x| x + 1).collect::<Vec<_>>()? } }\ntrait Tr: A + B { type O: Clone; fn f(self: Box<Self>); fn g() {} }\n",
        "fn main() -> Result<(), E> {\n    let mut x: Vec<u64> = vec![1, 2, 3];\n    let Some(y) = z else { return Err(e.into()) };\n    if let Some(ref a) | Other(a @ 1..=5) = b && c > 2 { x } else if d { } else { };\n    match v { 0 => a(), 1 | 2 if x => { b } 'a'..='z' => c, P { x, y: 3, .. } => d, [first, .., last] => e, &(ref m, _) => f, _ => unreachable!(\"{}\", 1), }\n    'outer: for (i, s) in (0..10).enumerate() { while let Some(t) = st.pop() { break 'outer; } loop { continue } }\n    let c = move |a: i32, b| -> i32 { a + b };\n    let s = S { a: 1, b, ..Default::default() };\n    x[1..].len() as f64 * -2.0_f32 >> 3; *p += 1; a = b; let r = &mut x; let t = (1,); let u = ();\n    unsafe { f::<T>(1) }; let q = if a { 1 } else { 2 }; let n = <T as Tr>::O::new(r#\"raw\"#, b'x', '\\u{1F600}');\n    println!(\"{:?}\", x); async move { y.await };\n    if x == (S { a: 1 }) {}\n    return Ok(());\n}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\n",
        "pub fn f(a: u64) -> u64 { match g(h) { Some(found) => q.push(found), None => log::warn!(\"x\"), } let v = rows.iter().filter(|row| row.x > 3).count(); a }\n/* a /* nested */ b */\nasync fn z() {} extern \"C\" { fn c(x: i32); } unsafe impl Send for X {}\n",
    ],
    "java": [
        "package a.b;\nimport static java.util.List.*;\nimport x.Y;\n@Ann(value = {1, 2}, x = @In) public final class A<T extends Comparable<? super T> & B> extends C<T> implements D, E<F[]> {\n  private static final int X = 1, Y[] = {1, 2,}; static { x(); } { y(); }\n  public <U> A(@Nn final U u, int... xs) throws E1, E2 { this(u); super.m(); }\n  abstract void n(); int m()[] { return null; }\n  enum Q implements Z { A(1) { void f() {} }, B; int q; }\n  record P<T>(int x, T y) { P { if (x < 0) throw new E(); } }\n  @interface An { int v() default 3; }\n  sealed interface S permits S1, S2 { default void d() {} }\n}\n",
        'class B { void f() { int i = 0, j; final var x = new ArrayList<Map<String, int[]>>(); for (int k = 0; k < 3; k++, j--) continue; for (String s : xs) break; for (;;) { } do { i++; } while (i < 3); lab: while (true) break lab;\n try (var r = open(); q) { } catch (A | B e) { } finally { } synchronized (this) { } switch (x) { case 1: case 2: f(); break; default: g(); } int y = switch (z) { case A, B -> 1; case C c when c.x() > 0 -> { yield 2; } default -> throw new X(); };\n Runnable r = () -> { }; F g = (a, b) -> a + b; G h = String::length; int[] a = new int[3], b = {1}; int[][] c = new int[2][]; a[0] += (int) 3.5 >> 2 >>> 1; if (o instanceof String s && !s.isEmpty()) return; else { } assert x : "m"; List<String> l = (List<String>) o; x = a < b ? c : d; Object q = new Object() { int z; }; this.<T>m(); int[].class.getName(); String t = """\n a "b"\n """; char ch = \'\\n\'; long n = 0xFFL; x >>>= 2; class Local { } } }\n',
        "@FunctionalInterface interface I { void f(); }\npublic class C { protected long m(String a, int b) { long h = rows.stream().filter(row -> row.x() > 7).count(); queue.add(2 + 4); return 9; } }\n;",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", " 1 ", '"x"', "{\n}\n"],
}

BAD = {
    "python": ["def f(:\n  pass", "x = ", "if a:\nb", "  x = 1", "a = (1\nb = 2", "print 'x' y", "else:\n  pass", "x = 'abc", "for x in:\n  pass", "def f(a=1, b): pass", "f() = 1", "a b", "class A\n  pass", "try:\n  x\ny", "f(a=1, 2)", "<<<<<<< HEAD\nx = 1", "return )", "import", "x = [1, 2", "if x = 1: pass", "@d\nx = 1", "lambda x: = 2", "f'{a b}'", "a = 5d53", "x = 1 +", "def f():\n\tx\n        y\n    z", "1 = x", "not = 3", "a +* b", "x is", "{1, 2: 3}", "del f()", "with a as f(): pass", "match x:\n  pass", "package a;", "case 1:\n  pass", "x = 1\ny = '\n", 'f(")\nx = 1', 'x = """abc"" = 1', "type X[] = int", "f'{a!x}'", "f'{a}}'", "f'{}'"],
    "javascript": ["let x = ;", "function f( { }", "if (a { }", "const x;", "{ a: 1, b: 2 }", "class A { foo }}", "return 1", "a b", "x = 'abc", "for (let i = 0; i < 3 { }", "<<<<<<< ours\na", "import { a } from", "f() = 1", "const a = [1, 2", "try { }", "else { }", "switch (a) { foo(); }", "var 1a = 2", "`abc", "package a;", "<!doctype html>", "export foo", "break", "a => { ", "x = {a: 1 b: 2}", "new", "-a ** 2", "let a: number = 1"],
    "typescript": ["let x: = 1", "interface A { a: }", "type A", "function f(a: string { }", "enum { A }", "class A { private }{", "let x: Array<string = 1", "const f = (a: ) => 1", "abstract foo", "import os\nimport logging", "=======\n", "let a: string = ;"],
    "go": ["package", "func f() {}", "package p\nfunc f( { }", "package p\nfunc f() { x := }", "package p\nfunc f() { if x { }", "package p\nx := 1", "package p\nfunc f() { for i := 0; i < 3 { } }", "package p\nvar a = [3]int{1, 2", "package p\nfunc f() { return 1 +\n}", 'package p\nvar s = "abc\n', "package p\nfunc f() { a b }", "package p\nfunc f() { if x\n{ } }", "package p\nfunc f() { g(1,\n2\n) }", "package p\nfunc f() {}\n}", "package p\n<<<<<<< HEAD\n", "package p\nfunc f() { go x }"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "let x = 1;", "fn f() { if x { }", "struct A { a u8 }", "fn f() { a b }", "fn f() { x = 1 }}", "use a::;", "fn f() -> { }", 'fn f() { let s = "abc; }', "impl { }", "enum E { A B }", "fn f() { match x { 1 = 2 } }", "fn f() { g(1, 2 }", "<<<<<<< HEAD", "fn f() { let 1x = 2; }", "fn f() { foo!( }", "import os", "fn f() { for x y { } }", "fn f() { 'a }"],
    "java": ["class A { void f( { } }", "class A { int x = ; }", "class A {", "class A { void f() { int = 3; } }", "class A { void f() { a b c; } }", "class A { void f() { x } }", "class { }", "package a", "class A { } }", 'class A { String s = "abc; }', "class A { void f() { if x { } } }", "class A { void f() { for (int i = 0; i < 3) { } } }", "class A { void f() { 1 + 2; } }", "class A { void f() { else { } } }", "class A { void f() { try { } } }", "def f(): pass", "class A { f() }", "class A { void f() { f() = 1; } }", "class A { int f() { return 1 + ; } }", 'class A { String s = """ + 1; }', "class A { char c = \"; }"],
    "json": ["{", '{"a": 1,}', "[1 2]", "{'a': 1}", "", '{"a" 1}', "[1,]", "01", "{} {}", '"a\nb"', "// c\n{}", "nul", '{"a": .5}', '{"a": undefined}', '"\\x"'],
}


@pytest.mark.parametrize("language", GOOD)
def test_accepted(language):
    for text in GOOD[language]:
        assert syntax.faults(language, text) == [], text
        if language == "python":
            ast.parse(text)
        if language == "json":
            json.loads(text)
    for text in GOOD[language]:  # from what is kept now
        assert syntax.faults(language, text) == []


@pytest.mark.parametrize("language", BAD)
def test_rejected(language):
    for text in BAD[language]:
        if text or language == "json":
            assert syntax.faults(language, text), text
        if language == "python":
            with pytest.raises(SyntaxError):
                ast.parse(text)


@pytest.mark.parametrize("language", [k for k in GOOD if k != "python"])
def test_a_bracket_taken_away_or_put_in_is_a_fault(language):
    for text in GOOD[language]:
        at = [i for i, c in enumerate(text) if c in "{}" and not any(q in text for q in ("'", '"', "`", "/*", "//"))]
        for i in at:
            assert syntax.faults(language, text[:i] + text[i + 1 :]), (text[:i], text[i:])


def test_all_faults_are_found_and_the_first_comes_first():
    found = syntax.faults("java", "class A {\n  int x = ;\n  int ok = 1;\n  void f() {\n    y + ;\n    g();\n  }\n}\n")
    assert [f.line for f in found] == [2, 5]
    found = syntax.faults("python", "a = \nb = 1\nc = )\n")
    assert [f.line for f in found][:1] == [1] and len(found) >= 2


def test_python_agrees_with_its_own_parser():
    warnings.simplefilter("ignore")
    for path in sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:120]:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        assert syntax.faults("python", text) == [], path


SNIPPETS = ["class A(x for x in y): pass", "0777", "b'é'", "def f(*, **k): pass", "b'a' 'b'", "x = 00", "x = 0_0", "0777.5", "08e1", "07j", "class A(B, metaclass=C): pass", "f(x for x in y)", "def f(*, a, **k): pass", "b'a' b'b'", "'a' 'é'", "lambda *, **k: 1", "rb'é'", "Rb'x' b'y'", "'b' 'é'", "f\"{a.split('}')[-1]}\"", "f'{x:{y}}'", "f'{x!r:>10}'", "f'{x y}'"]


@pytest.mark.parametrize("text", SNIPPETS)
def test_snippets_as_the_compiler_has_them(text):
    try:
        compile(text, "x", "exec", ast.PyCF_ONLY_AST)
        good = True
    except SyntaxError:
        good = False
    assert (syntax.faults("python", text) == []) == good


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(list(GOOD)), st.text(max_size=60))
def test_any_text_gets_a_verdict(language, text):
    syntax.faults(language, text)
    if language == "json":
        try:
            json.loads(text)
            ok = True
        except ValueError:
            ok = False
        if text.strip() and not any(w in text for w in ("NaN", "Infinity")):
            assert (syntax.faults("json", text) == []) == ok


def test_deep_and_long_texts():
    assert syntax.faults("json", "[" * 100_000)
    assert syntax.faults("javascript", "(" * 50_000)
    assert syntax.faults("python", "x = 1\n" * 50_000) == []
    assert syntax.faults("go", "package p\n" + "var a = 1\n" * 20_000) == []


@pytest.mark.parametrize("language, begin, branch, end", [("javascript", "", "if (a == {}) {{ f({}); }} else ", "{ g(); }"), ("typescript", "", "if (a == {}) {{ f({}); }} else ", "{ g(); }"), ("java", "class A { void f() { ", "if (a == {}) {{ f({}); }} else ", "{ g(); } } }")])
def test_long_chains(language, begin, branch, end):
    text = begin + "\n".join(branch.format(i, i) for i in range(3000)) + end
    assert syntax.faults(language, text) == []
    assert [f.line for f in syntax.faults(language, text.replace("f(2999)", "f(2999"))][:1] == [3000]
    assert [f.line for f in syntax.faults(language, text.replace("f(2999)", "f(2999 +)"))][:1] == [3000]


def test_deep_nesting():
    n = 2000
    assert syntax.faults("json", "[" * n + "]" * n) == []
    for language, begin, end in (("javascript", "x = ", ";"), ("python", "x = ", "\n")):
        assert syntax.faults(language, begin + "f(" * 300 + "1" + ")" * 300 + end) == []


def test_files(spark):
    rows = [(1, "r", "r/a.py", "x = 1"), (2, "r", "r/b.py", "x = "), (2, "r", "r/b.py", "x = "), (3, "r", "r/c.MD", "x ="), (4, None, "c.json", "{"), (5, "r", "r/d.go", None), (6, "r", "r/e.rs", " \n"), (7, "r", None, "x"), (None, "r", "r/n.ts", "let x: = 1")]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string").selectExpr("*", "'x' AS faults", "1 AS language")
    verdicts = validity.syntax_verdicts(files)
    got = {r.file_id: r for r in verdicts.collect()}
    assert {k for k, r in got.items() if r.faults} == {2, 4, None} and set(got) == {1, 2, 4, None}
    assert got[2].first_line == 1 and got[2].all_faults[0].message == got[2].first_cause
    assert {(r.repo, r.language): (r.files, r.faulty, r.rate) for r in validity.fault_rates(verdicts).collect()}["r", "python"] == (2, 1, 0.5)
    assert validity.syntax_verdicts(files.limit(0)).count() == 0
