"""Grammars: Python against its own parser, the others on valid and damaged snippets, and reports of failures."""

import ast
import sys
import time
import warnings

import pytest

from siltstone.llm.syntax import languages
from siltstone.llm.syntax.peg import Grammar, Kinds
from siltstone.llm.validity import check_files, judge, rates

sys.setrecursionlimit(50_000)

VALID = {
    "javascript": [
        "", "// only", "a = b / c / d;", "x = a ? /re[/]g/.test(s) : 1", "label: for (;;) { continue label }", "const {a, b: {c}, ...d} = e, [f,,g=1,...h] = i",
        'class A extends B { #x = 1; static { f() } get y() { return this.#x } static async *gen() {} "s"(){} [k]=2; constructor(){super()} }', "export default async () => { for await (const x of y) {} }",
        'import def, * as ns from "m"; import {default as d, "s" as t} from "n"', "let v = a?.b?.[c]?.(d) ?? e", "new Foo; new a.b.C(1).d(); new (f())()", '`a${b ? `c${d}` : "}"}e`', "x = async function* () { yield* a; yield }",
        "if (a) b\nelse c", "do x++; while (x < 5) y()", "var f = (a, {b}, [c]) => ({a, b, c})", "return_ = 1;a\n++b", 'export * as ns from "x"; export {a as b, c}; export const z = 1', "switch (a) { case 1: case 2: { } default: }",
        'x = {async *f(){}, get a(){return 1}, set a(v){}, async: 1, get, "x": 2, [y]: 3, ...z, async g(){} }', "({a, b} = c);[x, y] = z", "for (let i = 0, j = 1; i < j; i++, j--) {}", 'import("x").then(y => y); import.meta.url',
        "x ||= 1; y **= 2; z >>>= 3", '!function(){"use strict"}()', "delete a.b, void 0, typeof x === 'y'", "class X { static = 1; get; set; async; static static() {} }", "x = /[/\\]]+/.exec(y)", "#!/usr/bin/env node\nf()", "// <<<<<<< HEAD\n/* ======= */ s = `\n>>>>>>> x`",
    ],
    "typescript": [
        "let x: Array<Map<string, number[]>> = f<string>(y) as any;", "function f<T extends U = V>(this: Window, a?: T, ...r: T[]): asserts a is T {}", "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] };",
        "abstract class A<T> extends B<T> implements C, D { private readonly x?: number = 1; constructor(public a: string, private b = 2) { super() } abstract foo(): void; declare z: string; get q(): number { return 1 } [key: string]: any }",
        'enum E { A = 1, B = "x", C }\ndeclare const enum F { Z }', 'declare module "x" { export function f(a: number): string; const y: number }', "namespace A.B { export const x = 1 }", 'import type { A } from "a"; import { type B, C } from "b"; export type { D } from "d"',
        "let f = async <T,>(x: T): Promise<T> => x", "const x = y!.z!; let z = <any>w; const s = o satisfies P", "function over(a: string): void\nfunction over(a: any) {}", "let t: [a: string, b?: number, ...rest: boolean[]] = x", 'let u: "a" | "b" | `c${string}` | -1',
        "@dec() class Q { @input() x: string; @out({a: 1}) m(@p() q: number) {} }", "export default interface Foo { (x: number): string; new (y: string): Foo; m?(): void; readonly a: unique symbol }", 'export = foo', 'import fs = require("fs")', "if (a < b || c > d) {}",
        "function isS(x: unknown): x is string { return true }", "declare global { interface Window { x: number } }", "let v = a ? (b) : c", "let w = a ? (b, c) : d => e", "type G<T> = { [K in keyof T as `get${K}`]-?: () => T[K] }", "let m = new Map<string, Array<number>>();",
    ],
    "java": [
        "package a.b; import java.util.*; import static x.Y.z; public class A<T extends B & C> extends D<T> implements E, F<G> { private static final int X = 1, Y[] = {1,2,}; static { x(); } public A() throws Q { super(); } @Override public <T> List<? super T> f(final int... a) throws E { return null; } class B {} enum C { X, Y(1) { void f() {} }; int z; } interface D { default void f() {} } record R(int x, String y) { R { } static int q; } @interface Ann { int value() default 1; } }",
        'class A { void f() { int x = y > 0 ? 1 : 2; for (String s : list) {} do { } while (x); try (var r = open(); r2) { } catch (A | B e) { } finally { } switch (x) { case 1: case 2: f(); break; default: g(); } int z = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; Runnable r = () -> {}; F<A> h = (a, b) -> a + b; G g = String::valueOf; int[][] q = new int[3][]; Object o = (Object) x; long l = (long) -1; if (o instanceof String s && s.length() > 0) return; synchronized (this) { } new Thread() { public void run() {} }.start(); List<Map<String, Integer>> m = new ArrayList<>(); a.<T>b(c); x = y = z; i++; --j; String t = """\n  hi "x"\n  """; Class<?> k = int[].class; this.x += 1; a[0] = 1; var v = 0x1FL + 1_000.5e3f; y >>>= 2; } }',
        "sealed interface S permits A, B {} non-sealed class A implements S {}", "class T { char c = '\\u0041', d = '\\'', e = '}'; } // end", "",
    ],
    "go": [
        'package a\nimport (\n\t"x"\n\ty "z"\n\t. "w"\n)\ntype T[K comparable, V any] struct {\n\ta, b int `json:"x"`\n\t*E\n\tp.Q\n}\ntype I interface {\n\tM(a int) (b string, err error)\n\t~int | string\n}\nconst (\n\tA = iota\n\tB\n)\nfunc (r *T[K, V]) F(a, b int, c ...string) (int, error) {\n\tif x := f(); x > 0 {\n\t} else if y {\n\t} else {\n\t}\n\tfor k, v := range m {\n\t}\n\tfor x < 3 {\n\t}\n\tswitch x := y.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase x := <-ch:\n\tcase ch <- 1:\n\tdefault:\n\t}\n\tgo func() { x() }()\n\tdefer f(a, b...)\n\tm := map[string][]int{"a": {1, 2}, "b": nil}\n\tz := a[1:2:3]\nL:\n\tfor {\n\t\tbreak L\n\t}\n\ta, b = b, a\n\t_ = x.(T)\n\tif v == (T{1}) {\n\t}\n\treturn 1, nil\n}\n',
        "package a; func f() { if x { y() } ; switch { case a: b() } }", "package a\nfunc h(func(int) string, chan<- int, <-chan int, map[string]int)\n", "package a\n/* a\n*/ var x = `<<<<<<< HEAD\n` // =======\n",
    ],
    "rust": [
        "#![allow(x)]\nuse std::{a::{self, B}, c::*, d as e};\npub(crate) mod m;\n#[derive(Debug)] pub struct S<'a, T: A + 'a = B, const N: usize = 3> where T: C { pub a: &'a str, b: Vec<Option<T>>, }\npub struct U(pub u32, String);\nenum E { A, B(u32), C { x: i32 }, D = 4 }\ntrait T: A + B { type X: Y; fn f(&self) -> Self::X; fn g<F>(self: Box<Self>, f: F) where F: Fn(u32) -> u32 {} }\nimpl<T> T for S<T> where T: for<'a> Fn(&'a u8) -> u8 { fn f(&mut self) {} }\nunsafe impl Send for S {}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nextern \"C\" { fn c(x: i32, ...); }\n",
        "async fn f() -> impl Fn(u32) -> u32 { let x = if a { 1 } else { 2 }; let Some(y) = z else { return; }; match x { 1 | 2 => {} 3..=5 if y > 2 => foo(), E::A { x, .. } => 2, &(a, _) => 3, [a, .., b] => 4, _ => {} } while let Some(x) = it.next() { } loop { break 'a 3; } let c = move |x: u32, (a, b)| -> u32 { x }; x.await?; v[1..].iter().map(|&x| x as u8 as char).collect::<Vec<_>>(); let s = S { a: 1, b, ..Default::default() }; println!(\"{}\", x); unsafe { *p = 3 } let t = (1, \"a\", 'c', 1.0e3f32, 0xff_u8); x += 1 << 2; a.0.1; <T as Q>::f(); let r = r#\"a\"b\"#; if x == (S { a: 1 }) {} return }",
        "fn f() { /* a /* nested */ b */ let x = y >> 2; }", "",
    ],
}
INVALID = {
    "javascript": [
        "f(a b)", "let x = ;", "if (a { }", "const x;", "a + * b", "class { }", "x = {a b}", "for (;;", "import x from y", "let let = 1", "var x = 010", "1.toFixed()", "a b", "x = a ? b", "else {}", "enum A {B}", "let x: number = 1", "a = 1 = 2", "f() = 1", '{"version": 4, "rows": []}',
        "x => {} y", "export x", "get(data, options = {}) { }", "`${a b}`", 'var a = "x', "/* abc", "package a", "throw\nx", "<<<<<<< HEAD\na()\n", "}", "class A { m( { }", "@@ -1,2 +3,4 @@",
    ],
    "typescript": ["let x: = 1", "interface A { a: string b: number }", "class A { x: }", "enum A { B C }", "function f(a: ) {}", "type A = { a: string", "const x: number", 'import { A from "b"', "let a: string[ = b", "export class {}", "package a", "public class A {}", "def f(x):\n    pass"],
    "java": [
        "class A { void f() { a + b; } }", "class A { int x }", "class A { void f( { } }", "class A { void f() { return } }", "class A", "package a", "class A { void f() { int x = ; } }", "class A { void f() { if x { } } }", "class A { void f() { foo() } }", "enum A { X Y }", "class A extends { }",
        "class A { void f() { for (int i = 0; i < 3) {} } }", "import java.util.List", 'class A { String s = "a; }', "class A { void f() { else { } } }", "class A { char c = 'ab'; }", "fn f() {}", "class A { void f() { try { } } }", "class A { int x = 09; }", "const x = 1;",
    ],
    "go": [
        "package a\nfunc f() { x := }", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}", "package a\nfunc f( {", "package a\nvar x = []int{\n1\n}", "func f() {}", "package a\nx := 1", "package a\nfunc f() { a b }", 'package a\nimport "x', "package a\ntype T struct { a int b }", "package a\nclass A {}",
        "package a\nfunc f() { defer x }", "package a\nvar x = 'ab'", "package a\nfunc f(a int) string {\n\tcheck(a,\n\t\tb\n\t)\n}", "",
    ],
    "rust": [
        "fn f() { let x = }", "fn f() { a b }", "struct S { a u32 }", "fn f( {", "let x = 1;", "fn f() -> { }", "impl { }", "fn f() { match x { 1 = 2 } }", "enum E { A B }", "fn f() { foo(1 2) }", "class A {}", "fn f() { x. }", 'pub fn f() { "abc }', "use a::;", "fn f(x) {}", "mod",
        'fn f() { println!("a") println!("b") }',
    ],
}
PYTHON = [
    "", "\n# c\n", "x = 1", "if a:\n    b\nelif c: d\nelse:\n  e\n", "def f(a, /, b, *, c=1, **k) -> int: ...", "def f(a=1, b): pass", "def f(*): pass", "lambda: 0", "lambda *a, b=1, **c: a", "f(a, *b, c=1, **d)", "f(a=1, b)", "f(**a, b)", "f(**a, *b)", "f(x for x in y)", "f(x for x in y, z)", "f(a=1, *b)",
    "x: int", "x: int = 3", "(x): int = 3", "x, y = 1, 2", "a = b = c", "f() = 1", "a + b = c", "[a, *b] = c", "(a, b), c = d", "a.b[c] += 1", "a, b += 1", "for x, *y in z: pass", "for f() in z: pass", "with a as b, c as d: pass", "with (a as b, c as d,): pass", "with (a, b): pass", "try:\n pass\nexcept* E as e:\n pass\n",
    "try:\n pass\n", "try:\n pass\nfinally:\n pass\n", "class A(B, metaclass=M): pass", "@a.b(c)\nasync def f(): await x", "async for x in y: pass", "print 'x'", "raise a, b", "exec 'x'", "x = yield", "def f(): yield from a", "x = (y := 3)", "y := 3", "[x for x in y if z if w]", "{**a, 'b': 1}", "{*a, b}", "{a: b for a in c}", "{}", "{,}",
    "match x:\n    case [1, *rest] if y: pass\n    case {'a': b, **c}: pass\n    case A(x, y=1) | None as z: pass\n    case -1 | 'a' 'b' | (1+2j): pass\n    case _: pass\n", "match = 1\nmatch.x\ncase = 2", "match(x)", "import a.b as c, d", "from . import a", "from .a.b import (c as d, e,)", "from a import *", "from a import b,", "import a as b.c", "global a, b",
    "del a, b[c], (d, e)", "del f()", "assert a, b", "return", "x = 1_000 + 0xFF + 1e5j + .5", "x = 012", "x = 1__0", "x = 0b12", "'a' \"b\" '''c\nd'''", "b'a' 'b'", "b'é'", "'\\x4'", "r'\\x4'", "f'{a!r:>{w}} {{}} {b=}'", "f'{a b}'", "f'{}'", "f'{a'", "f'}'", "f'{a!z}'", 'f"{x[\'a\']}"', "u'a'", "'abc", '"""abc',
    "if a:\nb", "  x = 1", "if a:\n    b\n  c", "if a:\n\tb\n        c", "if a:\n    b\n\tc", "x = (1,\n  2\n)\n", "x = [1,\n", "x = 1)\n", "a \\\n  + b", "a; b; c;", "a;;b", "if a: b; c", "if a: if b: c", "class A:\n", "def f():\n    '''doc\nat margin'''\n    return 1\n", "not a in b", "a not in b is not c", "a if b else c if d else e", "a if b", "x = *a, b", "x = *a",
    "print(*a)", "a[1:2, ::3, *b]", "a[]", "()", "(a)", "(,)", "a.1", "1.real", "1 .real", "a..b", "...", "a ? b : c", "x++", "++x", "a <> b", "a && b", "!a", "$a", "`a`", "<<<<<<< HEAD", "=======", "x = 5 # <<<<<<<", "async = 1", "None = 1", "True.x = 1", "nonlocal x", "lambda (a): b", "def f((a, b)): pass", "f(a)(b)[c].d = 1", "\ufeffx = 1", "x = 'é' + ñ",
]


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    p = languages.language(language)
    for text in VALID[language]:
        assert p.valid(text), (text, p.check(text))


@pytest.mark.parametrize("language", INVALID)
def test_invalid(language):
    p = languages.language(language)
    for text in INVALID[language]:
        assert not p.valid(text), text


@pytest.mark.parametrize("text", PYTHON)
def test_python_agrees_with_its_parser(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.removeprefix("\ufeff"), feature_version=(3, 11))
            want = True
        except (SyntaxError, ValueError):
            want = False
    assert languages.language("python").valid(text) is want


@pytest.mark.parametrize("language", VALID)
def test_single_damage_is_found(language):
    """A bracket taken away always shows; valid text stays valid whatever was parsed before."""
    p = languages.language(language)
    text = max(VALID[language], key=len)
    for i, c in enumerate(text):
        if c in "(){}" and language in ("go", "java") and text[max(0, i - 1) : i + 2] not in ("'}'", '"}"'):
            assert not p.valid(text[:i] + text[i + 1 :])
    assert p.valid(text)


def test_tables_start_anew(monkeypatch):
    from siltstone.llm.syntax import peg

    monkeypatch.setattr(peg, "LIMIT", 5)
    p = languages.language("java")
    for _ in range(3):
        assert all(p.valid(t) for t in VALID["java"]) and not any(p.valid(t) for t in INVALID["java"])


def test_notation():
    k = Kinds()
    g = Grammar("S := A* B?\nA = 'x' !'y' / P(S)\nB = 'x' 'y' END\nEND_ = FAIL", k, {})
    x, y = k["x"] << 1, k["y"] << 1
    assert g.accepts("S", [x, x, x, y]) and not g.accepts("S", [x, y, x]) and g.accepts("S", [g.group("P", [x, x, y]) << 1, x])
    assert g.furthest("S", [x, y, x])[0] == 2
    with pytest.raises(ValueError):
        Grammar("S = (", k, {})


@pytest.mark.parametrize(
    "language, text, line, cause",
    [
        ("python", "x = 1\ny = (2\n", 3, "unclosed bracket"), ("python", "x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n", 2, "merge conflict"), ("go", "import os\n", 1, "content is python"),
        ("java", "class A {\n  int x = ;\n}\n", 2, "unexpected token"), ("javascript", "f();\ng(a b);\n", 2, "unexpected token"), ("rust", "fn f() {\n  x(1));\n}\n", 2, "unbalanced bracket"), ("python", "def f():\n", 2, "truncated"), ("go", "package a\nvar x = 'ab'\n", 2, "illegal or unterminated token"),
    ],
)
def test_reports(language, text, line, cause):
    valid, at_line, _, why = judge(text.encode(), language)
    assert not valid and at_line == line and why.startswith(cause), (at_line, why)


def test_deep_nesting():
    js = languages.language("javascript")
    assert languages.language("python").valid("x = " + "(" * 150 + "1" + ")" * 150)
    for n in (1000, 30_000):
        assert js.valid("x = " + "[" * n + "]" * n) and js.valid("x = " + "[" * n + "a b" + "]" * n) is False
    assert js.valid("if (a) {} " + "else if (a) {} " * 8000) and js.valid("x = " + "a ? b : " * 8000 + "c")


def test_the_report_on_nested_brackets_is_quick():
    js = languages.language("javascript")
    began = time.perf_counter()
    assert js.check("x = " + "[" * 200 + "a b" + "]" * 200) == (False, 206, "unexpected token")
    assert time.perf_counter() - began < 0.5


@pytest.mark.parametrize(
    "text, want",
    [
        ("`${xs.map(x => { if (x) { return `a`; } })}`", True), ("`${a(b => { if (c) { while (d) { e({f: {g: `${1}`}}) } } })}`", True), ("`${a b}${`${c}`}`", False), ("`${`", False),
        ("if (x) /['\"]/.test(s)", True), ("a = (b) / c / d", True), ("while (x) /[/`]/g.exec(y); `z`", True), ("x = {a: 1} / 2; f(`${{}}`)", True),
        ("function f() { await x }", False), ("async function f() { await x; for await (const a of b) {} return `${await z}` }", True), ("function f() { return `${await z}` }", False), ("await x", True), ("() => await x", False), ("async () => await x", True),
        ("async x => { return y => { await z } }", False), ("class A { x = await 1 }", False), ("class A { static { return } }", False), ("return 1", False), ("a => { return 1 }", True), ("if (a) { return }", False),
        ("function* g() { yield 1; yield* a; yield }", True), ("function g() { yield 1 }", False), ("x = {async *f() { yield await 1 }, *g() { yield }, async h() { await 2 }, get i() { return 1 }}", True), ("class A { async *f() { yield await 1 } async() {} get() {} }", True),
        ("a ?? b || c", False), ("(a ?? b) || c && d", True), ("a && b ?? c", False), ("-a ** b", False), ("(-a) ** b ** -c", True), ("++a ** b", True), ("typeof a ** b", False),
    ],
)
def test_contexts_of_modules(text, want):
    assert languages.language("javascript").valid(text) is want


MARKUP = [
    ('export const A = () => <div className="x">{y}</div>;', True), ("const a = <><A.B x={1} {...p} y='\"' z/>it's text {/* c */} {b && <i>q</i>}</>", True), ("const a = <a></b>", False), ("x = <div>{a b}</div>", False), ("x = <div>", False), ("a < b; c > d", True),
    ("import React from 'react'\nexport default class App extends React.Component {\n  render() {\n    return (\n      <ul onClick={() => this.go(1)}>\n        {xs.map(x => <li key={x}>{`${x}`} / 2</li>)}\n      </ul>\n    )\n  }\n}\n", True),
    ("<a:b c-d='1'>{}</a:b>", True), ("x = <a b=c/>", False), ("x = <a>}</a>", False),
]


@pytest.mark.parametrize("language", ["javascript", "typescript"])
@pytest.mark.parametrize("text, want", MARKUP)
def test_markup(language, text, want):
    p = languages.language(language)
    assert p.valid(text, True) is want and p.check(text, True)[0] is want
    if "</" in text or "/>" in text:
        assert not p.valid(text)


def test_markup_beside_types():
    p = languages.language("typescript")
    for text in (
        "export const A = (p: P): JSX.Element => <div onClick={(e: E) => f(e as any)}>{y!}</div>;", "const f = <T,>(x: T) => x", "const f = <T extends U>(x: T) => <p>{x}</p>",
        "interface Props { a: string }\nexport class App extends React.Component<Props> {\n  render() {\n    return <A<string> />\n  }\n}\n".replace("<A<string> />", "<A b={c<D>(1)} />"),
    ):
        assert p.valid(text, True), (text, p.check(text, True))
    assert p.valid("let z = <any>w") and p.valid("function f() { await x }")


def test_rust_nests_to_any_depth():
    p = languages.language("rust")
    assert p.valid("fn f() { /* a /* b /* c /* d /* e /* f */ */ */ */ */ */ let x = r#####\"a\"# b\"#####; }")
    assert not p.valid("fn f() { /* a /* b /* c /* d /* e /* f */ */ */ */ */ let x = 1; }")
    assert p.check("/* /* /* /* /* */ */ */ */ */\nfn f() { a b }")[1] == 41


def test_markup_by_extension(spark):
    text = b"export const A = () => <b>{x}</b>\n"
    rows = [(1, "r", "a.tsx", "typescript", text), (2, "r", "b.JSX", None, text), (3, "r", "c.js", "javascript", text), (4, "r", "d.ts", "typescript", text)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, language string, content binary")
    assert {r.file_id: r.valid for r in check_files(df).collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {r.file_id: r.valid for r in check_files(df, markup=(".tsx",)).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_table(spark):
    rows = [
        (1, "r", "a.py", "python", b"x = 1\r\n"), (1, "r", "a.py", "python", b"x = 1\r\n"), (2, "r", "b.py", None, b"x = ("), (3, "s", "c.go", " GO ", b"package a\n"), (4, "s", "d.txt", None, b"("), (5, "s", "e.py", "binary", b"\x00"),
        (6, "s", "f.py", "unknown", b"\xff"), (7, "s", "g.py", "python", None), (8, "s", "h.py", "python", b"\xff"), (None, "s", "i.py", "python", b"("), (None, "s", "i.py", "python", b"("), (9, None, None, "java", b"class A {}"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, repo string, path string, language string, content binary, valid string")
    got = sorted(((r.file_id or 0, r.language, r.valid) for r in check_files(df).collect()))
    assert got == [(0, "python", False), (0, "python", False), (1, "python", True), (2, "python", False), (3, "go", True), (7, "python", True), (8, "python", False), (9, "java", True)]
    r = {(x.repo, x.language, x.level): (x.n_files, x.n_invalid) for x in rates(check_files(df, detail=False)).collect()}
    assert r["r", "python", 0] == (2, 1) and r[None, None, 3] == (8, 4) and r[None, "go", 2] == (1, 0)
    assert check_files(df.limit(0)).count() == 0


def test_corpus_agrees_with_python(spark, small):
    from siltstone.llm.queries import p3_found, p3_invalid_files

    files = {r.file_id: r for r in spark.read.parquet(f"{small}/files.parquet").collect()}
    found = {r.file_id for r in p3_found(spark, small).collect()}
    assert found == {r.file_id for r in p3_invalid_files(spark, small).collect()} and found
    for i, f in files.items():
        if f.language == "python":
            try:
                ast.parse(bytes(f.content), feature_version=(3, 11))
                assert i not in found
            except SyntaxError:
                assert i in found
