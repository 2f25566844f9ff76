"""Captures of the scanners, language by language."""

import pytest

from siltstone.extract.scanner import reader, scan, search_imports

CASES = {
    "python": (
        'import os\nimport a.b, c\nfrom . import x\nfrom ..pkg.mod import (\n    y,\n    z,\n)\nfrom __future__ import annotations\nLIMIT = 3\nname: int = 4\n\n\nclass A(Base, mod.Other, metaclass=M):\n    """Doc\nwith text at the margin\n    """\n\n    x = 1\n\n    def m(self):\n        def inner():\n            pass\n        return 1\n\n    @property\n    def p(self): return 2\n\nasync def f(\n    a,\n):\n    # def not_this():\n    s = "class NotThis:"\n',
        [("LIMIT", "variable", None), ("name", "variable", None), ("A", "class", None), ("m", "method", "A"), ("inner", "function", None), ("p", "function", None), ("f", "function", None)],
        [("os", "imports"), ("a.b", "imports"), ("c", "imports"), (".", "imports"), ("..pkg.mod", "imports"), ("Base", "inherits")],
    ),
    "typescript": (
        'import { a } from "./x";\nimport type { b } from \'y\';\nexport interface I { m(): void }\nexport type T = { a: string }\nexport enum E { A = 1 }\nexport abstract class C<K> extends B implements I, J {\n  private n = { a: 1 };\n  constructor(private x: number = 1) { super() }\n  async get(a: string, b = {}): Promise<void> {\n    if (a) { call(b) }\n  }\n  static make() { return new C() }\n}\nexport const arrow = async (a: number): number => {\n  return a\n}\nexport function fn<K>(a: K) {}\nconst notThis = 5;\n',
        [("I", "interface", None), ("T", "type", None), ("E", "enum", None), ("C", "class", None), ("constructor", "method", "C"), ("get", "method", "C"), ("make", "method", "C"), ("arrow", "function", None), ("fn", "function", None)],
        [("./x", "imports"), ("y", "imports"), ("B", "inherits"), ("I", "implements"), ("J", "implements")],
    ),
    "javascript": (
        "import x from './x.js'\nclass A extends B {\n  m(a = {}) { for (;;) { } }\n  get v() { return `class ${z}` }\n}\nfunction f() {}\nconst g = a => a\nlet r = s.replace(/[({]+/g, '')\n",
        [("A", "class", None), ("m", "method", "A"), ("v", "method", "A"), ("f", "function", None), ("g", "function", None)],
        [("./x.js", "imports"), ("B", "inherits")],
    ),
    "go": (
        'package a\n\nimport "fmt"\nimport (\n\tx "a/b"\n\t_ "c"\n)\n\ntype S struct {\n\tA int\n}\n\ntype (\n\tT interface{}\n\tU = S\n)\n\nfunc F(a int) error {\n\treturn nil // func no() {\n}\n\nfunc (s *S) M() {\n}\n',
        [("S", "type", None), ("T", "type", None), ("U", "type", None), ("F", "function", None), ("M", "method", None)],
        [("fmt", "imports"), ("a/b", "imports"), ("c", "imports")],
    ),
    "rust": (
        "use std::io;\nuse a::{b, c};\npub use d::e as f;\npub struct S<'a> { x: &'a str }\nenum E { A }\npub trait T { fn sig(&self) -> u32; fn dflt(&self) {} }\ntype N = u32;\nimpl S {\n    pub fn m(&self) -> char { '}' }\n}\nimpl T for S { fn sig(&self) -> u32 { 1 } }\nfn free() {}\n",
        [("S", "class", None), ("E", "enum", None), ("T", "interface", None), ("dflt", "function", None), ("N", "type", None), ("m", "method", "S"), ("sig", "method", "T"), ("free", "function", None)],
        [("std::io", "imports")],
    ),
    "java": (
        'package a;\nimport a.b.C;\nimport a.d.*;\npublic class K extends L implements M, N<O> {\n    int f = call(1);\n    public K(int a) { super(); }\n    @Override public String m(int a) throws E {\n        if (a > 0) { return "class X {"; }\n        return new K(1).go();\n    }\n    abstract void none();\n}\ninterface I { void i(); }\nenum Q { A, B }\n',
        [("K", "class", None), ("K", "method", "K"), ("m", "method", "K"), ("none", "method", "K"), ("I", "interface", None), ("i", "method", None), ("Q", "enum", None)],
        [("a.b.C", "imports"), ("a.d", "imports"), ("L", "inherits"), ("M", "implements")],
    ),
}


@pytest.mark.parametrize("language", CASES)
def test_captures(language):
    text, symbols, refs = CASES[language]
    s, r = scan(text, language, "p")
    assert [(x["name"], x["kind"], x["parent"]) for x in s] == symbols
    assert [(x["target_name"], x["kind"]) for x in r] == refs
    assert [x["ord"] for x in s] == list(range(len(s))) and all(x["file"] == "p" for x in s)


def test_lines_and_signatures():
    s, r = scan(CASES["python"][0], "python", "p")
    by = {x["name"]: x for x in s}
    assert (by["A"]["line"], by["A"]["end_line"], by["A"]["signature"]) == (13, 26, "class A(Base, mod.Other, metaclass=M)")
    assert (by["m"]["line"], by["m"]["end_line"], by["f"]["end_line"]) == (20, 23, 32)
    assert by["f"]["signature"] == "async def f(" and [x["line"] for x in r][:2] == [1, 2]
    long = scan("def f(" + "a, " * 200 + "):\n    pass\n", "python", "p")[0][0]
    assert len(long["signature"]) == 200 and long["signature"].endswith("...")


@pytest.mark.parametrize("language", CASES)
def test_damaged_text(language):
    text = CASES[language][0]
    for cut in range(0, len(text), 7):
        scan(text[:cut], language, "p")
        scan(text[cut:], language, "p")
    assert scan("", language, "p") == ([], []) and scan("x", "cobol", "p") == ([], [])


def test_partial_symbols_of_a_syntax_error():
    s, _ = scan("def good():\n    return 1\n\ndef broken(:\n", "python", "p")
    assert [x["name"] for x in s] == ["good", "broken"]


def test_import_patterns():
    assert search_imports("import os\n\nfrom .a import b\n", "python") == [("os", 1), (".a", 2)]  # the blank line belongs to the match
    assert search_imports("const a = require('x')\nimport y from 'z'\n", "javascript") == [("z", 2), ("x", 1)]  # pattern by pattern
    assert search_imports("export * from 'z'\n", "typescript") == search_imports("use a::b;\n", "go") == search_imports("x", "cobol") == []


def test_unsupported_language():
    with pytest.raises(ValueError, match="unsupported"):
        reader("cobol")
    assert callable(reader("rust"))
