"""Expressions against their Python counterparts."""

import posixpath

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.functions.tokens import estimate


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(F.expr(expr) if isinstance(expr, str) else expr).first()[0]


@pytest.mark.parametrize("p", ["a/b.py", "./a//b", "a/../b", "../a", "a/../../b", "/a/../../b", "a\\b\\..\\c", "", ".", "a/./b/", "/", "a..b/c"])
def test_normal_form(spark, p):
    want = posixpath.normpath(p.replace("\\", "/"))
    assert one(spark, t.normalize_path("v"), p) == want


def test_null_path(spark):
    assert one(spark, t.normalize_path("v"), None) is None


@pytest.mark.parametrize("s", ["AuthService", "Auth_Login", "HTTPServer", "a_b", "x", "", "été_Été foo.bar", "__init__", "getX2Y"])
def test_tokens(spark, s):
    assert one(spark, t.tokenize("v"), s) == t.python_tokenize(s)


def test_split_forms():
    assert t.python_tokenize("HTTPServer") == ["httpserver", "h", "t", "t", "p", "server"]
    assert t.python_tokenize("Auth_Login") == ["auth_login", "auth", "login", "auth_", "login"]


@pytest.mark.parametrize("p, want", [("a/B.PY", "python"), ("x.tsx", "typescript"), ("x.mjs", "javascript"), (".gitignore", None), ("a.b.ts", "typescript"), ("", None), ("d.py/x", None)])
def test_language(spark, p, want):
    assert one(spark, t.language_of("v"), p) == want


@pytest.mark.parametrize("p, s, f", [("a/auth.test.ts", "auth.test", "auth.test"), (".py", "", ".py"), ("x", "x", "x"), ("a.b/c.d.e", "c.d", "c.d")])
def test_stems(spark, p, s, f):
    assert one(spark, t.stem("v"), p) == s
    assert one(spark, t.file_stem("v"), p) == f


@pytest.mark.parametrize("p, want", [("a/tests/x.py", True), ("tests/x.py", False), ("test_x.py", True), ("a/x_test.py", True), ("x_test.go", False), ("a.spec.ts", True), ("a/__tests__/b.ts", True)])
def test_test_paths(spark, p, want):
    assert one(spark, t.is_test_path("v"), p) is want


def test_in_order(spark):
    f = lambda a, b: one(spark, t.in_order(t.string_array(a), t.string_array(b)), "")
    assert f(["a", "x", "b"], ["a", "b"]) is True
    assert f(["b", "a"], ["a", "b"]) is False
    assert f(["a"], []) is False


@pytest.mark.parametrize("s, n", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1)])
def test_lines(spark, s, n):
    assert one(spark, t.line_count("v"), s) == n


def test_estimate():
    assert estimate("") == 0
    assert estimate("word") >= 1 and estimate("word word") >= estimate("word")
