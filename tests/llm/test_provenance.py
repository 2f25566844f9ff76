"""Sorts of files, on hand-made cases and the labelled sample."""

import pytest

from siltstone.llm.provenance import classify_by_method, classify_files, sort_of

CODE = b"import os\n\n\ndef load(path, default=None):\n    if not os.path.exists(path):\n        return default\n    with open(path) as f:\n        return f.read().strip() or default\n\n\ndef save(path, text):\n    with open(path, 'w') as f:\n        f.write(text)\n"
GETTERS = b"class A:\n\n" + b"".join(b"    def get_%s_%03d(self):\n        return self._values[%d]\n\n" % (w, i, i) for i, w in enumerate([b"alpha", b"beta", b"gamma"] * 30))

CASES = [
    ("src/a.py", b"# Code generated by foo. DO NOT EDIT.\n" + CODE, "generated"),
    ("src/a.go", b"/*\n * Copyright 2016\n *\n * @generated by foo\n */\npackage a\n", "generated"),
    ("src/a.py", b"#!/usr/bin/env python\n\n# Fichier produit par x ; toute modification sera perdue.\n" + CODE, "generated"),
    ("src/a.py", b"# Tidied by hand after the foo output was dropped; edit freely.\n# Was generated by foo.\n" + CODE, "hand_written"),
    ("src/emit.py", CODE + b"\nHEAD = '# @generated by us, do not edit'\n", "hand_written"),
    ("src/emit.py", CODE + b"\n# automatically generated files are skipped\n", "hand_written"),
    ("api/user_pb2.py", CODE, "generated"), ("api/user.pb.go", b"package a", "generated"), ("src/__generated__/x.ts", b"", "generated"), ("src/codegen/emit.py", CODE, "hand_written"),
    ("src/generated_report.py", CODE, "hand_written"), ("src/a.py", GETTERS, "generated"),
    ("lib/node_modules/left/index.js", b"x", "vendored"), ("lib/vendor/pkg/pkg.py", CODE, "vendored"), ("lib/vendor/pkg/src/pkg.py", CODE, "vendored"), ("shop/vendor/vendor_order.py", CODE, "hand_written"),
    ("src/x.js", b"/*\n * foo v1.2.3\n * (c) 2014 Foo contributors\n * Released under a permissive license.\n */\nexport const a = 1;\n", "vendored"),
    ("src/x.js", b"// Copyright 2020 the core maintainers.\n// Licensed under the same terms as the rest of this repository.\nexport const a = 1;\n", "hand_written"),
    ("web/a.js", b"/*! a v1 */\n" + b"!function(){var a=1,b=[2,3];function c(d,e){return d&&e>5?c(d):null}" * 30, "minified"), ("web/a.min.js", b"x", "minified"),
    ("src/words.py", CODE + b'\nWORDS = "' + b"alpha beta gamma " * 200 + b'"\n', "hand_written"),
    ("src/table.py", b"TABLE = [\n" + b"    " + b"12345, " * 12 * 20 + b"\n]\n", "data"), ("src/font.js", b'export default "data:font/woff2;base64,' + b"QmFzZTY0" * 100 + b'";\n', "data"), ("package-lock.json", b"{}", "data"),
    ("vendor/github.com/pkg/errors/stack.go", b"package errors\n", "vendored"), ("third_party/uuid/index.js", CODE, "vendored"), ("third_party/uuid/lib/rng.js", CODE, "vendored"), ("a/deps/foo/src/foo2.ts", CODE, "vendored"),
    ("vendor/uuid.js", b"// uuid.js\n// MIT License\n// Copyright (c) 2010\n" + CODE, "vendored"), ("src/uuid.js", b"// MIT License\n// Copyright (c) 2010\n" + CODE, "hand_written"), ("shop/vendor/reports/total.py", CODE, "hand_written"), ("shop/vendor/uuid.js", CODE, "hand_written"),
    ("src/a.py", b"# Users do not edit these by accident, so names are checked.\n" + CODE, "hand_written"), ("src/a.py", b"# Reads what was generated by the importer.\n" + CODE, "hand_written"), ("src/a.py", b"# Note: this file was generated by x.\n" + CODE, "generated"),
    ("src/a.py", b"# Models. Do not edit.\n" + CODE, "generated"), ("src/a.py", b"# a.py -- generated by x; do not edit\n" + CODE, "generated"),
    ("src/a.py", b"", "hand_written"), (None, None, "hand_written"), ("src/a.py", b"\xff\xfe\x00", "hand_written"),
]


@pytest.mark.parametrize("path, content, want", CASES)
def test_sorts(path, content, want):
    assert sort_of(path, "repo", content)[0] == want


def test_table(spark):
    files = [(1, "r", "a.py", "H", CODE, 1), (1, "r", "a.py", "H", CODE, 2), (2, "r", "b.py", "UP", CODE, 1), (None, "r", "c.py", None, CODE, 1), (None, "r", "c.py", None, CODE, 1)]
    files += [(3, "r", "d.py", "", b"# Copyright 2017 the leftpad maintainers.\n" + CODE, 1), (4, "leftpad", "d.py", "", b"# Copyright 2017 the leftpad maintainers.\n" + CODE, 1)]
    files = spark.createDataFrame(files, "file_id bigint, repo string, path string, content_hash string, content binary, sort int")
    upstream = spark.createDataFrame([("leftpad", "up"), (None, None), ("other", "")], "package string, content_hash string")
    got = sorted((r.file_id or 0, r.sort) for r in classify_files(files, upstream).collect())
    assert got == [(0, "hand_written"), (0, "hand_written"), (1, "hand_written"), (2, "vendored"), (3, "vendored"), (4, "hand_written")]
    assert classify_files(files.limit(0), upstream.limit(0)).count() == 0


def test_labels(spark, small):
    from siltstone.llm.queries import p2_file_sorts

    labels = {r.file_id: r.label for r in spark.read.parquet(f"{small}/file_labels.parquet").collect()}
    got = {r.file_id: r.sort for r in p2_file_sorts(spark, small).collect()}
    assert {k: got[k] for k in labels} == labels


def test_copies_show_by_their_body(spark):
    head = b"/*\n * foo v1.2.3\n * (c) 2014 Foo contributors\n * Released under a permissive license.\n */\n"
    body = b"export function alpha(beta, gamma) {\n  return beta + gamma * 17;\n}\n" * 6
    rows = [(1, "a", "x/foo.js", "", head + body), (2, "b", "y/bar.js", "", body.rstrip() + b"\r\n// local patch\n"), (3, "b", "y/own.js", "", body.replace(b"alpha", b"delta")), (4, "b", "z.js", "", b"f();")]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, path string, content_hash string, content binary")
    upstream = spark.createDataFrame([], "package string, content_hash string")
    assert {r.file_id: r.sort for r in classify_files(files, upstream).collect()} == {1: "vendored", 2: "vendored", 3: "hand_written", 4: "hand_written"}


def test_the_method_alone(spark):
    rows = [(1, "r", "a.py", b"# @generated\n" + CODE), (1, "r", "a.py", b"# @generated\n" + CODE), (2, "r", "x.min.js", b"x"), (3, "r", "t.py", b"T = [" + b"1234, " * 400 + b"]\n"), (None, None, None, None)]
    files = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, repo string, path string, content binary, sort string")
    assert sorted(((r.file_id or 0, r.sort) for r in classify_by_method(files).collect())) == [(0, "hand_written"), (1, "generated"), (2, "minified"), (3, "hand_written")]
    assert classify_by_method(files.limit(0)).count() == 0


def test_long_numbers_are_no_counters():
    lines = b"".join(b"    f(1%025d)\n" % i for i in range(90))
    assert sort_of("src/a.py", "r", CODE + lines)[0] == "hand_written"
    assert sort_of("src/a.py", "r", CODE + b"".join(b"    f(%d)\n" % i for i in range(90)))[0] == "generated"
    assert sort_of("src/a.py", "r", b"A = '" + b"9" * 6000 + b"'\n" + CODE)[0] == "hand_written"
