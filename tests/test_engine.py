"""Scanning, snapshots, the engine and the command line on repositories on disk."""

import hashlib
import json
import os
import subprocess

import pytest

from siltstone.cli import main
from siltstone.errors import CacheError, SiltstoneError
from siltstone.plans.engine import Engine
from siltstone.sources.scan import describe, read_repository, walked_paths
from siltstone.sources.snapshot import Snapshot, resolve_cache_dir

SOURCES = {
    "pkg/models.py": b"class User:\n    def name(self):\n        return 1\n",
    "pkg/auth.py": b"from .models import User\n\ndef login(u):\n    return User()\n",
    "pkg/tests/test_auth.py": b"from ..auth import login\n\ndef test_login():\n    login(1)\n",
    "pkg/empty.py": b"",
    "pkg/odd name+%20.py": b"X = 1\n",
    "bin.py": b"\x00\x01",
    "latin.py": "é = 1".encode("latin-1"),
    "notes.txt": b"words",
    "web/app.ts": b'import { x } from "./lib";\nexport class App {}\n',
    "web/lib.ts": b"export const x = () => 1;\n",
}


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for p, c in SOURCES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(c)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    subprocess.run(["git", "-C", str(root), "add", "-A"], check=True)
    return root


def test_reading(spark, repo):
    got = {r.path: bytes(r.content) for r in read_repository(spark, str(repo)).collect()}
    assert got == {p: c for p, c in SOURCES.items() if not p.endswith(".txt")}
    only = {r.path for r in read_repository(spark, str(repo), ["typescript"]).collect()}
    assert only == {"web/app.ts", "web/lib.ts"}
    assert read_repository(spark, str(repo), ["cobol"]).count() == 0


def test_walk(tmp_path):
    for p in ("a.py", ".hidden/b.py", "node_modules/c.py", "x.egg-info/d.py", "src/e.py", "build/f.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / "big.py").write_bytes(b"x" * 1_000_001)
    assert walked_paths(str(tmp_path)) == ["a.py", "src/e.py"]


def test_sentinels(spark):
    late = b"x" * 8192 + b"\x00"
    rows = [("r", "a.py", b"\x00"), ("r", "b.py", b"\xff"), ("r", "c.py", b""), ("r", "d.zz", b"x\ny"), ("r", "e.py", late), ("r", "f.py", None)]
    got = {r.path: (r.language, r.content_hash, r.lines) for r in describe(spark.createDataFrame(rows, "repo string, path string, content binary")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {
        "a.py": ("binary", "", 0), "b.py": ("unknown", "", 0), "c.py": ("python", sha(b""), 0), "d.zz": ("unknown", sha(b"x\ny"), 2), "e.py": ("python", sha(late), 1), "f.py": ("python", sha(b""), 0),
    }


def test_engine(spark, repo):
    e = Engine(spark, str(repo))
    s = e.stats
    assert s["files"] == 9 and s["languages"] == {"python": 5, "typescript": 2, "binary": 1, "unknown": 1} and s["cache_misses"] == 8 and s["cache_hits"] == 0
    links = {(r.src, r.dst, r.kind) for r in e.edges.collect()}
    assert {("pkg/auth.py", "pkg/models.py", "imports"), ("pkg/tests/test_auth.py", "pkg/auth.py", "tests"), ("web/app.ts", "web/lib.ts", "imports")} <= links
    assert "### pkg/auth.py" in e.query("login auth", 800)
    assert json.loads(e.query("login", 800, "json"))["files"][0]["path"] == "pkg/auth.py"
    assert e.query("  ") == "" and e.context_for([]) == ""
    assert "pkg/models.py" in e.context_for(["pkg/auth.py", "gone.py"], 800)
    assert e.context_for(["gone.py"]) == "<!-- No matching files found in index -->"
    assert json.loads(e.context_for(["gone.py"], format="json")) == {"files": [], "error": "No matching files found"}
    assert e.repo_map(400).startswith("## Relevant Context")
    for bad in (0, -1):
        with pytest.raises(SiltstoneError):
            e.query("x", bad)
    pack = e.evidence_for_query("login zebra")
    assert pack["files"][0]["path"] == "pkg/auth.py" and pack["missed_terms"] == ["zebra"] and 0 < pack["confidence"] <= 1
    assert e.evidence_for_query("...")["files"] == [] and e.evidence_for_files(["gone.py"])["confidence"] == 0.0
    assert e.evidence_for_files(["pkg/auth.py", "gone.py"])["seed_files"] == ["pkg/auth.py"]
    json.dumps(pack)
    # Again: hits for what is unchanged; a changed, a new and a removed file.
    (repo / "pkg/auth.py").write_bytes(b"def logout():\n    pass\n")
    (repo / "pkg/new.py").write_bytes(b"def fresh():\n    pass\n")
    os.remove(repo / "web/lib.ts")
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    e.refresh()
    s = e.stats
    assert s["files"] == 9 and s["cache_hits"] == 5 and s["cache_misses"] == 3  # the undecodable file never hits
    names = {x["name"] for r in e.symbols.collect() for x in r.symbols}
    assert {"logout", "fresh"} <= names and "login" not in names


def test_languages_and_no_cache(spark, repo):
    e = Engine(spark, str(repo), cache=False, languages=["typescript"])
    assert e.stats["files"] == 2 and not (repo / ".siltstone").exists()
    with pytest.raises(SiltstoneError):
        Engine(spark, str(repo / "pkg/auth.py"))


def test_cli(spark, repo, capsys):
    at = ["--repo", str(repo)]
    assert main(["stats", *at], spark) == 0 and json.loads(capsys.readouterr().out)["files"] == 9
    assert main(["evidence", *at, "--text", "login", "--limit", "1"], spark) == 0 and len(json.loads(capsys.readouterr().out)["files"]) == 1
    assert main(["evidence", *at], spark) == 1 and main(["map", *at, "--budget", "0"], spark) == 1
    assert main(["clear", *at]) == 0 and not (repo / ".siltstone").exists()
    with pytest.raises(SystemExit):
        main(["nothing"])


def rows(spark, *paths):
    from siltstone.operators.index import FILES

    return spark.createDataFrame([("", p, "python", f"h-{p}", 1, [("f", "function", p, 1, "def f()", None, None, 0)], []) for p in paths], FILES)


def test_snapshot(spark, tmp_path):
    with Snapshot(spark, str(tmp_path / "c")) as s:
        assert s.get_all().count() == 0
        s.put(rows(spark, "a", "b"))
        s.put(rows(spark, "b", "c"))
        assert sorted(r.path for r in s.get_all().collect()) == ["a", "b", "c"]
        assert s.get("a", "h-a").first().symbols[0].name == "f" and s.get("a", "other").count() == 0
        s.invalidate("a")
        s.invalidate("a")
        assert sorted(r.path for r in Snapshot(spark, str(tmp_path / "c")).get_all().collect()) == ["b", "c"]
        (current,) = (tmp_path / "c").glob(f"files-{s.store.versions()[-1]}-*")
        for f in current.glob("*.parquet"):
            f.write_bytes(b"broken")
        assert s.get_all().count() == 0  # a damaged snapshot starts anew
        s.put(rows(spark, "z"))
        s.clear()
        assert s.get_all().count() == 0
    s.close()
    with pytest.raises(CacheError):
        s.get_all()


def test_cache_dir(tmp_path, monkeypatch):
    assert resolve_cache_dir(str(tmp_path)) == str(tmp_path / ".siltstone")
    monkeypatch.setenv("SILTSTONE_CACHE_DIR", f" {tmp_path}/env ")
    assert resolve_cache_dir(str(tmp_path)) == f"{tmp_path}/env"
    assert resolve_cache_dir(str(tmp_path), f"{tmp_path}/given") == f"{tmp_path}/given"
