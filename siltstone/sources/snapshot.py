"""The persistent index: a snapshot of parsed files on disk, compared with listings by content hash."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CacheError
from ..functions.text import normalize_path
from ..operators.index import FILES
from .store import Store

ENVIRONMENT = "SILTSTONE_CACHE_DIR"


def listing(scans: DataFrame) -> DataFrame:
    """The files present by their latest scans: ``repo, path, content_hash``."""
    s = scans.filter("repo is not null and path is not null").select("repo", normalize_path("path").alias("path"), F.struct("seen_at", "scan_id", F.coalesce("is_deleted", F.lit(False)).alias("gone"), F.lower("content_hash").alias("h")).alias("s"))
    return s.groupBy("repo", "path").agg(F.max("s").alias("s")).filter("not s.gone").select("repo", "path", F.col("s.h").alias("content_hash"))


def diff(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``repo, path, state``: ``hit`` (same hash; an empty hash never hits), ``miss`` (new or changed) or ``stale`` (no longer listed)."""
    s = snapshot.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.lower("content_hash").alias("_h"))
    both = current.join(s, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "full_outer")
    state = F.when(F.col("path").isNull(), "stale").when((F.col("_h") == F.lower("content_hash")) & (F.col("_h") != ""), "hit").otherwise("miss")
    return both.select(F.coalesce("repo", "_r").alias("repo"), F.coalesce("path", "_p").alias("path"), state.alias("state"))


def resolve_cache_dir(repo_path: str, explicit: str | None = None) -> str:
    """Where the snapshot lies: as given, by the environment, or below the repository."""
    named = explicit or os.environ.get(ENVIRONMENT, "").strip() or os.path.join(repo_path, ".siltstone")
    return os.path.realpath(os.path.expanduser(named))


class Snapshot:
    """Versions of the files table in one folder of any file system; a version counts once its pointer ``v<N>.json`` is there.

    Writing makes a new folder and then takes the next pointer in one step, so readers see the old or
    the new snapshot, a crash leaves the old one, and of two writers one fails. The version before the
    last stays for those who still read it. A pointer or table that can't be read is dropped and the
    snapshot starts empty.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.closed = spark, False
        try:
            if ":/" not in folder:
                folder = self._usable(folder)
            self.store = Store(spark, folder)
        except (OSError, Py4JJavaError) as e:
            raise CacheError(f"cannot use {folder}: {e}") from e
        self.folder = folder

    @staticmethod
    def _usable(folder: str) -> str:
        """The folder, or one below the user's own where it may not be written."""
        try:
            os.makedirs(folder, exist_ok=True)
            probe = os.path.join(folder, f".probe-{uuid.uuid4().hex}")
            open(probe, "w").close()
            os.remove(probe)
        except PermissionError:
            folder = os.path.join(os.path.expanduser("~"), ".cache", "siltstone", hashlib.sha256(folder.encode()).hexdigest()[:16])
            os.makedirs(folder, exist_ok=True)
        return folder

    def _open(self) -> None:
        if self.closed:
            raise CacheError("the snapshot is closed")

    def get_all(self) -> DataFrame:
        """All files of the snapshot."""
        self._open()
        versions = self.store.versions()
        if versions:
            try:
                name = json.loads(self.store.read(f"v{versions[-1]}.json"))["files"]
                df = self.spark.read.schema(FILES).parquet(f"{self.store.root}/{name}")
                df.limit(1).collect()
                return df
            except Exception:  # a damaged snapshot starts anew
                self.clear()
        return self.spark.createDataFrame([], FILES)

    def get(self, path: str, content_hash: str, repo: str = "") -> DataFrame:
        """The file of this path and hash, if any."""
        return self.get_all().filter((F.col("repo") == repo) & (F.col("path") == path) & (F.col("content_hash") == content_hash))

    def write(self, files: DataFrame) -> None:
        """Replace the snapshot."""
        self._open()
        version = max(self.store.versions(), default=0) + 1
        name = f"files-{version}-{uuid.uuid4().hex}"
        files.select("repo", "path", "language", "content_hash", "lines", "symbols", "refs").write.parquet(f"{self.store.root}/{name}")
        if not self.store.take(f"v{version}.json", json.dumps({"files": name})):
            self.store.remove(name)
            raise CacheError(f"version {version} was written by another run")
        for old in [n for n in self.store.names() if (m := re.match(r"(?:files-|v)(\d+)[-.]", n)) and int(m.group(1)) < version - 1]:
            self.store.remove(old)

    def put(self, files: DataFrame) -> None:
        """Add or replace files by path."""
        kept = self.get_all().join(files.select(F.col("repo").alias("_r"), F.col("path").alias("_p")), (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left_anti")
        self.write(kept.unionByName(files.select(*kept.columns)))

    def invalidate(self, path: str, repo: str = "") -> None:
        """Remove one file; nothing happens if it isn't there."""
        self.write(self.get_all().filter((F.col("repo") != repo) | (F.col("path") != path)))

    def clear(self) -> None:
        """Remove everything."""
        self._open()
        for name in sorted(self.store.names(), reverse=True):  # pointers before tables
            if re.match(r"(?:files-|v)\d+[-.]", name):
                self.store.remove(name)

    def close(self) -> None:
        """Later calls raise; closing twice is fine."""
        self.closed = True

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
