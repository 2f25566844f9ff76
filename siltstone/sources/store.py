"""A folder on shared storage with small text files that appear as a whole and at most once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def located(folder: str) -> str:
    """The folder with its scheme; a plain path is one of the driver's own file system."""
    return folder.rstrip("/") if ":/" in folder else "file://" + os.path.realpath(os.path.expanduser(folder))


class Store:
    """Files of one folder, through the Hadoop file system of its scheme."""

    def __init__(self, spark: SparkSession, folder: str):
        self.root = located(folder)
        self._jvm = spark.sparkContext._jvm
        base = self.path("")
        self._fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(base)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(""))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def versions(self) -> list[int]:
        """The numbers of the files ``v<N>.json``, in order."""
        return sorted(int(n[1:-5]) for n in self.names() if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def take(self, name: str, text: str) -> bool:
        """Make a file, if none of its name exists; readers see all of it or nothing.

        Exactly one of two writers takes a name. On a local file system a hard link sees to it, on HDFS a rename,
        which refuses an existing target, and elsewhere (object stores, whose files appear when closed) a create
        that must not overwrite, which the store has to support as a conditional write.
        """
        target = self.path(name)
        scheme = self._fs.getScheme()
        if self._fs.exists(target):
            return False
        if scheme not in ("file", "hdfs", "viewfs", "webhdfs"):
            try:
                self._write(target, text)
            except Exception:
                if self._fs.exists(target):
                    return False
                raise
            return True
        staged = self.path(f".staged-{uuid.uuid4().hex}")
        self._write(staged, text)
        try:
            if scheme == "file":
                os.link(staged.toUri().getPath(), target.toUri().getPath())
                return True
            return bool(self._fs.rename(staged, target))
        except FileExistsError:
            return False
        finally:
            self._fs.delete(staged, False)

    def _write(self, path, text: str) -> None:
        stream = self._fs.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()
