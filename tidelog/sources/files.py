"""Small-file access through Hadoop's file systems, so a store can lie wherever Spark reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..model import BadConfig


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local master may do without that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise BadConfig("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{root}/store-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str, sync: bool = False):
        self.sync = sync
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self.local = self._fs.getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self._path(self.at(name)))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._path(self.at(name)), True)
        stream.write(bytearray(data))
        if self.sync:
            stream.hsync()
        stream.close()

    def write_new(self, name: str, data: bytes) -> bool:
        """Write a file at once, or nothing if the name is taken: the whole content under another name first, then a rename that never replaces."""
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(tmp, data)
        if self.local:
            plain = [self._path(self.at(x)).toUri().getPath() for x in (tmp, name)]
            try:
                os.link(*plain)
                return True
            except FileExistsError:
                return False
            finally:
                self.delete(tmp)
        try:
            ctx = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
            none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            opts = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            opts[0] = none
            ctx.rename(self._path(self.at(tmp)), self._path(self.at(name)), opts)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self.delete(tmp)
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
