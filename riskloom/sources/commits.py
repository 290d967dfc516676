"""A commit log for tables of whole folders: versions that never overwrite each other.

``{root}/_log`` holds one small JSON file per version, named by its number. A version is
written beside the log and then put in place only if no file of that number is there, so
of two writers one finds the place taken, reads what the other has committed and decides
again. Data lie in ``{root}/data`` in a folder of their own per write and are complete
before the version that names them; folders that no version names are swept by ``vacuum``.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    """The versions of the table at ``root``, as dictionaries in the order of their numbers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._read: list[dict] = []

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """All versions; those read before are not read again."""
        folder, files = self._path("_log")
        if not files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(folder))
        for name in [n for n in names if n.endswith(".json")][len(self._read) :]:
            stream = files.open(self._path(f"_log/{name}")[0])
            try:
                self._read.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return list(self._read)

    def put(self, entry: dict, version: int) -> bool:
        """Make ``entry`` the version of this number; False if another writer has been faster."""
        target, files = self._path(f"_log/{version:012d}.json")
        draft = self._path(f"_log/{uuid.uuid4().hex}.draft")[0]
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, **entry}).encode()))
        out.close()
        try:
            return self._placed(files, draft, target)
        finally:
            files.delete(draft, False)

    def _placed(self, files, draft, target) -> bool:
        """Rename that never replaces: atomic in file systems that offer it, by a link on a local disk."""
        if files.getUri().getScheme() == "file":
            try:
                os.link(urlparse(draft.toString()).path, urlparse(target.toString()).path)
            except FileExistsError:
                return False
            return True
        jvm = self.spark._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        renames = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, renames)
        except Exception:
            if files.exists(target):
                return False
            raise
        return True

    def commit(self, entry: dict, still_valid: Callable[[list[dict]], bool] = lambda newer: True) -> int | None:
        """Put ``entry`` behind all versions; None when ``still_valid`` refuses one that came in between.

        ``still_valid`` sees the versions that were not there when ``entries`` was last read.
        """
        while True:
            known = len(self._read)
            newer = self.entries()[known:]
            if newer and not still_valid(newer):
                return None
            version = len(self._read) + 1
            if self.put(entry, version):
                self._read.append({"version": version, **entry})
                return version

    def write(self, rows: DataFrame, label: str, partition_by: str | None = None) -> tuple[str, int]:
        """Write ``rows`` to a new folder; its name below ``root`` and the number of rows, counted on the way."""
        folder, seen = f"data/{label}-{uuid.uuid4().hex}", Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{folder}")
        return folder, int(seen.get["rows"])

    def drop(self, folder: str) -> None:
        path, files = self._path(folder)
        files.delete(path, True)

    def folders(self, below: str = "data") -> dict[str, dt.datetime]:
        """Folders of data, referenced or not, and when they were last changed."""
        path, files = self._path(below)
        if not files.exists(path):
            return {}
        found = [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(path)]
        return {f"{below}/{name}": dt.datetime.fromtimestamp(changed / 1000, dt.UTC) for name, changed in found}

    def vacuum(self, keep: set[str], before: dt.datetime) -> list[str]:
        """Delete folders that are not in ``keep`` and were last changed before ``before``; the folders deleted.

        ``before`` must lie behind every write that is still under way.
        """
        gone = [folder for folder, changed in self.folders().items() if folder not in keep and changed < before]
        for folder in gone:
            self.drop(folder)
        return gone
