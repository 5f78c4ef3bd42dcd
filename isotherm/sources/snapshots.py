"""Versioned tables: whole snapshots in folders of their own, published by numbered commits.

A commit is a small file that names a folder. It is written aside and then renamed to the next number without replacing anything, which
succeeds for one writer only; the other reads what has been published meanwhile and makes its change again. Readers see one version
from beginning to end, a failed write leaves the table as it was, and versions before the last few are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


class Snapshots:
    """One table at ``path``; the last ``keep`` versions stay."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, oldest first."""
        if not self._files().exists(self._at(COMMITS)):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(self._at(COMMITS))]
        return sorted(int(n) for n in names if n.isdigit())

    def _commit(self, version: int) -> dict:
        stream = self._files().open(self._at(COMMITS, f"{version:012d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The last version, or the given one; None before the first commit."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise LookupError(f"no version {version} of {self.path}")
        commit = self._commit(known[-1] if version is None else version)
        return self.spark.read.schema(commit["schema"]).parquet(f"{self.path}/{commit['folder']}")

    def commit(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
        """Publishes ``change`` of the last version as the next one and returns its number; ``change`` is made again where another writer was first."""
        for _ in range(tries):
            known = self.versions()
            base = known[-1] if known else 0
            folder = f"data-{uuid.uuid4().hex}"
            new = change(self.read(base) if base else None)
            try:
                new.write.parquet(f"{self.path}/{folder}")
                if self._published(base + 1, {"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)}):
                    self._expired(base + 1)
                    return base + 1
            except BaseException:
                self._files().delete(self._at(folder), True)
                raise
            self._files().delete(self._at(folder), True)
        raise Conflict(self.path)

    def _published(self, version: int, commit: dict) -> bool:
        aside = self._at(COMMITS, f"new-{uuid.uuid4().hex}")
        stream = self._files().create(aside, False)
        stream.write(json.dumps(commit).encode())
        stream.close()
        gateway, options = self.spark.sparkContext._gateway, getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never = gateway.new_array(options, 1)
        never[0] = options.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.conf).rename(aside, self._at(COMMITS, f"{version:012d}"), never)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._files().delete(aside, False)
            return False
        return True

    def _expired(self, last: int) -> None:
        for version in self.versions():
            if version <= last - self.keep:
                folder = self._commit(version)["folder"]
                self._files().delete(self._at(COMMITS, f"{version:012d}"), False)
                self._files().delete(self._at(folder), True)
