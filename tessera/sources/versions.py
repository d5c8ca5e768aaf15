"""A folder of numbered versions, of which the last complete one counts: a write that breaks off leaves the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_DONE = "_complete"


class Versions:
    """Versions of what lies under ``path``. Readers that hold one may finish: the version before the last is kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        files, where = self._at(self.path)
        if not files.exists(where):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in files.listStatus(where) if s.getPath().getName().startswith("v-"))

    def _complete(self, number: int) -> bool:
        files, where = self._at(f"{self.path}/v-{number}/{_DONE}")
        return files.exists(where)

    def current(self) -> str | None:
        """The folder of the last complete version."""
        return next((f"{self.path}/v-{n}" for n in reversed(self._numbers()) if self._complete(n)), None)

    def write(self, fill: Callable[[str], None]) -> str:
        """Make a new version: ``fill`` writes below the folder that it is given; what is older than the version before is deleted."""
        known = self._numbers()
        made = f"{self.path}/v-{(known[-1] if known else 0) + 1}"
        before = self.current()
        fill(made)
        files, where = self._at(f"{made}/{_DONE}")
        files.create(where, True).close()
        for n in known:
            if f"{self.path}/v-{n}" != before:
                files, where = self._at(f"{self.path}/v-{n}")
                files.delete(where, True)
        return made

    def wipe(self) -> None:
        files, where = self._at(self.path)
        files.delete(where, True)
