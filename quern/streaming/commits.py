"""Epochs that become visible at once: tables of a micro-batch are written first, its marker last.

A marker is an empty file `commits/<epoch>-<notes>`; creating it is the commit. Readers take only epochs that have one, so
they see all tables of an epoch or none. A batch that is replayed after its marker was made is left alone; one that failed
before is written again over what it left. All files lie where the path says, in any file system that Spark writes to.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def all(self) -> list[tuple[int, ...]]:
        """(epoch, notes...) of all committed epochs, in order."""
        where = self._jpath(f"{self.path}/commits")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(tuple(int(x) for x in n.split("-")) for n in names if n[:1].isdigit())

    def before(self, n: int) -> tuple[int, ...] | None:
        """The last epoch committed before epoch n: what a batch may build on, replayed or not."""
        return max((c for c in self.all() if c[0] < n), default=None)

    def has(self, n: int) -> bool:
        return any(c[0] == n for c in self.all())

    def add(self, n: int, *notes: int) -> None:
        name = "-".join(str(x) for x in (f"{n:012d}", *notes))
        self._fs.create(self._jpath(f"{self.path}/commits/{name}"), True).close()

    def drop(self, folder: str) -> None:
        self._fs.delete(self._jpath(f"{self.path}/{folder}"), True)

    def exists(self, folder: str) -> bool:
        return self._fs.exists(self._jpath(f"{self.path}/{folder}"))
