"""Numbered heads over states in a folder: a state is seen once a head that names it is there, and heads appear whole."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Heads that stay, and with them the states that they name; a reader has as long to finish as it takes to write so many.
KEPT = 3


class Heads:
    """The folders `heads` and `states` below a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def numbers(self) -> list[int]:
        """Numbers of the heads that are there, in order."""
        return [int(n.removesuffix(".json")) for n in self.names("heads") if n.endswith(".json") and not n.startswith(".")]

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self.path("heads", f"{number:012d}.json"), wholetext=True).first()[0])

    def publish(self, number: int, head: dict) -> None:
        part, final = self._path("heads", f".{number:012d}.part"), self._path("heads", f"{number:012d}.json")
        out = self._files.create(part, True)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        if not self._files.rename(part, final):
            raise OSError(f"no head could be written: {final}")

    def tidy(self, states: Callable[[dict, int], set[int]]) -> None:
        """Delete heads beyond KEPT, and the states before the newest that no other names; states: those a head and its number name."""
        done = self.numbers()
        kept = done[-KEPT:]
        named = {s for n in kept for s in states(self.read(n), n)}
        for n in done[:-KEPT]:
            self._files.delete(self._path("heads", f"{n:012d}.json"), False)
        for name in self.names("states"):
            if int(name) not in named and int(name) < kept[-1]:
                self._files.delete(self._path("states", name), True)
