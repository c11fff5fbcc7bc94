"""Following a contract as it is rebuilt, with Structured Streaming.

Spark's file source sees each path once, so a watched contract is published as versions in a folder, one file each, the
greatest name being the newest. A version that cannot be parsed leaves the last good one in place.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans import contract as contracts


#: Versions that stay in a folder.
KEPT = 20


def versions_of(path: str) -> str:
    """The folder of versions beside a contract's file."""
    return f"{path}.versions"


def publish(contract: dict | str, folder: str) -> str:
    """Write the next version, of a contract or of the file that holds one; the oldest beyond KEPT go."""
    os.makedirs(folder, exist_ok=True)
    done = sorted(f for f in os.listdir(folder) if f.startswith("v") and f.endswith(".json"))
    path = f"{folder}/v{int(done[-1].split('.')[0][1:]) + 1 if done else 1:012d}.json"
    if isinstance(contract, str):
        shutil.copyfile(contract, f"{path}.part")
        os.replace(f"{path}.part", path)
    else:
        contracts.save(contract, path)
    for old in done[: -(KEPT - 1)]:
        os.remove(f"{folder}/{old}")
    return path


def latest_valid(versions: DataFrame, key: str, version: str, body: str, parsed: str) -> DataFrame:
    """For each key the newest version whose body parsed; one shuffle on the key, combined before it."""
    good = versions.filter(F.col(parsed).isNotNull())
    return good.groupBy(key).agg(F.max(version).alias(version), F.max_by(body, version).alias(body))


class Watcher:
    """Holds the newest good contract of a folder of versions; `on_change` hears of each new one.

    It begins with the newest good version that is there. After that a stream brings new ones, each once, by its
    checkpoint. A version counts once nothing newer came for `quiet` seconds, so versions in quick succession are one change.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str, on_change: Callable[[dict], None] | None = None, interval: str = "1 second", quiet: float = 0.05) -> None:
        self.spark, self.folder, self.checkpoint, self.interval, self.quiet = spark, folder, checkpoint, interval, quiet
        self.on_change = on_change
        self.contract: dict | None = None
        self.version = ""
        self._waiting: tuple[str, dict] | None = None
        self._timer: threading.Timer | None = None
        self._lock = threading.Lock()
        self.query = None

    def _versions(self, reader) -> DataFrame:
        return reader.format("text").option("wholetext", "true").option("pathGlobFilter", "v*.json").load(self.folder).select("value", F.col("_metadata.file_path").alias("path"))

    def _newest(self, rows: DataFrame) -> tuple[str, dict] | None:
        """Name and contract of the newest version that is a JSON object."""
        valid = rows.withColumn("ok", F.try_parse_json("value")).filter("ok is not null and schema_of_variant(ok) like 'OBJECT%'").select("path", "value")
        found = valid.orderBy(F.desc("path")).limit(1).collect()
        return (os.path.basename(found[0]["path"]), json.loads(found[0]["value"])) if found else None

    def _batch(self, batch: DataFrame, _: int) -> None:
        if not (found := self._newest(batch)):
            return
        with self._lock:
            if found[0] <= max(self.version, self._waiting[0] if self._waiting else ""):
                return
            self._waiting = found
            if self._timer:
                self._timer.cancel()
            self._timer = threading.Timer(self.quiet, self.settle)
            self._timer.daemon = True
            self._timer.start()

    def settle(self) -> None:
        """Take the version that waits, if one does."""
        with self._lock:
            if self._waiting:
                (self.version, self.contract), self._waiting = self._waiting, None
                if self.on_change:
                    self.on_change(self.contract)

    def start(self, once: bool = False) -> Watcher:
        os.makedirs(self.folder, exist_ok=True)
        self._waiting = self._newest(self._versions(self.spark.read)) if glob.glob(f"{glob.escape(self.folder)}/v*.json") else None
        self.settle()
        writer = self._versions(self.spark.readStream).writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval)).start()
        return self

    def finish(self) -> None:
        """After start(once=True): wait for what was there, and take it."""
        self.query.awaitTermination()
        self.settle()

    def stop(self) -> None:
        if self.query:
            self.query.stop()
        if self._timer:
            self._timer.cancel()
