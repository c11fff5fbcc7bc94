"""The last good state of each key, kept by a stream as a table.

A micro-batch brings versions of documents, some broken. The table holds of each key the newest version that is not. It is
cut into buckets by a hash of the key; a batch writes the buckets that it changes anew, beside the old ones, and then
a head: a file that names the state of every bucket. Readers take the newest head, so they see whole batches only. A batch
that comes again, after a crash or a restart, finds its head and changes nothing, or writes the same once more.

The state is the table: nothing else is kept between batches, and a bucket is all that one task holds the versions of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokenloom.streaming.heads import Heads
from tokenloom.streaming.watch import latest_valid

BUCKETS = 64


class Snapshot:
    """A table (key, version, body) in a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, buckets: int = BUCKETS) -> None:
        """schema: of key, version and body, in this order."""
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.key, self.version, self.body = self.schema.names
        self.heads = Heads(spark, self.folder)

    def _head(self, number: int | None) -> dict[int, int]:
        """The batch that wrote each bucket's state."""
        return {} if number is None else {int(k): v for k, v in self.heads.read(number).items()}

    def _rows(self, head: dict[int, int], buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/states/{batch:012d}/bucket={b}" for b, batch in sorted(head.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the newest whole batch."""
        return self._rows(self._head(max(self.heads.numbers(), default=None)))

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of (key, version, body, ok); rows whose `ok` is null, or without a key, change nothing."""
        done = self.heads.numbers()
        if number in done:
            return
        head = self._head(max((n for n in done if n < number), default=None))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = latest_valid(batch.filter(F.col(self.key).isNotNull()), self.key, self.version, self.body, "ok").persist()
        try:
            touched = {r[0] for r in new.select(bucket.alias("bucket")).distinct().collect()}  # at most a row for each bucket
            if touched:
                before = self._rows(head, touched).select(*self.schema.names)
                both = before.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])).withColumn("ok", F.lit(True))
                after = latest_valid(both, self.key, self.version, self.body, "ok").select(bucket.alias("bucket"), *self.schema.names)
                after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/states/{number:012d}")
        finally:
            new.unpersist()
        self.heads.publish(number, head | dict.fromkeys(touched, number))
        self.heads.tidy(lambda known, _: set(known.values()))

    def follow(self, versions: DataFrame, ok: str, checkpoint: str, once: bool = False, interval: str = "1 second") -> StreamingQuery:
        """Keep the table up to date with a stream of versions; `ok` names the column that is null in broken ones."""
        rows = versions.select(*self.schema.names, F.col(ok).isNotNull().alias("good")).withColumn("ok", F.when(F.col("good"), F.lit(True)))
        writer = rows.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
