"""Published relations for point look-ups: sorted by their key, so that a look-up reads the row group that may hold it.

A version is a table of files, each with its range of keys in order and a Bloom filter of them; a head names the newest
whole version, so a reader never sees half of one. A look-up is a pushed equality: files and row groups are left by their
least and greatest keys, and by the Bloom filter, before a row is read. Nothing is merged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.streaming.heads import Heads

#: Bytes of a row group, about: what a look-up reads.
GROUP = 1 << 20


class Published:
    """A relation in a folder, by its key."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "name") -> None:
        self.spark, self.key = spark, key
        self.heads = Heads(spark, folder)

    def publish(self, rows: DataFrame, group: int = GROUP) -> int:
        """Write the next version of the relation; its number."""
        number = max(self.heads.numbers(), default=0) + 1
        ordered = rows.repartitionByRange(self.key).sortWithinPartitions(self.key)
        writer = ordered.write.mode("overwrite").option("parquet.block.size", group).option("parquet.page.size", min(group, 1 << 16))
        writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(self.heads.path("states", f"{number:012d}"))
        self.heads.publish(number, {"schema": rows.schema.jsonValue()})
        self.heads.tidy(lambda head, n: {n})
        return number

    def read(self) -> DataFrame:
        """The newest version; an error if there is none."""
        if not (done := self.heads.numbers()):
            raise LookupError(f"nothing is published in {self.heads.folder}")
        schema = T.StructType.fromJson(self.heads.read(done[-1])["schema"])
        return self.spark.read.schema(schema).parquet(self.heads.path("states", f"{done[-1]:012d}"))

    def find(self, key: str, *orders: str) -> DataFrame:
        """The row of the key, the first by the orders if it has several; no row if there is none."""
        rows = self.read().filter(F.col(self.key) == F.lit(key))
        return rows.orderBy(*orders).limit(1) if orders else rows


def find_token(tokens: Published, name: str, category: str = "") -> DataFrame:
    """The token of a name, in a category or in the first that has it."""
    rows = tokens.read().filter(F.col("name") == F.lit(name))
    return (rows.filter(F.col("category") == F.lit(category)) if category else rows).orderBy("at").limit(1)

