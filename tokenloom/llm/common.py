"""Shared folder, scratch tables and batch helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: dict[str, str] = {}
#: Scratch folders of each application, as they were made.
_SCRATCH: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one for a session on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
    return _OWN_DIR[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tokenloom/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the scratch tables and files that were made inside: what is computed from them must be written by then."""
    made = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        for path in made[before:]:
            _delete(spark, path)
        del made[before:]


def release_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables and files of the application; results that were not written before can't be read any more."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, on every executor's reach."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame | str) -> None:
    """Delete scratch tables (or folders, by their paths) that no later result reads; anything else stays."""
    spark = SparkSession.active()
    made = _SCRATCH.get(spark.sparkContext.applicationId, [])
    for table in tables:
        if not isinstance(table, str):
            files = table.inputFiles()[:1]
            table = files[0].rpartition("/")[0] if files else ""
        for path in [p for p in made if p.rpartition("/")[2] == table.rpartition("/")[2]]:
            _delete(spark, path)
            made.remove(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, as a scratch table; the scratch that making it took is deleted."""
    path = scratch_path(spark, name)
    with freeing(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_number(df: DataFrame, column: str) -> Column:
    """The column as a long; an error if it holds anything but whole numbers, since a cast would turn other ids into null."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")
    return F.col(column).cast("long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, since one row can hold a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def releasing(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back to the system when the task ends: workers are used again."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, memory stays
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and the rows' offsets in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row if that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: A key is hot if it has a thousandth of all rows, and HOT_ROWS at least: so there are a thousand hot keys at most.
HOT_SHARE, HOT_ROWS = 1000, 1000


def look_up(rows: DataFrame, found: DataFrame, key: str, spread_by: str, how: str = "inner", parts: int = 32, count: str | None = None, total: int = 0) -> DataFrame:
    """rows joined with `found`, which has one row for a key; a key that many rows have is spread over so many parts.

    `found` is repeated in each part, the rows are dealt to them by a hash of spread_by. The join is by sorting: the
    repeated table's size is not what its estimate says, so it must not be broadcast on that. Where `count` names the
    column of found that has each key's number of rows, of `total`, only hot keys are repeated; those, a bounded number, are broadcast.
    """
    copies, spread = F.lit(parts), F.lit(parts)
    if count is not None:
        hot = F.broadcast(found.filter(F.col(count) >= max(HOT_ROWS, total // HOT_SHARE)).select(key, F.lit(parts).alias("__parts")))
        found, rows = found.join(hot, key, "left"), rows.join(hot, key, "left")
        copies = spread = F.coalesce("__parts", F.lit(1))
    salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__parts")
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), spread.cast("long")).cast("int")).drop("__parts")
    return dealt.join(salted.hint("merge"), [key, "__salt"], how).drop("__salt")
