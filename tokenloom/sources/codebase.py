"""Source files of a project as a DataFrame of whole texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.model import CodebaseSource
from tokenloom.sources import listing
from tokenloom.sources.globs import glob_regex, ignore_regex


def select_files(files: DataFrame, patterns: list[str], ignore: list[str]) -> DataFrame:
    """(pattern, ...): the rows whose `file`, a relative path, a pattern matches, once for each such pattern, minus ignored ones."""
    for pattern in ignore:
        files = files.filter(~F.col("file").rlike(ignore_regex(pattern)))
    # a pattern's * does not match names that begin with a dot
    files = files.filter(~F.col("file").rlike(r"(^|/)\."))
    matched = F.array_compact(F.array(*[F.when(F.col("file").rlike(glob_regex(p)), F.lit(k)) for k, p in enumerate(patterns)]))
    return files.select(F.explode(matched.cast("array<int>")).alias("pattern"), *files.columns)


def _by_spark(spark: SparkSession, source: CodebaseSource) -> DataFrame:
    """(file, content) by Spark's own listing of the whole root, for stores that the data source does not reach."""
    root = source.root.rstrip("/")
    reader = spark.read.option("recursiveFileLookup", "true")
    endings = {p.rsplit("/", 1)[-1] for p in source.patterns}
    if endings and all(re.fullmatch(r"\*\.\w+", e) for e in endings):
        reader = reader.option("pathGlobFilter", "{" + ",".join(sorted(endings)) + "}")
    raw = reader.text(root, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    at = F.locate(root.removeprefix("file://") + "/", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    relative = F.substr(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), at + len(root.removeprefix("file://")) + 1)
    return raw.select(relative.alias("file"), "content")


def scan_files(spark: SparkSession, source: CodebaseSource) -> DataFrame:
    """(pattern, file, content): every file under root that a pattern matches, once for each such pattern.

    Files come in the order of (pattern, path). Folders that can't hold any are not listed; each text is read once for
    all its patterns.
    """
    if re.match(r"(?!file:|hdfs:|s3:|gs:)\w+:", source.root):
        found = _by_spark(spark, source)
    else:
        spark.dataSource.register(listing.ProjectFiles)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        found = spark.read.format(listing.FORMAT).options(root=source.root, patterns=json.dumps(source.patterns), ignore=json.dumps(source.ignore)).load()
    return select_files(found, source.patterns, source.ignore)
