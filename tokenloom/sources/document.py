"""The contract's file as a Python data source that is written to: fragments from the executors, one file at the commit.

Rows come in the order of the document, range by range: each task writes its own rows, as the document shows them, to a file beside the
target, and says where in it which section stands. The commit puts the fragments one after another between the
document's brackets, copying bytes, and moves the whole into place. So no row passes the driver as an object, a reader
sees the old file or the new one, and a job that fails leaves the old one and no fragments.
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tokenloom import model as m

FORMAT = "contract_document"
SCHEMA = "section int, category string, key string, body string"
TOKENS, COMPONENTS, CONFLICTS, RULES = range(4)
#: Fields that stand there also when they have no value.
FIELDS = {TOKENS: ("name", "value", "source"), CONFLICTS: ("type", "name", "sources", "resolution", "suggestedFix", "actionable"), RULES: ("id", "category", "rule", "confidence", "evidence")}
#: How deep each section's entries stand.
DEPTH = {TOKENS: 3, COMPONENTS: 2, CONFLICTS: 2, RULES: 3}


def _text(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def entry(section: int, key: str | None, body: str) -> str:
    """One entry as it stands in the document."""
    value = json.loads(body)
    if section in FIELDS:
        value = {f: value.get(f) for f in FIELDS[section]}
    pad = "  " * DEPTH[section]
    return pad + (f"{_text(key)}: " if key is not None else "") + _text(value).replace("\n", f"\n{pad}")


@dataclass
class Fragment(WriterCommitMessage):
    """A task's file, and the pieces of it: section, category, where it begins and ends."""

    partition: int
    name: str
    pieces: list[tuple[int, str | None, int, int]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.head = options["path"], options["head"]
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def _at(self, path: str):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)

    def write(self, iterator: Iterator) -> Fragment:
        task = TaskContext.get()
        name = f"{task.partitionId():09d}-{task.taskAttemptId()}"
        fs, folder = self._at(self.parts)
        fs.create_dir(folder, recursive=True)
        pieces: list[tuple[int, str | None, int, int]] = []
        at = 0
        with fs.open_output_stream(f"{folder}/{name}") as sink:
            for section, category, key, body in iterator:
                text = entry(section, key, body)
                if pieces and pieces[-1][:2] == (section, category):
                    text = ",\n" + text
                else:
                    pieces.append((section, category, at, at))
                raw = text.encode("utf-8", "surrogatepass")
                sink.write(raw)
                at += len(raw)
                pieces[-1] = (*pieces[-1][:3], at)
        return Fragment(task.partitionId(), name, pieces)

    def commit(self, messages: list) -> None:
        fragments = sorted((x for x in messages if x is not None), key=lambda x: x.partition)
        sections: dict[int, dict] = {k: {} for k in DEPTH}
        for c in m.CATEGORIES:
            sections[TOKENS][c] = []
        for f in fragments:
            for section, category, lo, hi in f.pieces:
                sections[section].setdefault(category, []).append((f.name, lo, hi))
        fs, folder = self._at(self.parts)
        _, target = self._at(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/whole") as sink:
            put = lambda text: sink.write(text.encode("utf-8", "surrogatepass"))

            def entries(pieces: list, brackets: str, depth: int) -> None:
                if not pieces:
                    return put(brackets)
                put(brackets[0] + "\n")
                for k, (name, lo, hi) in enumerate(pieces):
                    put(",\n" if k else "")
                    with fs.open_input_file(f"{folder}/{name}") as source:
                        source.seek(lo)
                        shutil.copyfileobj(_Limited(source, hi - lo), sink)
                return put("\n" + "  " * depth + brackets[1])

            head = json.loads(self.head)
            put(_text(head)[:-2] + ',\n  "tokens": {\n')
            for k, (category, pieces) in enumerate(sections[TOKENS].items()):
                put((",\n" if k else "") + f"    {_text(category)}: ")
                entries(pieces, "{}", 2)
            put('\n  },\n  "components": ')
            entries(sections[COMPONENTS].get(None, []), "{}", 1)
            put(',\n  "conflicts": ')
            entries(sections[CONFLICTS].get(None, []), "[]", 1)
            put(f',\n  "inferredRules": {{\n    "generatedAt": {_text(head["generatedAt"])},\n    "rules": ')
            entries(sections[RULES].get(None, []), "[]", 2)
            put("\n  }\n}")
        fs.move(f"{folder}/whole", target)
        fs.delete_dir(folder)

    def abort(self, messages: list) -> None:
        fs, folder = self._at(self.parts)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class _Limited:
    """The next bytes of a file, and no more."""

    def __init__(self, source, left: int) -> None:
        self.source, self.left = source, left

    def read(self, size: int = -1) -> bytes:
        got = self.source.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(got)
        return got


class ContractDocument(DataSource):
    """Options path and head: the fields before the sections, as JSON."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        if not overwrite:
            raise ValueError("a contract is written anew: use mode overwrite")
        return DocumentWriter(self.options)


def rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The document's entries in its order: one sort by ranges, each section by its own order."""
    json_of = lambda *fields: F.to_json(F.struct(*fields))
    none = F.lit(None).cast("string")
    props = F.coalesce("props", F.create_map().cast(m.PROPS)).alias("props")
    tokens = parts["tokens"].select(F.lit(TOKENS).alias("section"), "category", F.col("name").alias("key"), json_of("name", "value", "source").alias("body"), F.col("at").alias("by0"))
    components = parts["components"].select(F.lit(COMPONENTS).alias("section"), none.alias("category"), F.col("name").alias("key"), json_of("name", "source", "variants", props).alias("body"), F.col("at").alias("by1"))
    conflicts = parts["conflicts"].select(F.lit(CONFLICTS).alias("section"), none.alias("category"), none.alias("key"), json_of(*FIELDS[CONFLICTS]).alias("body"), F.col("ord").alias("by2"))
    rules = parts["rules"].select(F.lit(RULES).alias("section"), none.alias("category"), none.alias("key"), json_of(*FIELDS[RULES]).alias("body"), F.col("ord").alias("by3"))
    every = tokens
    for more in (components, conflicts, rules):
        every = every.unionByName(more, allowMissingColumns=True)
    return every.orderBy("section", "by0", "by1", "by2", "by3").select("section", "category", "key", "body")


def write(spark: SparkSession, parts: dict[str, DataFrame], head: dict, path: str) -> None:
    """Write the contract of these parts; head: its fields before the sections, in order."""
    spark.dataSource.register(ContractDocument)
    rows(parts).write.format(FORMAT).option("head", json.dumps(head)).mode("overwrite").save(path)
