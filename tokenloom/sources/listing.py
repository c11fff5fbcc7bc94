"""A project's files as a Python data source that lists only folders that can hold something wanted.

A folder that is ignored, that is hidden, or below which no pattern can match is never listed. The driver lists breadth first until
there are enough folders to share out; executors list and read what is below theirs. Filters on `file` reach the source:
equality, membership and a beginning narrow the folders as patterns do.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from tokenloom.sources.globs import glob_regex, ignore_regex

FORMAT = "project_files"
SCHEMA = "file string, content string"
#: Folders among which the driver shares out the rest, at least, if there are so many.
SHARED = 64


def segments(pattern: str) -> list[str]:
    """A pattern's parts between slashes; from the first part that may cross a slash on, anything may follow."""
    out, part, depth = [], "", 0
    for c in pattern:
        depth += (c == "{") - (c == "}" and depth > 0)
        if c == "/" and depth:
            return [*out, "**"]
        if c == "/":
            out.append(part)
            part = ""
        else:
            part += c
    out.append(part)
    crossing = next((k for k, s in enumerate(out) if "**" in s), len(out))
    return [*out[:crossing], "**"] if crossing < len(out) else out


class Rule:
    """What of a project is wanted: patterns, ignored names, and filters on the path."""

    def __init__(self, patterns: list[str], ignore: list[str], only: list[str] | None = None, prefixes: list[str] = ()) -> None:
        self.wanted = [re.compile(glob_regex(p)) for p in patterns]
        self.parts = [[s if s == "**" else re.compile(glob_regex(s)) for s in segments(p)] for p in patterns]
        self.ignored = [re.compile(ignore_regex(p)) for p in ignore]
        self.only, self.prefixes = None if only is None else set(only), list(prefixes)

    def takes(self, file: str) -> bool:
        """Whether a file is wanted, by its path below the root."""
        if self.only is not None and file not in self.only or not all(file.startswith(p) for p in self.prefixes):
            return False
        return not re.search(r"(^|/)\.", file) and any(r.match(file) for r in self.wanted) and not any(r.match(file) for r in self.ignored)

    def enters(self, folder: str) -> bool:
        """Whether something below a folder may be wanted."""
        if re.search(r"(^|/)\.", folder) or any(r.match(folder) for r in self.ignored):
            return False
        below = folder + "/"
        if not all(p.startswith(below) or below.startswith(p) for p in self.prefixes) or self.only is not None and not any(f.startswith(below) for f in self.only):
            return False
        names = folder.split("/")
        return any(self._leads(parts, names) for parts in self.parts)

    @staticmethod
    def _leads(parts: list, names: list[str]) -> bool:
        """Whether folders of these names, one in the other, agree with the beginning of a pattern."""
        for part, name in zip(parts[:-1], names, strict=False):
            if part == "**":
                return True
            if not part.match(name):
                return False
        return len(names) < len(parts) or parts[-1] == "**"


def children(fs: pafs.FileSystem, base: str, folder: str) -> tuple[list[str], list[str]]:
    """Paths below the root of a folder's folders and files."""
    found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base))
    named = sorted((f"{folder}/{x.base_name}" if folder else x.base_name, x.type) for x in found)
    return [n for n, kind in named if kind == pafs.FileType.Directory], [n for n, kind in named if kind == pafs.FileType.File]


def walk(rule: Rule, list_: callable, start: list[str], enough: int | None = None) -> tuple[list[str], list[str]]:
    """(files, folders not listed yet): breadth first from the folders on, until `enough` wait."""
    files, waiting = [], deque(start)
    while waiting and (enough is None or len(waiting) < enough):
        folders, here = list_(waiting.popleft())
        files += [f for f in here if rule.takes(f)]
        waiting += [f for f in folders if rule.enters(f)]
    return files, list(waiting)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"].rstrip("/")
        self.patterns, self.ignore = json.loads(options["patterns"]), json.loads(options["ignore"])
        self.only: list[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("file",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = sorted(values if self.only is None else values & set(self.only))
            elif isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f

    def _open(self):
        fs, base = pafs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root)
        return fs, base, Rule(self.patterns, self.ignore, self.only, self.prefixes)

    def partitions(self):
        fs, base, rule = self._open()
        files, folders = walk(rule, lambda f: children(fs, base, f), [""], SHARED)
        return [InputPartition(("files", files))] * bool(files) + [InputPartition(("folder", [f])) for f in folders] or [InputPartition(("files", []))]

    def read(self, partition):
        fs, base, rule = self._open()
        kind, names = partition.value
        files = names if kind == "files" else walk(rule, lambda f: children(fs, base, f), names)[0]
        for f in files:
            with fs.open_input_file(f"{base}/{f}") as source:
                yield (f, source.read().decode("utf-8", "replace"))


class ProjectFiles(DataSource):
    """Options root, patterns and ignore, the latter two as JSON lists. Rows (file, content) of the files that a pattern matches."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FilesReader(self.options)
