"""Tokens and components out of source text, as regular expressions over whole files in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom import model as m
from tokenloom.functions.text import contains_any, newlines, starts_with_any, trim_all

MARK = "\u0001"


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """One row per match: pattern and file, number in the file, groups 1 and 2, line of the match's start.

    Every match is marked and the text split there, so a piece begins with its match. The line comes from a running sum
    of the pieces' newlines over each file: linear in the file, where counting from its start for each match is not.
    """
    rx = m.java(pattern)
    marked = F.split(F.regexp_replace(F.replace(F.col("content"), F.lit(MARK), F.lit("")), rx, MARK + "$0"), MARK)
    pieces = files.select("pattern", "file", F.posexplode(marked).alias("number", "piece"))
    before = Window.partitionBy("pattern", "file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    lined = pieces.withColumn("line", (F.lit(1) + F.coalesce(F.sum(newlines(F.col("piece"))).over(before), F.lit(0))).cast("int"))
    head = f"^(?:{rx})"
    return lined.filter("number > 0").select("pattern", "file", "number", F.regexp_extract("piece", head, 1).alias("name"), trim_all(F.regexp_extract("piece", head, 2)).alias("value"), "line")


def extension(file: Column) -> Column:
    return F.regexp_extract(file, r"[^/](\.[^./]*)$", 1)


def categorise_css(name: Column, value: Column) -> Column:
    return (
        F.when(starts_with_any(value, m.COLOR_VALUE_PREFIXES) | contains_any(name, m.COLOR_WORDS), "colors")
        .when(contains_any(name, m.SPACING_WORDS), "spacing")
        .when(contains_any(name, m.TYPOGRAPHY_WORDS), "typography")
        .when(contains_any(name, m.RADIUS_WORDS), "borderRadius")
        .when(contains_any(name, m.SHADOW_WORDS), "shadows")
        .otherwise("other")
    )


def css_tokens(files: DataFrame) -> DataFrame:
    """Every custom property of the style sheets in `files`, aliases of another token left out."""
    found = matches(files.filter(extension(F.col("file")) == ".css"), m.CSS_VARIABLE).filter(~F.col("value").rlike(m.ALIAS))
    return found.withColumn("category", categorise_css(F.col("name"), F.col("value"))).withColumn("kind", F.lit("css"))


def ts_color_tokens(files: DataFrame) -> DataFrame:
    """Every colour literal of a named member in the TypeScript files."""
    found = matches(files.filter(extension(F.col("file")).isin(".ts", ".tsx")), m.TS_COLOR)
    return found.withColumn("category", F.lit("colors")).withColumn("kind", F.lit("ts"))


def place() -> Column:
    return F.struct(F.col("pattern").alias("a"), F.col("file").alias("b"), F.col("number").alias("c"))


def provenance(adapter: str, file: Column | None = None, line: Column | None = None, **metadata: Column) -> Column:
    """A source struct; what is not given is null."""
    known = {"variableId": "string", "collectionName": "string", "nodeId": "string", "componentKey": "string", "storyIds": "array<string>", "title": "string"}
    inner = F.struct(*[(metadata[k] if k in metadata else F.lit(None)).cast(t).alias(k) for k, t in known.items()])
    return F.struct(
        F.lit(adapter).alias("adapter"),
        (F.lit(None) if file is None else file).cast("string").alias("file"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        (inner if metadata else F.lit(None)).cast(m.SOURCE.partition("metadata:")[2][:-1]).alias("metadata"),
    )


def codebase_tokens(files: DataFrame) -> DataFrame:
    """One token for each (category, name): the last style-sheet write if there is any, else the first colour literal.

    A colour literal never displaces what is there, a style sheet always does; so the outcome needs no fold over files.
    The key's place is that of its first write.
    """
    rows = css_tokens(files).unionByName(ts_color_tokens(files)).withColumn("ord", place())
    row = F.struct("value", "file", "line")
    css = F.col("kind") == "css"
    best = rows.groupBy("category", "name").agg(
        F.coalesce(F.max_by(F.when(css, row), F.when(css, F.col("ord"))), F.min_by(row, F.col("ord"))).alias("r"), F.min("ord").alias("ord")
    )
    return best.select("category", "name", F.col("r.value").alias("value"), provenance("codebase", F.col("r.file"), F.col("r.line")).alias("source"), "ord")


def basename(file: Column) -> Column:
    """The file's name without its extension; a leading dot is part of the name."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def component_names(files: DataFrame) -> DataFrame:
    """The component files with the component's name and line: the first export, else a file name that starts upper-case."""
    rx = m.java(m.COMPONENT_EXPORT)
    named = F.nullif(F.regexp_extract("content", rx, 1), F.lit(""))
    line = F.lit(1) + newlines(F.element_at(F.split("content", rx, 2), 1))
    base = basename(F.col("file"))
    first = F.substring(base, 1, 1)
    fallback = F.when((F.length(base) > 0) & (first == F.upper(first)), base)
    found = files.filter(F.endswith("file", F.lit(".tsx")) | F.endswith("file", F.lit(".jsx")))
    return found.withColumn("name", F.coalesce(named, fallback)).withColumn("line", F.when(named.isNotNull(), line).otherwise(1).cast("int")).filter("name is not null")


def props(content: Column) -> Column:
    """The first props declaration's members in order; of members of one name the last counts, at the first's place."""
    body = F.regexp_extract(content, m.java(m.PROPS_BODY), 1)
    rx = m.java(m.PROP)
    names, marks, types = (F.regexp_extract_all(body, F.lit(rx), F.lit(k)) for k in (1, 2, 3))
    last = lambda n: F.size(names) - F.array_position(F.reverse(names), n).cast("int") + 1
    entry = lambda n: F.struct(n, F.struct(trim_all(F.element_at(types, last(n))).alias("type"), (F.element_at(marks, last(n)) == "").alias("required")))
    return F.map_from_entries(F.transform(F.array_distinct(names), entry))


def codebase_components(files: DataFrame) -> DataFrame:
    """One component for each name, the last file's; its place is the first file's."""
    rows = component_names(files).withColumn("number", F.lit(0)).withColumn("ord", place())
    best = rows.groupBy("name").agg(F.max_by(F.struct("file", "line", "content"), F.col("ord")).alias("r"), F.min("ord").alias("ord"))
    return best.select("name", provenance("codebase", F.col("r.file"), F.col("r.line")).alias("source"), F.lit(None).cast("array<string>").alias("variants"), props(F.col("r.content")).alias("props"), "ord")
