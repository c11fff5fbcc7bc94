"""A design tool's REST export and a component catalogue's manifest, as Python data sources and as parsers of their JSON."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokenloom import model as m
from tokenloom.functions.text import contains_any, number_text, rgba_hex, slug, trim_all
from tokenloom.operators.extract import provenance

TIMEOUT_S = 60


class _Get(DataSourceReader):
    """One partition for each document; each is fetched by the executor that reads it."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def documents(self) -> list[dict]:
        raise NotImplementedError

    def partitions(self):
        return [InputPartition(d) for d in self.documents()]

    def read(self, partition):
        what = partition.value
        yield (what["name"], _first_answer(what["urls"], what.get("headers", {}), what["failure"], what.get("fallback", False)))


def _document(text: str, url: str) -> str:
    """The text, if it is JSON other than null; else an error: a source that answers with something else has failed, it isn't empty."""

    def no(name: str):
        raise ValueError(f"{name} is not JSON")

    try:
        if json.loads(text, parse_constant=no) is not None:
            return text
        reason = "null"
    except ValueError as e:
        reason = str(e)
    raise RuntimeError(f"{url} did not answer with a JSON document: {reason}")


def _first_answer(urls: list[str], headers: dict, failure: str, fallback: bool) -> str:
    """The first good answer's text, a JSON document. Without fallback a bad status is an error with its status, text and body."""
    for url in urls:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as answer:
                text = answer.read().decode("utf-8", "replace")
            return _document(text, url)
        except urllib.error.HTTPError as e:
            if not fallback:
                body = e.read().decode("utf-8", "replace")
                raise RuntimeError(f"{failure} ({e.code}): {e.reason}{f' - {body}' if body else ''}") from None
        except (urllib.error.URLError, OSError):
            if not fallback:
                raise
    raise RuntimeError(failure)


class FigmaRest(DataSource):
    """Options token, fileId and, optionally, baseUrl. Rows (name, body) of the variables and the components."""

    @classmethod
    def name(cls):
        return "figma_rest"

    def schema(self):
        return "name string, body string"

    def reader(self, schema):
        class Reader(_Get):
            def documents(self):
                base = self.options.get("baseurl", self.options.get("baseUrl", m.FigmaSource("", "").baseUrl))
                file_id = self.options.get("fileid", self.options.get("fileId"))
                headers = {"X-Figma-Token": self.options["token"]}
                ends = {"variables": "variables/local", "components": "components"}
                return [{"name": n, "urls": [f"{base}/files/{file_id}/{e}"], "headers": headers, "failure": "design tool answered with an error"} for n, e in ends.items()]

        return Reader(self.options)


class StorybookRest(DataSource):
    """Option url. One row (name, body): the manifest under /index.json or else /stories.json."""

    @classmethod
    def name(cls):
        return "storybook_rest"

    def schema(self):
        return "name string, body string"

    def reader(self, schema):
        class Reader(_Get):
            def documents(self):
                base = self.options["url"].removesuffix("/")
                return [{"name": "manifest", "urls": [base + "/index.json", base + "/stories.json"], "failure": f"no component catalogue at {self.options['url']}", "fallback": True}]

        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FigmaRest)
    spark.dataSource.register(StorybookRest)


# ---- design tool

VARIABLES = "meta struct<variables:map<string,struct<id:string,name:string,resolvedType:string,remote:boolean,variableCollectionId:string,valuesByMode:map<string,variant>>>,variableCollections:map<string,struct<name:string,defaultModeId:string>>>"
COMPONENTS = "meta struct<components:array<struct<name:string,node_id:string,key:string>>>"


def _resolve(kind: Column, raw: Column) -> Column:
    """A variable's value as text: colour objects as hex, numbers as px, texts as they are; null if type and value differ."""
    shape = F.schema_of_variant(raw)
    channel = lambda c: F.try_variant_get(raw, f"$.{c}", "double")
    number = F.try_variant_get(raw, "$", "double")
    return (
        F.when((kind == "COLOR") & shape.startswith("OBJECT"), rgba_hex(channel("r"), channel("g"), channel("b"), channel("a")))
        .when((kind == "FLOAT") & shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.concat(number_text(number), F.lit("px")))
        .when((kind == "STRING") & (shape == "STRING"), F.try_variant_get(raw, "$", "string"))
    )


def categorise_variable(kind: Column, name: Column) -> Column:
    return (
        F.when(kind == "COLOR", "colors")
        .when(kind == "STRING", "typography")
        .when(contains_any(name, m.RADIUS_WORDS), "borderRadius")
        .when(contains_any(name, m.SHADOW_WORDS), "shadows")
        .when(contains_any(name, m.TOOL_TYPOGRAPHY_WORDS), "typography")
        .otherwise("spacing")
    )


def figma_variables(documents: DataFrame) -> DataFrame:
    """(ord, name, category, value, id, collection) of every usable variable of the JSON documents (doc, body).

    Left out: remote ones, those without a default mode or a value in it, aliases, and values that do not resolve or are
    empty. The collection is looked up in the document's own map, so no shuffle is needed.
    """
    meta = documents.select("doc", F.from_json("body", VARIABLES).alias("j")).select("doc", "j.meta.*")
    rows = meta.select("doc", "variableCollections", F.posexplode(F.map_values("variables")).alias("at", "v"))
    found = rows.select("doc", "at", "v", F.col("variableCollections")[F.col("v.variableCollectionId")].alias("collection"))
    mode = F.nullif(F.col("collection.defaultModeId"), F.lit(""))
    raw = found.select("doc", "at", "v", "collection", F.col("v.valuesByMode")[mode].alias("raw")).filter("not coalesce(v.remote, false) and raw is not null and not is_variant_null(raw)")
    alias = F.coalesce(F.try_variant_get("raw", "$.type", "string") == "VARIABLE_ALIAS", F.lit(False))
    name = slug(F.col("v.name"))
    resolved = raw.filter(~alias).select("doc", "at", name.alias("name"), categorise_variable(F.col("v.resolvedType"), name).alias("category"), _resolve(F.col("v.resolvedType"), F.col("raw")).alias("value"), F.col("v.id").alias("id"), F.col("collection.name").alias("collection"))
    return resolved.filter("value <> ''").withColumn("ord", F.struct(F.lit(0).alias("a"), F.col("doc").alias("b"), F.col("at").alias("c"))).drop("doc", "at")


def figma_tokens(documents: DataFrame) -> DataFrame:
    """One token for each (category, name), the last variable's; its place is the first's."""
    best = figma_variables(documents).groupBy("category", "name").agg(F.max_by(F.struct("value", "id", "collection"), F.col("ord")).alias("r"), F.min("ord").alias("ord"))
    return best.select("category", "name", F.col("r.value").alias("value"), provenance("figma", variableId=F.col("r.id"), collectionName=F.col("r.collection")).alias("source"), "ord")


def figma_components(documents: DataFrame) -> DataFrame:
    """One component for each name, the last entry's; entries without a name are left out."""
    rows = documents.select("doc", F.posexplode(F.from_json("body", COMPONENTS)["meta"]["components"]).alias("at", "c")).filter("c.name <> ''")
    rows = rows.select(F.col("c.name").alias("name"), "c", F.struct(F.lit(0).alias("a"), F.col("doc").alias("b"), F.col("at").alias("c")).alias("ord"))
    best = rows.groupBy("name").agg(F.max_by("c", "ord").alias("r"), F.min("ord").alias("ord"))
    return best.select("name", provenance("figma", nodeId=F.col("r.node_id"), componentKey=F.col("r.key")).alias("source"), F.lit(None).cast("array<string>").alias("variants"), F.create_map().cast(m.PROPS).alias("props"), "ord")


# ---- component catalogue

MANIFEST = "entries map<string,struct<id:string,title:string,name:string,importPath:string,type:string>>, stories map<string,struct<id:string,title:string,name:string,importPath:string,type:string>>"


def stories(documents: DataFrame) -> DataFrame:
    """(doc, at, id, title, name, path) of the manifest entries that are stories with a title."""
    j = documents.select("doc", F.from_json("body", MANIFEST).alias("j"))
    rows = j.select("doc", F.posexplode(F.map_values(F.coalesce("j.entries", "j.stories"))).alias("at", "e"))
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    return rows.filter("coalesce(e.type, '') <> 'docs'").select("doc", "at", text("id").alias("id"), text("title").alias("title"), text("name").alias("name"), text("importPath").alias("path")).filter("title <> ''")


def story_groups(documents: DataFrame) -> DataFrame:
    """Stories by title: names and ids in order, empty ones left out, the first path that is not empty, and the name."""
    ord_ = F.struct(F.lit(0).alias("a"), F.col("doc").alias("b"), F.col("at").alias("c"))
    rows = stories(documents).withColumn("ord", ord_)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("ord", F.col(c).alias("x"))))), lambda r: r["x"])
    grouped = rows.groupBy("title").agg(listed("name").alias("variants"), listed("id").alias("storyIds"), F.coalesce(F.min_by(F.when(F.col("path") != "", F.col("path")), F.when(F.col("path") != "", F.col("ord"))), F.lit("")).alias("file"), F.min("ord").alias("ord"))
    last = F.nullif(trim_all(F.element_at(F.split("title", "/"), -1)), F.lit(""))
    return grouped.withColumn("name", F.coalesce(last, F.col("title")))


def storybook_components(documents: DataFrame) -> DataFrame:
    """One component for each last part of a title: of titles that end alike the one met last counts, whole."""
    row = F.struct("file", "storyIds", "title", "variants")
    best = story_groups(documents).groupBy("name").agg(F.max_by(row, F.col("ord")).alias("r"), F.min("ord").alias("ord"))
    return best.select("name", provenance("storybook", F.col("r.file"), storyIds=F.col("r.storyIds"), title=F.col("r.title")).alias("source"), F.col("r.variants").alias("variants"), F.create_map().cast(m.PROPS).alias("props"), "ord")
