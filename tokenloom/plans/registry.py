"""Names of the registered queries, their Spark functions and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import detect
from tokenloom import model as m
from tokenloom.functions.text import key_order, pixels
from tokenloom.operators import extract, infer, reconcile
from tokenloom.operators.extract import provenance
from tokenloom.plans import contract as contracts
from tokenloom.plans import requests, synth
from tokenloom.plans.oracles import ORACLES
from tokenloom.plans.published import Published, find_token
from tokenloom.session import scratch_folder, table
from tokenloom.sources import codebase, rest
from tokenloom.streaming.reload import bursts
from tokenloom.streaming.snapshot import Snapshot
from tokenloom.streaming.watch import latest_valid

FLAGSHIP = "reconcile_tokens"
TRUTH = "figma"
_QUERIES: dict = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return synth.made(spark, d, getattr(synth, kind)("spark"))


def _bar(c: str) -> Column:
    return F.array_join(c, "|")


# ---- extraction


@query
def css_tokens(spark: SparkSession, d: str) -> DataFrame:
    return extract.css_tokens(_files(spark, d, "css_files")).select("file", "name", "value")


@query
def css_token_lines(spark: SparkSession, d: str) -> DataFrame:
    return extract.css_tokens(_files(spark, d, "css_files")).select("file", "name", "line")


@query
def css_alias_skip(spark: SparkSession, d: str) -> DataFrame:
    found = extract.matches(_files(spark, d, "css_files"), m.CSS_VARIABLE)
    return found.groupBy("file").agg(F.count_if(F.col("value").rlike(m.ALIAS)).alias("n_alias"), F.count("*").alias("n_all"))


@query
def ts_color_tokens(spark: SparkSession, d: str) -> DataFrame:
    return extract.ts_color_tokens(_files(spark, d, "ts_files")).select("file", "name", "value", "line")


@query
def categorize_css(spark: SparkSession, d: str) -> DataFrame:
    return extract.css_tokens(_files(spark, d, "css_files")).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query
def px_values(spark: SparkSession, d: str) -> DataFrame:
    found = extract.css_tokens(_files(spark, d, "css_files"))
    return found.select("name", "value", pixels(F.col("value")).alias("px")).filter("px is not null")


@query
def css_last_wins(spark: SparkSession, d: str) -> DataFrame:
    won = extract.codebase_tokens(_files(spark, d, "css_files"))
    return won.select("category", "name", "value", F.col("source.file").alias("file"), F.col("source.line").alias("line"), F.col("ord.b").alias("first_file"))


@query
def ts_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return extract.codebase_tokens(_files(spark, d, "ts_files")).select("category", "name", "value", F.col("source.file").alias("file"), F.col("source.line").alias("line"))


@query
def distinct_radius(spark: SparkSession, d: str) -> DataFrame:
    found = extract.css_tokens(_files(spark, d, "css_files")).filter("category = 'borderRadius'")
    return found.groupBy("file").agg(F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("radius_values"))


@query
def component_names(spark: SparkSession, d: str) -> DataFrame:
    return extract.component_names(_files(spark, d, "tsx_files")).select("file", "name", "line")


@query
def mixed_fold(spark: SparkSession, d: str) -> DataFrame:
    """Style sheets and colour literals that write the same names."""
    won = extract.codebase_tokens(_files(spark, d, "mixed_css").unionByName(_files(spark, d, "mixed_ts")))
    return won.select("category", "name", "value", F.col("source.file").alias("file"), F.col("source.line").alias("line"), F.col("ord.b").alias("first_file"))


@query
def glob_files(spark: SparkSession, d: str) -> DataFrame:
    """Listed files by pattern, a file once for each pattern that it matches."""
    return codebase.select_files(synth.made(spark, d, synth.PATHS), synth.PATTERNS, synth.IGNORED).select("pattern", "file")


@query
def component_last_wins(spark: SparkSession, d: str) -> DataFrame:
    won = extract.codebase_components(_files(spark, d, "tsx_files"))
    return won.select("name", F.col("source.file").alias("file"), F.col("source.line").alias("line"), F.col("ord.b").alias("first_file"))


@query
def component_props(spark: SparkSession, d: str) -> DataFrame:
    found = _files(spark, d, "tsx_files").select("file", F.explode(extract.props(F.col("content"))).alias("prop", "p"))
    return found.select("file", "prop", F.col("p.type").alias("kind"), F.col("p.required").alias("required"))


# ---- design tool and catalogue


@query
def figma_hex(spark: SparkSession, d: str) -> DataFrame:
    return rest.figma_variables(_files(spark, d, "variable_documents")).filter("category = 'colors'").select("id", "value")


@query
def figma_names(spark: SparkSession, d: str) -> DataFrame:
    return rest.figma_variables(_files(spark, d, "variable_documents")).select("id", "name", "category")


@query
def figma_tokens(spark: SparkSession, d: str) -> DataFrame:
    return rest.figma_tokens(_files(spark, d, "variable_documents")).select("category", "name", "value", F.col("source.metadata.variableId").alias("variable_id"), F.col("source.metadata.collectionName").alias("collection"))


@query
def figma_components(spark: SparkSession, d: str) -> DataFrame:
    return rest.figma_components(_files(spark, d, "component_documents")).select("name", F.col("source.metadata.nodeId").alias("node_id"), F.col("source.metadata.componentKey").alias("component_key"))


@query
def story_groups(spark: SparkSession, d: str) -> DataFrame:
    return rest.story_groups(_files(spark, d, "manifest_documents")).select("title", "name", _bar("variants").alias("variants"), _bar("storyIds").alias("story_ids"), "file")


@query
def story_components(spark: SparkSession, d: str) -> DataFrame:
    return rest.storybook_components(_files(spark, d, "manifest_documents")).select("name", F.col("source.metadata.title").alias("title"), F.col("source.file").alias("file"), _bar("variants").alias("variants"))


@query
def manifest_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stories of manifests with the old key, the new one or both; an empty new one hides the old."""
    return rest.stories(_files(spark, d, "keyed_manifests")).groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("title").alias("n_titles"))


# ---- reconciliation


def _place() -> Column:
    return F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.col("first").cast("int").alias("c"))


def _adapters(build) -> Column:
    """A source struct by source_ord, in the order of the adapters."""
    chosen = None
    for k, name in enumerate(m.ADAPTERS):
        chosen = F.when(F.col("source_ord") == k, build(name)) if chosen is None else chosen.when(F.col("source_ord") == k, build(name))
    return chosen


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    made = synth.made(spark, d, synth.SOURCE_TOKENS)
    names = F.element_at(F.array(*map(F.lit, m.ADAPTERS)), F.col("source_ord") + 1)
    return made.select("category", "name", "value", _adapters(provenance).alias("source"), _place().alias("ord"), names.alias("source_name"), "source_ord")


def _components(spark: SparkSession, d: str) -> DataFrame:
    made = synth.made(spark, d, synth.SOURCE_COMPONENTS)
    names = F.element_at(F.array(*map(F.lit, m.ADAPTERS)), F.col("source_ord") + 1)
    source = _adapters(lambda name: provenance(name, F.col("file")))
    return made.select("name", source.alias("source"), F.lit(None).cast("array<string>").alias("variants"), F.create_map().cast(m.PROPS).alias("props"), _place().alias("ord"), names.alias("source_name"), "source_ord")


@query
def reconcile_tokens(spark: SparkSession, d: str) -> DataFrame:
    merged = reconcile.merge_tokens(_tokens(spark, d), TRUTH)
    return merged.select("category", "name", "value", F.col("source_name").alias("source"), "n_sources", F.col("conflict").isNotNull().alias("conflict"))


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    tokens = reconcile.token_conflicts(reconcile.merge_tokens(_tokens(spark, d), TRUTH), TRUTH)
    return tokens.unionByName(reconcile.component_conflicts(_components(spark, d), TRUTH))


def _entry(s: Column) -> Column:
    return F.concat(s["source"]["adapter"], F.lit("="), s["value"])


@query
def token_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = reconcile.token_conflicts(reconcile.merge_tokens(_tokens(spark, d), TRUTH), TRUTH)
    return found.select("name", F.array_join(F.transform("sources", _entry), "|").alias("entries"), "actionable")


@query
def fix_messages(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.token_conflicts(reconcile.merge_tokens(_tokens(spark, d), TRUTH), TRUTH).select("name", F.col("suggestedFix").alias("fix"))


@query
def reconcile_components(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.merge_components(_components(spark, d), TRUTH).select("name", F.col("source.adapter").alias("adapter"), F.col("source.file").alias("file"), "n_sources")


@query
def component_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = reconcile.component_conflicts(_components(spark, d), TRUTH)
    return found.select("name", _entry(F.element_at("sources", 1)).alias("held"), _entry(F.element_at("sources", 2)).alias("new"), "actionable")


# ---- inference


def _project_tokens(spark: SparkSession, d: str) -> DataFrame:
    made = synth.made(spark, d, synth.PROJECT_TOKENS)
    return made.withColumn("at", F.struct(reconcile.category_order(F.col("category"), F.lit(0)).alias("c"), key_order(F.col("name"), F.col("first")).alias("n")))


def _project_components(spark: SparkSession, d: str) -> DataFrame:
    made = synth.made(spark, d, synth.PROJECT_COMPONENTS)
    entry = lambda prop: F.when(F.col(f"has_{prop}"), F.struct(F.lit(prop).alias("key"), F.struct(F.lit("x").alias("type"), F.lit(True).alias("required")).alias("value")))
    props = F.map_from_entries(F.array_compact(F.array(*map(entry, ("variant", "size", "disabled")))))
    return made.select("project", "name", props.alias("props"), F.col("first").alias("at"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return infer.infer_rules(_project_tokens(spark, d), _project_components(spark, d), ("project",))


@query
def rule_spacing(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("category = 'spacing'").select("project", "id", "confidence", "rule", _bar("evidence").alias("evidence"))


@query
def rule_linear(spark: SparkSession, d: str) -> DataFrame:
    """Values and distinct steps between sorted neighbours, and whether the rule is reported."""
    tokens = _project_tokens(spark, d)
    steps = infer.spacing_steps(tokens, ("project",)).groupBy("project").agg(F.count_distinct("step").alias("n_steps"))
    facts = infer.token_facts(tokens, ("project",)).filter("spacing_n > 0")
    counted = facts.join(steps, "project", "left").select("project", F.col("spacing_n").alias("n"), F.coalesce("n_steps", F.lit(0).cast("long")).alias("n_steps"))
    reported = _rules(spark, d).filter("id = 'spacing-linear-scale'").select("project", F.lit(True).alias("reported"))
    return counted.join(reported, "project", "left").select("project", "n", "n_steps", F.coalesce("reported", F.lit(False)).alias("reported"))


@query
def rule_color(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("category = 'color'").select("project", "id", "confidence", _bar("evidence").alias("evidence"))


@query
def rule_radius(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("category = 'border-radius'").select("project", "id", "rule", _bar("evidence").alias("evidence"))


@query
def rule_typography(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("category = 'typography'").select("project", "id", _bar("evidence").alias("evidence"))


@query
def rule_naming(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("id in ('naming-kebab-case', 'naming-camel-case')").select("project", "id", _bar("evidence").alias("evidence"))


@query
def rule_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("id = 'naming-category-prefix'").select("project", "id", _bar("evidence").alias("evidence"))


@query
def rule_components(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter("category = 'components'").select("project", "id", _bar("evidence").alias("evidence"))


@query
def inferred_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).select("project", "id", "category")


@query
def rules_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).filter(F.col("category") == "color").select("project", "id")


# ---- requests


@query
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return requests.category_counts(reconcile.merge_tokens(_tokens(spark, d), TRUTH))


@query
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each relation is merged and counted once; every source of a component after its first is a conflict."""
    tokens = reconcile.merge_tokens(_tokens(spark, d), TRUTH).agg(F.count("*").alias("n_tokens"), F.count("conflict").alias("n_token_conflicts"))
    components = reconcile.merge_components(_components(spark, d), TRUTH).agg(F.count("*").alias("n_components"), F.sum(F.col("n_sources") - 1).alias("n_component_conflicts"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(tokens).join(one(components), "k").select("n_tokens", "n_components", "n_token_conflicts", "n_component_conflicts")


@query
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    tokens = reconcile.merge_tokens(_tokens(spark, d), TRUTH)
    return requests.context_summary(tokens, reconcile.merge_components(_components(spark, d), TRUTH), _conflicts(spark, d))


@query
def context_tokens(spark: SparkSession, d: str) -> DataFrame:
    return requests.bare_tokens(reconcile.merge_tokens(_tokens(spark, d), TRUTH), "colors")


@query
def component_summary(spark: SparkSession, d: str) -> DataFrame:
    found = requests.component_summary(extract.codebase_components(_files(spark, d, "tsx_files")))
    return found.select("name", F.col("source.file").alias("file"), F.col("prop_count").cast("long").alias("prop_count"))


@query
def conflict_projection(spark: SparkSession, d: str) -> DataFrame:
    found = requests.conflict_projection(_conflicts(spark, d))
    return found.select("type", "name", "resolution", "actionable", F.array_join(F.transform("sources", _entry), "|").alias("entries"), (F.length("suggestedFix") > 0).alias("has_fix"))


@query
def contract_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each part of a contract that is built from three sources."""
    parts = _built(spark, d)
    counted = [parts[part].agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part in ("tokens", "components", "conflicts")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def context_detail(spark: SparkSession, d: str) -> DataFrame:
    """All that a request for every part lists: tokens, components and conflicts."""
    tokens = reconcile.merge_tokens(_tokens(spark, d), TRUTH)
    return requests.context_detail(tokens, reconcile.merge_components(_components(spark, d), TRUTH), _conflicts(spark, d))


@query
def context_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same by part: components alone, conflicts alone, and the tokens of one category."""
    given = reconcile.merge_tokens(_tokens(spark, d), TRUTH), reconcile.merge_components(_components(spark, d), TRUTH), _conflicts(spark, d)
    ask = lambda *what: requests.context_detail(*given, *what)
    return ask("components").unionByName(ask("conflicts")).unionByName(ask("tokens", "spacing")).unionByName(ask("unknown"))


def _built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The parts of a contract that is built from three sources."""
    tokens, components = _tokens(spark, d), _components(spark, d)
    of = lambda rows, name: rows.filter(F.col("source_name") == name).drop("source_name", "source_ord")
    return contracts.build([(name, of(tokens, name), of(components, name)) for name in m.ADAPTERS], TRUTH)


@query
def contract_content(spark: SparkSession, d: str) -> DataFrame:
    """What each part of the contract says: tokens with value and source, components with theirs, conflicts with their entries."""
    parts = _built(spark, d)
    tokens = parts["tokens"].select(F.lit("token").alias("part"), F.concat("category", F.lit("."), "name").alias("name"), F.concat(F.col("source.adapter"), F.lit(":"), "value").alias("says"))
    components = parts["components"].select(F.lit("component").alias("part"), "name", F.concat(F.col("source.adapter"), F.lit(":"), F.coalesce("source.file", F.lit("none"))).alias("says"))
    conflicts = parts["conflicts"].select(F.concat("type", F.lit(" conflict")).alias("part"), "name", F.concat(F.array_join(F.transform("sources", _entry), "|"), F.lit(" "), F.col("actionable").cast("string")).alias("says"))
    return tokens.unionByName(components).unionByName(conflicts)


@query
def mismatch_warning(spark: SparkSession, d: str) -> DataFrame:
    """Contracts whose source root is not the folder that they stand in."""
    key = F.col("o_orderkey")
    made = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, F.lit("")).otherwise(F.concat(F.lit("/p/"), F.col("o_custkey") % 4)).alias("source_root"),
        F.concat(F.lit("/p/"), key % 4, F.when(key % 5 == 0, F.lit("/out")).otherwise(F.lit("")), F.lit("/c.json")).alias("path"),
    )
    return requests.mismatch(made).select("o_orderkey", "mismatch")


@query
def detect_projects(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_many(synth.made(spark, d, synth.LISTING))
    return found.withColumns({"patterns": _bar("patterns"), "ignored": _bar("ignore")}).drop("ignore")


@query
def token_lookup(spark: SparkSession, d: str) -> DataFrame:
    return requests.find_token(reconcile.in_order(reconcile.merge_tokens(_tokens(spark, d), TRUTH)), "blue-0").select("category", "name", "value")


@query
def component_lookup(spark: SparkSession, d: str) -> DataFrame:
    return requests.find_component(reconcile_components(spark, d), "BlueBolt0")


@query
def conflict_filter(spark: SparkSession, d: str) -> DataFrame:
    return requests.filter_conflicts(_conflicts(spark, d), "component", "pending").select("type", "name", "actionable")


@query
def conflict_counts(spark: SparkSession, d: str) -> DataFrame:
    return requests.conflict_counts(_conflicts(spark, d))


@query
def staleness(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("generated_at"))
    return requests.staleness(orders, "1998-08-02 00:00:00").select("o_orderkey", "age_hours", "warning")


@query
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each user's document that parses, as the watcher keeps it; every seventh is cut off."""
    return latest_valid(_versions(spark, d).withColumn("parsed", F.try_parse_json("props")), "user_id", "event_id", "props", "parsed")


@query
def published_token(spark: SparkSession, d: str) -> DataFrame:
    """A token by its name, from a published version that is sorted by name."""
    tokens = Published(spark, scratch_folder(spark, "tokens"))
    tokens.publish(reconcile.in_order(reconcile.merge_tokens(_tokens(spark, d), TRUTH)).select("name", "category", "value", "at"))
    return find_token(tokens, "blue-0").select("category", "name", "value")


@query
def published_component(spark: SparkSession, d: str) -> DataFrame:
    components = Published(spark, scratch_folder(spark, "components"))
    components.publish(reconcile_components(spark, d))
    return components.find("BlueBolt0")


@query
def settings_insert(spark: SparkSession, d: str) -> DataFrame:
    """Settings of every project, with what was wanted and wasn't there."""
    return detect.insert_absent(synth.made(spark, d, synth.SETTINGS), synth.made(spark, d, synth.WANTED))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each user's document, every seventh cut off."""
    cut = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return table(spark, d, "events").select("user_id", "event_id", cut.alias("props"))


@query
def last_good_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same kept by a stream: the versions come in batches, newer ones first in some, and each takes the table a step on."""
    folder = scratch_folder(spark, "last-good")
    versions = _versions(spark, d)
    versions.repartition(3, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = Snapshot(spark, f"{folder}/table", versions.schema, 8)
    kept.follow(stream.withColumn("parsed", F.try_parse_json("props")), "parsed", f"{folder}/checkpoint", once=True).awaitTermination()
    return kept.read()


@query
def reload_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Each user's bursts of events, at most four hours apart, and when the reload after each is due."""
    found = bursts(table(spark, d, "events"), "user_id", "ts", "4 hours")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.select("user_id", shown("first_change"), shown("last_change"), "n_changes", shown("reload_at"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
