"""From sources to one contract: scan, reconcile, infer, assemble, save; and back from its file."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import model as m
from tokenloom.functions.text import key_order
from tokenloom.operators import extract, infer, reconcile
from tokenloom.sources import codebase, document, rest


def now_text(now: datetime | None = None) -> str:
    """UTC to the millisecond, as the document writes it."""
    return (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{(now or datetime.now(UTC)).microsecond // 1000:03d}Z"


def scan(spark: SparkSession, config: m.Config) -> tuple[list[tuple[str, DataFrame, DataFrame]], list[str]]:
    """(name, tokens, components) of each source that could be scanned, and what went wrong with the others.

    Errors of the project's own files end the scan; a remote source that fails is left out and reported.
    """
    found, failed = [], []
    if config.codebase:
        files = codebase.scan_files(spark, config.codebase).cache()
        found.append(("codebase", extract.codebase_tokens(files), extract.codebase_components(files)))
    none = spark.createDataFrame([], m.TOKENS)
    if config.figma or config.storybook:
        rest.register(spark)
    if config.figma:
        try:
            got = spark.read.format("figma_rest").options(token=config.figma.token, fileId=config.figma.fileId, baseUrl=config.figma.baseUrl).load().select(F.col("name").alias("doc"), "body").cache()
            got.count()
            found.append(("figma", rest.figma_tokens(got.filter("doc = 'variables'")), rest.figma_components(got.filter("doc = 'components'"))))
        except PySparkException as e:  # the service's errors reach us as the job's; the build goes on without it
            failed.append(f"figma: {e}")
    if config.storybook:
        try:
            got = spark.read.format("storybook_rest").options(url=config.storybook.url).load().select(F.col("name").alias("doc"), "body").cache()
            got.count()
            found.append(("storybook", none, rest.storybook_components(got)))
        except PySparkException as e:
            failed.append(f"storybook: {e}")
    return found, failed


def build(sources: list[tuple[str, DataFrame, DataFrame]], truth: str) -> dict[str, DataFrame]:
    """tokens, components, conflicts and rules, each with its order."""
    tokens = reconcile.union_sources([(n, t) for n, t, _ in sources])
    components = reconcile.union_sources([(n, c) for n, _, c in sources])
    merged = reconcile.merge_tokens(tokens, truth)
    ordered = reconcile.in_order(merged)
    whole = reconcile.merge_components(components, truth).withColumn("at", key_order(F.col("name"), F.col("first")))
    conflicts = reconcile.token_conflicts(merged, truth).unionByName(reconcile.component_conflicts(components, truth))
    return {"tokens": ordered, "components": whole, "conflicts": conflicts, "rules": infer.infer_rules(ordered, whole)}


def _plain(x):
    """Rows as plain objects, missing fields left out."""
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items() if v is not None}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


def assemble(parts: dict[str, DataFrame], sources: list[str], source_root: str, config_path: str, now: str | None = None) -> dict:
    """The contract as one document. It is a project's design system, so it is small; the relations stay on Spark."""
    now = now or now_text()
    tokens: dict = {c: {} for c in m.CATEGORIES}
    for r in parts["tokens"].orderBy("at").collect():
        tokens.setdefault(r["category"], {})[r["name"]] = {"name": r["name"], "value": r["value"], "source": _plain(r["source"])}
    components = {}
    # a collected map has no order, its entries have
    for r in parts["components"].orderBy("at").withColumn("props", F.map_entries("props")).collect():
        one = {"name": r["name"], "source": _plain(r["source"])}
        components[r["name"]] = one | ({"variants": list(r["variants"])} if r["variants"] is not None else {}) | {"props": {p["key"]: _plain(p["value"]) for p in r["props"] or []}}
    conflicts = [{"type": r["type"], "name": r["name"], "sources": _plain(r["sources"]), "resolution": r["resolution"], "suggestedFix": r["suggestedFix"], "actionable": r["actionable"]} for r in parts["conflicts"].orderBy("ord").collect()]
    rules = [{k: _plain(r[k]) for k in ("id", "category", "rule", "confidence", "evidence")} for r in parts["rules"].orderBy("ord").collect()]
    return {"version": m.CONTRACT_VERSION, "generatedAt": now, "sources": sources, "sourceRoot": source_root, "configPath": config_path, "tokens": tokens, "components": components, "conflicts": conflicts, "inferredRules": {"generatedAt": now, "rules": rules}}


def write(parts: dict[str, DataFrame], sources: list[str], source_root: str, config_path: str, path: str, now: str | None = None) -> None:
    """The same document, byte for byte, written to its file by the executors; nothing of it is collected."""
    head = {"version": m.CONTRACT_VERSION, "generatedAt": now or now_text(), "sources": sources, "sourceRoot": source_root, "configPath": config_path}
    document.write(parts["tokens"].sparkSession, parts, head, os.path.abspath(path) if "://" not in path else path)


def save(contract: dict, path: str) -> None:
    """One JSON file, two spaces deep; it appears whole, so a reader never sees half of it."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(contract, f, indent=2, ensure_ascii=False)
    os.replace(part, path)


def load(path: str, previous: dict | None = None) -> dict | None:
    """The contract in the file; if it is missing or broken, what was there before."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return previous


def source_counts(sources: list[tuple[str, DataFrame, DataFrame]]) -> list[tuple[str, int, int]]:
    """(name, tokens, components) of each scanned source."""
    return [(name, tokens.count(), components.count()) for name, tokens, components in sources]


def report(contract: dict, failed: list[str] = (), counts: list[tuple[str, int, int]] = ()) -> str:
    """What a build found, for a terminal: by source, the conflicts, and in all."""
    lines = [f"{name}: {n} tokens, {k} components" for name, n, k in counts] + [f"failed: {f}" for f in failed]
    for c in contract["conflicts"]:
        lines.append(f"conflict: {c['type']} {c['name']}")
        lines += [f"  {s['source']['adapter']}{' (' + s['source']['file'] + ')' if s['source'].get('file') else ''}: {s['value']}" for s in c["sources"]]
    lines.append(f"{sum(map(len, contract['tokens'].values()))} tokens, {len(contract['components'])} components, {sum(c['resolution'] == 'pending' for c in contract['conflicts'])} pending conflicts")
    return "\n".join(lines)
