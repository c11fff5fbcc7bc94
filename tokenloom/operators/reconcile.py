"""Merging the sources' tokens and components into one relation each, with every conflict and what to do about it.

Inputs are unions of the sources' relations with `source_name` and `source_ord` (0 for the first source); within a source
a key stands once. Each merge is one shuffle on the key: a group holds one row per source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom import model as m
from tokenloom.functions.text import key_order


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Named sources in order, one below the other."""
    tagged = [df.withColumn("source_name", F.lit(name)).withColumn("source_ord", F.lit(k)) for k, (name, df) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def fix_message(kind: str, name: Column, sources: Column, truth: str) -> tuple[Column, Column]:
    """(text, actionable): with the source of truth among the conflicting ones, who has to follow; else what to configure."""
    is_truth = lambda s: s["source"]["adapter"] == truth
    winner = F.get(F.filter(sources, is_truth), F.lit(0))
    losers = F.array_join(F.transform(F.filter(sources, lambda s: ~is_truth(s)), lambda s: _quoted(s["source"]["adapter"])), ", ")
    listed = F.array_join(F.transform(sources, lambda s: F.concat(s["source"]["adapter"], F.lit(": "), _quoted(s["value"]))), ", ")
    actionable = F.size(F.filter(sources, is_truth)) > 0
    if kind == "token":
        clear = F.concat(F.lit("Sources disagree on token "), _quoted(name), F.lit(f". The source of truth is '{truth}' with value "), _quoted(winner["value"]), F.lit(". Change "), losers, F.lit(" to it, or name another source of truth in the configuration."))
        open_ = F.concat(F.lit("Sources disagree on token "), _quoted(name), F.lit(" ("), listed, F.lit("). None of them is the source of truth: name one in the configuration."))
    else:
        clear = F.concat(F.lit("Several sources define component "), _quoted(name), F.lit(f". The source of truth is '{truth}' at "), _quoted(winner["value"]), F.lit(". Remove it from "), losers, F.lit(", or name another source of truth in the configuration."))
        open_ = F.concat(F.lit("Several sources define component "), _quoted(name), F.lit(" ("), listed, F.lit("): name a source of truth in the configuration."))
    return F.when(actionable, clear).otherwise(open_), actionable


def merge_tokens(tokens: DataFrame, truth: str) -> DataFrame:
    """One row per (category, name): winner, whether later sources differ, and the conflicting entries.

    The first source's value is the measure. The winner is the source of truth's row if its value differs from it, else
    the first row. The entries are the first row and all later ones that differ from it.
    """
    row = F.struct("source_ord", "source_name", "value", "source", "ord")
    rows = tokens.groupBy("category", "name").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.element_at("rows", 1)
    differing = F.filter("rows", lambda r: r["value"] != first["value"])
    ours = F.get(F.filter(differing, lambda r: r["source_name"] == truth), F.lit(0))
    winner = F.coalesce(ours, first)
    entry = lambda r: F.struct(r["source"].alias("source"), r["value"].alias("value"))
    return rows.select(
        "category", "name",
        winner["value"].alias("value"), winner["source"].alias("source"), winner["source_name"].alias("source_name"),
        F.struct(first["source_ord"].alias("source_ord"), first["ord"].alias("ord")).alias("first"),
        F.size("rows").alias("n_sources"),
        F.when(F.size(differing) > 0, F.transform(F.concat(F.array(first), differing), entry)).alias("conflict"),
        F.get(differing, F.lit(0))["source_ord"].alias("seen_ord"),
        F.get(differing, F.lit(0))["ord"].alias("seen_at"),
    )


def token_conflicts(merged: DataFrame, truth: str) -> DataFrame:
    """A conflict row for each merged token on which sources differ, ordered by where the first difference was met."""
    name = F.concat_ws(".", "category", "name")
    text, actionable = fix_message("token", name, F.col("conflict"), truth)
    return merged.filter("conflict is not null").select(
        F.struct(F.lit(0).alias("kind"), F.col("seen_ord").alias("source_ord"), F.col("seen_at").alias("ord")).alias("ord"),
        F.lit("token").alias("type"), name.alias("name"), F.col("conflict").alias("sources"), F.lit("pending").alias("resolution"), text.alias("suggestedFix"), actionable.alias("actionable"),
    )


def location(source: Column) -> Column:
    """What a component's conflict shows of a source: its file, or the adapter where that is missing or empty."""
    return F.coalesce(F.nullif(source["file"], F.lit("")), source["adapter"])


def merge_components(components: DataFrame, truth: str) -> DataFrame:
    """One row per name: the source of truth's component if it has one, else the first source's, whole."""
    row = F.struct("source_ord", "source", "variants", "props", "ord")
    rows = components.groupBy("name").agg(
        F.min_by(row, F.col("source_ord")).alias("first"), F.max_by(row, F.when(F.col("source_name") == truth, F.col("source_ord"))).alias("ours"), F.count("*").alias("n_sources")
    )
    winner = F.coalesce("ours", "first")
    return rows.select("name", winner["source"].alias("source"), winner["variants"].alias("variants"), winner["props"].alias("props"), F.struct(F.col("first.source_ord").alias("source_ord"), F.col("first.ord").alias("ord")).alias("first"), "n_sources")


def component_conflicts(components: DataFrame, truth: str) -> DataFrame:
    """A row for each later source of a name, against what held before it: the source of truth if seen, else the first."""
    entry = F.struct(F.col("source").alias("source"), location(F.col("source")).alias("value"))
    before = Window.partitionBy("name").orderBy("source_ord").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("source_name") == truth, entry), True).over(before), F.first(entry).over(before))
    met = components.select("name", "source_name", "source_ord", "ord", entry.alias("new"), held.alias("held")).filter("held is not null and held.source.adapter <> new.source.adapter")
    both = met.withColumn("sources", F.array("held", "new"))
    text, actionable = fix_message("component", F.col("name"), F.col("sources"), truth)
    return both.select(
        F.struct(F.lit(1).alias("kind"), F.col("source_ord"), F.col("ord")).alias("ord"),
        F.lit("component").alias("type"), "name", "sources", F.lit("pending").alias("resolution"), text.alias("suggestedFix"), actionable.alias("actionable"),
    )


def category_order(category: Column, first: Column) -> Column:
    """The five known categories first, then others as they were first met."""
    known = F.lit(len(m.CATEGORIES))
    for k, name in reversed(list(enumerate(m.CATEGORIES))):
        known = F.when(category == name, k).otherwise(known)
    return F.struct(known.alias("known"), F.when(known == len(m.CATEGORIES), first).alias("first"))


def in_order(merged: DataFrame) -> DataFrame:
    """Merged tokens with `at`, a sort key in the order of the document: category, then member order."""
    # one row a category: its measured size lets the join be a broadcast at run time, and nothing here forces it
    new = merged.groupBy("category").agg(F.min("first").alias("category_first"))
    return merged.join(new, "category").withColumn("at", F.struct(category_order(F.col("category"), F.col("category_first")).alias("c"), key_order(F.col("name"), F.col("first")).alias("n"))).drop("category_first")
