"""Winners and conflicts (FIXTURES.md, G7, G8), and their laws on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom import model as m
from tokenloom.operators import reconcile
from tokenloom.operators.extract import provenance


def tokens(spark, values, category="colors", name="x"):
    """values: by source name; None where a source lacks the token."""
    frames = []
    for source, v in values:
        df = spark.createDataFrame([(category, name, v)] if v is not None else [], "category string, name string, value string")
        frames.append((source, df.select("*", provenance(source).alias("source"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c")).alias("ord"))))
    return reconcile.union_sources(frames)


@pytest.mark.parametrize(
    ("a", "b", "truth", "winner", "entries", "actionable"),
    [
        ("A", "A", "figma", ("A", "codebase"), None, None),
        ("A", "B", "codebase", ("A", "codebase"), ["A", "B"], True),
        ("A", "B", "figma", ("B", "figma"), ["A", "B"], True),
        ("A", "B", "manual", ("A", "codebase"), ["A", "B"], False),
        (None, "B", "codebase", ("B", "figma"), None, None),
    ],
)
def test_two_sources(spark, a, b, truth, winner, entries, actionable):
    merged = reconcile.merge_tokens(tokens(spark, [("codebase", a), ("figma", b)]), truth)
    (r,) = merged.collect()
    assert (r.value, r.source.adapter) == winner
    found = reconcile.token_conflicts(merged, truth).collect()
    assert [([s.value for s in c.sources], c.actionable, c.name, c.resolution) for c in found] == ([(entries, actionable, "colors.x", "pending")] if entries else [])


@pytest.mark.parametrize(("values", "entries"), [("ABA", ["A", "B"]), ("ABC", ["A", "B", "C"]), ("AAA", None)])
def test_three_sources_compare_with_the_first(spark, values, entries):
    merged = reconcile.merge_tokens(tokens(spark, list(zip(("codebase", "figma", "c"), values, strict=True))), "manual")
    got = [[s.value for s in c.sources] for c in reconcile.token_conflicts(merged, "manual").collect()]
    assert got == ([entries] if entries else [])


@pytest.mark.parametrize(
    ("truth", "pairs", "winner"),
    [
        ("codebase", [("codebase", "figma"), ("codebase", "storybook")], "codebase"),
        ("figma", [("codebase", "figma"), ("figma", "storybook")], "figma"),
        ("storybook", [("codebase", "figma"), ("codebase", "storybook")], "storybook"),
        ("manual", [("codebase", "figma"), ("codebase", "storybook")], "codebase"),
    ],
)
def test_components(spark, truth, pairs, winner):
    one = spark.createDataFrame([("B",)], "name string")
    row = lambda s: one.select("name", provenance(s, F.lit("b.tsx") if s != "figma" else None).alias("source"), F.lit(None).cast("array<string>").alias("variants"), F.create_map().cast(m.PROPS).alias("props"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c")).alias("ord"))
    all_ = reconcile.union_sources([(s, row(s)) for s in m.ADAPTERS])
    got = reconcile.component_conflicts(all_, truth).orderBy("ord").collect()
    assert [tuple(s.source.adapter for s in c.sources) for c in got] == pairs
    assert [c.actionable for c in got] == [truth in p for p in pairs]
    assert [s.value for s in got[0].sources] == ["b.tsx", "figma"]
    assert reconcile.merge_components(all_, truth).first().source.adapter == winner


def test_laws(spark):
    rng = random.Random(4)
    rows = [(k, c, f"n{n}", rng.choice("AB")) for k in range(3) for c in ("colors", "odd") for n in range(20) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "source_ord int, category string, name string, value string")
    df = df.select("category", "name", "value", provenance("x").alias("source"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.col("source_ord").alias("c")).alias("ord"), F.concat(F.lit("s"), "source_ord").alias("source_name"), "source_ord")
    keys = lambda d: sorted((r.category, r.name, r.value, r.conflict is not None) for r in d.collect())
    merged = reconcile.merge_tokens(df, "none")
    assert keys(merged) == keys(reconcile.merge_tokens(df.orderBy(F.rand(1)).repartition(7), "none"))
    first = {}
    for k, c, n, v in rows:
        first.setdefault((c, n), v)
    assert keys(merged) == sorted((c, n, v, any(x[1:3] == (c, n) and x[3] != v for x in rows)) for (c, n), v in first.items())
    again = merged.select("category", "name", "value", "source", F.col("first.ord").alias("ord"))
    assert reconcile.token_conflicts(reconcile.merge_tokens(reconcile.union_sources([("one", again)]), "none"), "none").count() == 0


def test_order(spark):
    rows = [("odd", "z", 0), ("colors", "b", 1), ("colors", "10", 2), ("colors", "9", 3), ("spacing", "a", 4), ("colors", "012", 5)]
    df = spark.createDataFrame(rows, "category string, name string, first int")
    assert [r.name for r in reconcile.in_order(df).orderBy("at").collect()] == ["9", "10", "b", "012", "a", "z"]
