"""Rules on small token sets (FIXTURES.md, G9)."""

import random

import pytest

from tokenloom.operators import infer

PROPS = "map<string,struct<type:string,required:boolean>>"


def rules(spark, tokens=(), components=()):
    t = spark.createDataFrame([(c, n, v, k) for k, (c, n, v) in enumerate(tokens)], "category string, name string, value string, at int")
    c = spark.createDataFrame([(f"C{k}", {p: ("x", True) for p in props}, k) for k, props in enumerate(components)], f"name string, props {PROPS}, at int")
    return {r.id: r for r in infer.infer_rules(t, c).collect()}


def spacing(*values):
    return [("spacing", f"s{k}", v) for k, v in enumerate(values)]


def named(category, *names):
    return [(category, n, "1") for n in names]


CASES = [
    (spacing("4px", "8px", "12px"), "spacing", {"spacing-4px-base", "spacing-linear-scale"}),
    (spacing("8px", "16px", "32px"), "spacing", {"spacing-4px-base"}),
    (spacing("4px", "4px", "4px"), "spacing", {"spacing-4px-base", "spacing-linear-scale"}),
    (spacing("3px", "5px"), "spacing", set()),
    (spacing("4px"), "spacing", set()),
    (named("colors", "primary", "muted", "red-500"), "color", {"color-semantic-naming"}),
    (named("colors", "primary", "red"), "color", set()),
    (named("colors", "a", "b", "a-hover"), "color", {"color-interactive-variants"}),
    (named("colors", "a-hover"), "color", {"color-interactive-variants"}),
    (named("colors", *"abcdefghij", "a-hover", "b-hover", "c-hover"), "color", set()),
    (named("colors", "a-dark", "b-dark"), "color", set()),
    (named("colors", "a-dark", "b-dark", "c-dark"), "color", {"color-dark-mode-tokens"}),
    ([("borderRadius", "r", "4px")], "border-radius", {"border-radius-uniform"}),
    ([("borderRadius", f"r{v}", v) for v in ("4px", "8px", "1rem")], "border-radius", set()),
    ([("borderRadius", f"r{v}", v) for v in ("4px", "8px", "12px", "1rem")], "border-radius", {"border-radius-scale"}),
    ([("typography", "font-sans", "Inter")], "typography", {"typography-single-typeface"}),
    ([("typography", "font-sans", "Inter"), ("typography", "font-mono", "X")], "typography", {"typography-mono-for-code"}),
    (named("other", *"abc", *(f"x-{k}" for k in range(7))), "naming", set()),
    (named("other", "a", "b", *(f"x-{k}" for k in range(8))), "naming", {"naming-kebab-case"}),
    (named("other", "shadow-a", "border_b", "aB"), "naming", set()),
]


@pytest.mark.parametrize(("tokens", "category", "ids"), CASES)
def test_token_rules(spark, tokens, category, ids):
    got = rules(spark, tokens)
    assert {k for k, r in got.items() if r.category == category} == ids
    assert "spacing-8px-base" not in got


def test_texts_and_evidence(spark):
    got = rules(spark, spacing("12px", "4px", "8px"))
    assert got["spacing-4px-base"].evidence == ["s0: 12px", "s1: 4px", "s2: 8px"]
    assert got["spacing-linear-scale"].evidence == ["4px", "8px", "12px"] and "by 4px" in got["spacing-linear-scale"].rule
    assert "by 0px" in rules(spark, spacing("4px", "4px", "4px"))["spacing-linear-scale"].rule
    prefixed = rules(spark, named("other", "shadow-a", "border-b"))["naming-category-prefix"]
    assert prefixed.evidence == []
    assert "scale of 4" in rules(spark, [("borderRadius", f"r{v}", v) for v in ("4px", "8px", "12px", "1rem")])["border-radius-scale"].rule


def test_component_rules(spark):
    assert rules(spark, components=[["variant"], ["variant"]]) == {}
    assert "components-variant-prop" not in rules(spark, components=[["variant"], ["variant"], [], [], []])
    got = rules(spark, components=[["variant"], ["variant"], ["variant", "size"], ["size"], []])
    assert set(got) == {"components-variant-prop", "components-size-prop"} and got["components-size-prop"].evidence == ["C2", "C3"]


def test_nothing(spark):
    assert rules(spark) == {}


@pytest.mark.parametrize("most", [3, 100])
def test_steps_are_those_of_one_sorted_list(spark, monkeypatch, most):
    monkeypatch.setattr(infer, "RANGE", most)
    rng = random.Random(most)
    projects = {f"p{k}": [rng.choice([0.1, 0.2, 0.3, 4, 8, 12, 3.5, 1000]) * rng.randint(0, 9) for _ in range(n)] for k, n in enumerate([0, 1, 2, 2, 5, 30, 60])}
    rows = [(p, "spacing", f"s{k}", f"{v}px", k) for p, vs in projects.items() for k, v in enumerate(vs)] + [("p0", "colors", "x", "1px", 0)]
    tokens = spark.createDataFrame(rows, "project string, category string, name string, value string, at int")
    got = {}
    for r in infer.spacing_steps(tokens, ("project",)).collect():
        got.setdefault(r.project, []).append(r.step)
    for p, vs in projects.items():
        vs = sorted(vs)
        distinct = sorted(set(vs))
        want = [b - a for a, b in zip(distinct, distinct[1:], strict=False)] + [0.0] * sum(vs.count(v) > 1 for v in distinct)
        assert sorted(got.get(p, [])) == sorted(want), p


def test_evidence_is_gathered_for_rules_that_hold(spark, monkeypatch):
    """Every font is listed by the rule on monospace fonts if it holds; the rule on one typeface lists one."""
    asked = []
    monkeypatch.setattr(infer, "_with_evidence", lambda holding, rows, *a, keep=infer._with_evidence: asked.append(sorted(r.id for r in holding.select("id").collect())) or keep(holding, rows, *a))
    got = rules(spark, [("typography", f"font-{k}", "Inter") for k in range(30)] + [("borderRadius", f"r-{k}", "4px") for k in range(20)])
    assert set(got) == {"border-radius-uniform", "naming-kebab-case"} == set(asked[0]) and asked[1] == []
    assert len(got["border-radius-uniform"].evidence) == 20 and len(got["naming-kebab-case"].evidence) == 4
