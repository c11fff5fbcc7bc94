"""Design conventions inferred from merged tokens and components: threshold aggregates with ordered evidence.

Rules are decided first, from counts: one partial aggregate over the tokens, one over the components, and the steps between
sorted spacing values. Evidence is gathered afterwards, by a semi-join with the rules that hold. Where a rule shows n examples, these
are the n first by the document's order: a ranking that keeps n rows of each kind in every task before it shuffles. Where it shows
all that it speaks of, they are gathered for that rule, as it says they must, and for no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom import model as m
from tokenloom.functions.text import contains_any, number_text, pixels


#: Stands for the project where there is only one.
_ONE = "__project"
#: Examples that any rule shows at most.
_MOST = 5
#: Distinct spacing values of a project that one task sorts, about.
RANGE = 100_000


def _one(rows: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    return (rows, by) if by else (rows.withColumn(_ONE, F.lit(0)), (_ONE,))


def _count(where: Column) -> Column:
    return F.coalesce(F.count_if(where), F.lit(0))


def _kinds() -> dict[str, Column]:
    """What the token rules speak of, as conditions on a token."""
    name, value, category = F.col("name"), F.col("value"), F.col("category")
    lower, px = F.lower(name), pixels(value)
    color = category.isin("color", "colors")
    font = (category == "typography") & name.contains("font") & ~name.contains("size") & ~name.contains("weight")
    prefix = F.element_at(F.split(name, "-"), 1)
    return {
        "spacing": (category == "spacing") & px.isNotNull(), "color": color, "radius": category.isin("border-radius", "borderRadius"), "font": font,
        "mono": font & (name.contains("mono") | F.lower(value).contains("mono")),
        "semantic": color & contains_any(lower, m.SEMANTIC_WORDS), "descriptive": color & contains_any(lower, m.DESCRIPTIVE_WORDS),
        "hover": color & name.contains("hover"), "base": color & ~contains_any(name, m.STATE_WORDS), "dark": color & name.contains("dark"),
        "prefix": prefix.isin(m.PREFIX_WORDS), "prefix_shown": prefix.isin(m.PREFIX_EVIDENCE_WORDS), "any": F.lit(True),
    }


def spacing_steps(tokens: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., step): every difference between neighbours of a project's sorted spacing values.

    Values are told apart first; equal ones are a step of 0. A project's values are cut into ranges of about RANGE of
    them, each is sorted by itself, and the last value of a range is handed on to the next. No task holds a project.
    """
    px = pixels(F.col("value"))
    values = tokens.filter((F.col("category") == "spacing") & px.isNotNull()).groupBy(*by, px.alias("px")).agg(F.count("*").alias("n"))
    known = values.groupBy(*by).agg(F.min("px").alias("lo"), F.max("px").alias("hi"), F.ceil(F.count("*") / F.lit(RANGE)).alias("ranges"))
    place = F.floor((F.col("px") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("ranges"))
    cut = values.join(known, list(by)).select(*by, "px", "n", F.when(F.col("ranges") > 1, F.least(place, F.col("ranges") - 1)).otherwise(0).alias("range"))
    inner = cut.withColumn("before", F.lag("px").over(Window.partitionBy(*by, "range").orderBy("px"))).filter("before is not null")
    ends = cut.groupBy(*by, "range").agg(F.min("px").alias("first"), F.max("px").alias("last"))
    handed = ends.withColumn("before", F.lag("last").over(Window.partitionBy(*by).orderBy("range"))).filter("before is not null")
    same = cut.filter("n > 1").select(*by, F.lit(0.0).alias("step"))
    return inner.select(*by, (F.col("px") - F.col("before")).alias("step")).unionByName(handed.select(*by, (F.col("first") - F.col("before")).alias("step"))).unionByName(same)


def token_facts(tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each project of all counts that the token rules ask for. tokens: category, name, value, at."""
    tokens, by = _one(tokens, by)
    k, name, value, px = _kinds(), F.col("name"), F.col("value"), pixels(F.col("value"))
    counted = tokens.groupBy(*by).agg(
        *[_count(k[c]).alias(f"{c}_n") for c in ("spacing", "color", "semantic", "descriptive", "hover", "base", "dark", "radius", "font", "mono", "prefix")],
        F.coalesce(F.bool_and(F.when(k["spacing"], px % 4 == 0)), F.lit(False)).alias("spacing_by4"),
        F.coalesce(F.bool_and(F.when(k["spacing"], px % 8 == 0)), F.lit(False)).alias("spacing_by8"),
        F.min(F.when(k["radius"], value)).alias("radius_value"), F.max(F.when(k["radius"], value)).alias("radius_last"), _count(k["radius"] & px.isNotNull()).alias("radius_px"),
        F.min(F.when(k["font"], value)).alias("font_value"),
        F.count("*").alias("total"), _count(name.contains("-")).alias("kebab_n"), _count(name.rlike("[a-z][A-Z]")).alias("camel_n"), _count(name.contains("_")).alias("snake_n"),
    )
    steps = spacing_steps(tokens, by).groupBy(*by).agg(F.min("step").alias("least_step"), F.max("step").alias("most_step"))
    return counted.join(steps, list(by), "left")


def component_facts(components: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each project: components, and for three props how many have them. components: name, props, at."""
    components, by = _one(components, by)
    return components.groupBy(*by).agg(F.count("*").alias("n"), *[_count(_has(prop)).alias(f"{prop}_n") for prop in ("variant", "size", "disabled")])


def _has(prop: str) -> Column:
    return F.coalesce(F.map_contains_key("props", prop), F.lit(False))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) == 0, F.lit(None)).otherwise(F.col(part) / F.col(whole))


def _rule(ord_: int, id_: str, category: str, confidence: str, holds: Column, text: Column) -> Column:
    """The rule where it holds, else null."""
    return F.when(holds, F.struct(F.lit(ord_).alias("ord"), F.lit(id_).alias("id"), F.lit(category).alias("category"), text.alias("rule"), F.lit(confidence).alias("confidence")))


def _holding(facts: DataFrame, by: tuple[str, ...], rules: list[Column]) -> DataFrame:
    """A row for each rule that holds."""
    return facts.select(*by, F.inline(F.array_compact(F.array(*rules))))


def _with_evidence(holding: DataFrame, rows: DataFrame, by: tuple[str, ...], first: dict[str, tuple[Column, int]], whole: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """The rules that hold, with evidence from the rows: for some the names of the first rows of a kind, for others all of a kind.

    first: id to (condition, how many); whole: id to (condition, what is shown, what it is ordered by before `at`).
    """

    def of(kinds: list[Column]) -> DataFrame:
        each = rows.select(*by, "at", "name", F.inline(F.array_compact(F.array(*kinds))))
        return each.join(holding.select(*by, "id"), [*by, "id"], "left_semi")

    kind = lambda id_, holds, shown, order: F.when(holds, F.struct(F.lit(id_).alias("id"), shown.alias("shown"), order.cast("double").alias("order")))
    none = F.lit(None)
    place = F.row_number().over(Window.partitionBy(*by, "id").orderBy("at", "name"))
    most = F.create_map(*[x for id_, (_, n) in first.items() for x in (F.lit(id_), F.lit(n))])
    some = of([kind(id_, holds, F.col("name"), none) for id_, (holds, _) in first.items()]).withColumn("place", place).filter(F.col("place") <= _MOST).filter(F.col("place") <= most[F.col("id")])
    columns = [*by, "id", "order", "at", "name", "shown"]
    found = some.select(*columns)
    if whole:
        found = found.unionByName(of([kind(id_, holds, shown, order) for id_, (holds, shown, order) in whole.items()]).select(*columns))
    listed = F.array_sort(F.collect_list(F.struct("order", "at", "name", "shown")))
    gathered = found.groupBy(*by, "id").agg(F.transform(listed, lambda r: r["shown"]).alias("evidence"))
    empty = F.array().cast("array<string>")
    return holding.join(gathered, [*by, "id"], "left").withColumn("evidence", F.coalesce("evidence", empty))


def infer_rules(tokens: DataFrame, components: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rules that hold, in the order in which they are reported; with `by`, for many projects at once."""
    given = by
    tokens, by = _one(tokens, given)
    components, _ = _one(components, given)
    col, lit = F.col, F.lit
    even = col("least_step") == col("most_step")
    kebab = (col("kebab_n") == F.greatest("kebab_n", "camel_n", "snake_n")) & (_share("kebab_n", "total") > 0.7)
    camel = ~F.coalesce(kebab, lit(False)) & (col("camel_n") == F.greatest("kebab_n", "camel_n", "snake_n")) & (_share("camel_n", "total") > 0.7)
    hover = (col("hover_n") > 0) & F.when(col("base_n") == 0, lit(True)).otherwise(_share("hover_n", "base_n") > 0.3)
    of_tokens = [
        _rule(1, "spacing-4px-base", "spacing", "high", (col("spacing_n") >= 2) & col("spacing_by4"), lit("All spacing values are multiples of 4px.")),
        # never holds: multiples of 8 are multiples of 4
        _rule(2, "spacing-8px-base", "spacing", "high", (col("spacing_n") >= 2) & ~col("spacing_by4") & col("spacing_by8"), lit("All spacing values are multiples of 8px.")),
        _rule(3, "spacing-linear-scale", "spacing", "medium", (col("spacing_n") >= 3) & even, F.concat(lit("Spacing grows evenly, by "), number_text(col("least_step")), lit("px a step."))),
        _rule(4, "color-semantic-naming", "color", "high", col("semantic_n") > col("descriptive_n"), lit("Colors are named for their role, not for how they look.")),
        _rule(5, "color-interactive-variants", "color", "high", hover, lit("Interactive colors have tokens for their hover, active and focus states.")),
        _rule(6, "color-dark-mode-tokens", "color", "medium", col("dark_n") > 2, lit("Dark mode has color tokens of its own.")),
        _rule(7, "border-radius-uniform", "border-radius", "high", (col("radius_n") > 0) & (col("radius_value") == col("radius_last")), F.concat(lit("There is one border radius: "), col("radius_value"), lit("."))),
        _rule(8, "border-radius-scale", "border-radius", "medium", (col("radius_value") < col("radius_last")) & (col("radius_px") >= 3), F.concat(lit("Border radius has a scale of "), col("radius_n"), lit(" steps."))),
        _rule(9, "typography-mono-for-code", "typography", "high", col("mono_n") > 0, lit("Code and data have a monospace font token.")),
        _rule(10, "typography-single-typeface", "typography", "high", col("font_n") == 1, F.concat(lit("There is one typeface: "), col("font_value"), lit("."))),
        _rule(11, "naming-kebab-case", "naming", "high", kebab, lit("Token names are in kebab case.")),
        _rule(12, "naming-camel-case", "naming", "high", camel, lit("Token names are in camel case.")),
        _rule(13, "naming-category-prefix", "naming", "high", _share("prefix_n", "total") > 0.6, lit("Token names begin with their category.")),
    ]
    props = (("variant", 0.4, "high", "Components vary by a variant prop."), ("size", 0.3, "medium", "Components are sized by a size prop."), ("disabled", 0.5, "high", "Interactive components take a disabled prop."))
    of_components = [_rule(14 + k, f"components-{prop}-prop", "components", confidence, (col("n") >= 3) & (_share(f"{prop}_n", "n") > least), lit(text)) for k, (prop, least, confidence, text) in enumerate(props)]

    k, px = _kinds(), pixels(col("value"))
    both, none = F.concat(col("name"), lit(": "), col("value")), lit(None)
    first = {"color-semantic-naming": (k["semantic"], 5), "color-interactive-variants": (k["hover"], 3), "color-dark-mode-tokens": (k["dark"], 3), "naming-kebab-case": (k["any"], 4), "naming-camel-case": (k["any"], 4), "naming-category-prefix": (k["prefix_shown"], 4)}
    whole = {
        "spacing-4px-base": (k["spacing"], both, none), "spacing-8px-base": (k["spacing"], both, none), "spacing-linear-scale": (k["spacing"], F.concat(number_text(px), lit("px")), px),
        "border-radius-uniform": (k["radius"], both, none), "border-radius-scale": (k["radius"], both, none), "typography-mono-for-code": (k["mono"], both, none), "typography-single-typeface": (k["font"], both, none),
    }
    rules = _with_evidence(_holding(token_facts(tokens, by), by, of_tokens), tokens, by, first, whole)
    of = {f"components-{prop}-prop": (_has(prop), 4) for prop, *_ in props}
    rules = rules.unionByName(_with_evidence(_holding(component_facts(components, by), by, of_components), components, by, of, {}))
    return rules.select(*given, "ord", "id", "category", "rule", "confidence", "evidence")
