"""The five requests over a contract document, and the same questions over its relations."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom import model as m


@dataclass
class Answer:
    """A payload, or an error text."""

    payload: dict | None = None
    error: str | None = None


def age_hours(generated_at: str, now: datetime) -> int:
    made = datetime.fromisoformat(generated_at.replace("Z", "+00:00"))
    return int((now - made).total_seconds() // 3600)


class Requests:
    """Answers from the contract it holds; `contract` may be replaced at any time."""

    def __init__(self, contract: dict | None, path: str) -> None:
        self.contract, self.path = contract, path

    def _none(self) -> Answer:
        return Answer(error=f"There is no contract at {self.path}. Build one first.")

    def _again(self) -> str:
        return f"Build again{' with ' + self.contract['configPath'] if self.contract.get('configPath') else ''}."

    def mismatch(self) -> str | None:
        """Where the contract comes from, if that is not the folder that it stands in."""
        root, here = self.contract.get("sourceRoot"), os.path.dirname(os.path.abspath(self.path))
        return f"Mismatch: the contract was built for {root}, not for {here}. {self._again()}" if root and root != here else None

    def warnings(self, now: datetime) -> list[str]:
        """Whether the contract stems from another project, and whether it is a day old or more."""
        c = self.contract
        out = [found] if (found := self.mismatch()) else []
        hours = age_hours(c["generatedAt"], now)
        if hours >= m.STALE_HOURS:
            days = hours // 24
            out.append(f"Stale: the contract is {days} day{'' if days == 1 else 's'} old. {self._again()}")
        return out

    def design_context(self, category: str = "", token_category: str = "", now: datetime | None = None) -> Answer:
        c, now = self.contract, now or datetime.now(UTC)
        if c is None:
            return self._none()
        if (category or "summary") == "summary":
            warnings = self.warnings(now)
            return Answer(
                ({"warnings": warnings} if warnings else {})
                | {
                    "sourceRoot": c["sourceRoot"] if c.get("sourceRoot") is not None else "(unknown: build again)",
                    "generatedAt": c["generatedAt"],
                    "contractAgeHours": age_hours(c["generatedAt"], now),
                    "sources": c["sources"],
                    "tokenCounts": {k: len(v) for k, v in c["tokens"].items()},
                    "componentNames": list(c["components"]),
                    "componentCount": len(c["components"]),
                    "conflictCount": len(c["conflicts"]),
                    "pendingConflicts": _pending(c),
                }
            )
        out: dict = {}
        if category in ("all", "tokens"):
            bare = lambda ts: {k: {x: t[x] for x in ("name", "value", "references") if x in t} for k, t in ts.items()}
            out["tokens"] = {token_category: bare(c["tokens"].get(token_category, {}))} if token_category else {k: bare(v) for k, v in c["tokens"].items()}
        if category in ("all", "components"):
            out["components"] = {k: {"name": x["name"], "source": x["source"], "propCount": len(x.get("props") or {})} for k, x in c["components"].items()}
        if category in ("all", "conflicts"):
            out |= {"conflicts": c["conflicts"], "conflictCount": len(c["conflicts"]), "pendingConflicts": _pending(c)}
        return Answer(out | {"generatedAt": c["generatedAt"], "sources": c["sources"]})

    def token(self, name: str, category: str = "") -> Answer:
        if self.contract is None:
            return self._none()
        tokens = self.contract["tokens"]
        for k in [category] if category else tokens:
            if name in tokens.get(k, {}):
                return Answer(tokens[k][name] | {"category": k})
        return Answer(error=f"There is no token '{name}'. Ask for the design context of category 'tokens' to see all.")

    def component(self, name: str) -> Answer:
        if self.contract is None:
            return self._none()
        components = self.contract["components"]
        if name in components:
            return Answer(components[name])
        return Answer(error=f"There is no component '{name}'. There are: {', '.join(components)}")

    def conflicts(self, type_: str = "", status: str = "") -> Answer:
        if self.contract is None:
            return self._none()
        type_, status = type_ or "all", status or "pending"
        found = [
            x for x in self.contract["conflicts"]
            if type_ in ("all", x["type"]) and (status == "all" or (x.get("resolution") == "pending") == (status == "pending"))
        ]
        shown = [{k: x.get(k) for k in ("type", "name", "resolution")} | {"actionable": x.get("actionable") or False, "suggestedFix": x.get("suggestedFix"), "sources": x["sources"]} for x in found]
        return Answer({"count": len(found), "actionableCount": sum(x.get("actionable") is True for x in found), "pendingDecisionCount": sum(x.get("actionable") is False for x in found), "conflicts": shown})

    def inferred_rules(self, category: str = "") -> Answer:
        if self.contract is None:
            return self._none()
        inferred = self.contract.get("inferredRules")
        if not inferred or not inferred["rules"]:
            return Answer(error="No rules were inferred. Build the contract first.")
        rules = [r for r in inferred["rules"] if not category or r["category"] == category]
        return Answer({"count": len(rules), "generatedAt": inferred["generatedAt"], "rules": rules})


def _pending(contract: dict) -> int:
    return sum(x.get("resolution") == "pending" for x in contract["conflicts"])


# ---- the same questions over relations


def category_counts(tokens: DataFrame) -> DataFrame:
    """Tokens of every category, the five known ones even without a token; the tokens are counted once."""
    known = tokens.sparkSession.createDataFrame([(c, 0) for c in m.CATEGORIES], "category string, n long")
    return known.unionByName(tokens.groupBy("category").agg(F.count("*").alias("n"))).groupBy("category").agg(F.sum("n").alias("n_tokens"))


def bare_tokens(tokens: DataFrame, category: str = "") -> DataFrame:
    """Tokens without their provenance, of one category or of all."""
    found = tokens.filter(F.col("category") == category) if category else tokens
    return found.select("category", "name", "value")


def component_summary(components: DataFrame) -> DataFrame:
    """Name, source and number of props."""
    return components.select("name", "source", F.coalesce(F.size("props"), F.lit(0)).alias("prop_count"))


def conflict_projection(conflicts: DataFrame) -> DataFrame:
    """The six fields that are shown of a conflict; a missing flag counts as false."""
    return conflicts.select("type", "name", "resolution", F.coalesce("actionable", F.lit(False)).alias("actionable"), "suggestedFix", "sources")


def context_summary(tokens: DataFrame, components: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(what, n): tokens of every category, components, conflicts and pending ones; each relation is counted once."""
    counted = conflicts.agg(F.count("*").alias("conflicts"), F.count_if(F.col("resolution") == "pending").alias("pending"))
    return (
        category_counts(tokens).select(F.concat(F.lit("tokens."), "category").alias("what"), F.col("n_tokens").alias("n"))
        .unionByName(components.agg(F.count("*").alias("n")).select(F.lit("components").alias("what"), "n"))
        .unionByName(counted.unpivot([], ["conflicts", "pending"], "what", "n"))
    )


def context_detail(tokens: DataFrame, components: DataFrame, conflicts: DataFrame, category: str = "all", token_category: str = "") -> DataFrame:
    """(part, category, name, shown) of what a request for details lists: a token's value, a component's number of props, a conflict's resolution.

    category: tokens, components, conflicts or all; anything else lists nothing. token_category narrows the tokens.
    """
    parts = {
        "tokens": bare_tokens(tokens, token_category).select("category", "name", F.col("value").alias("shown")),
        "components": component_summary(components).select(F.lit("").alias("category"), "name", F.col("prop_count").cast("string").alias("shown")),
        "conflicts": conflict_projection(conflicts).select(F.col("type").alias("category"), "name", F.col("resolution").alias("shown")),
    }
    wanted = [rows.select(F.lit(part).alias("part"), "*") for part, rows in parts.items() if category in (part, "all")]
    return reduce(DataFrame.unionByName, wanted) if wanted else tokens.limit(0).select(F.lit("").alias("part"), "category", "name", F.col("value").alias("shown"))


def mismatch(contracts: DataFrame) -> DataFrame:
    """Adds `mismatch`: whether `source_root`, unless it is empty or missing, is another folder than that of `path`."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return contracts.withColumn("mismatch", F.coalesce((F.col("source_root") != "") & (F.col("source_root") != folder), F.lit(False)))


def find_token(tokens: DataFrame, name: str, category: str = "") -> DataFrame:
    """The first token of that name in category order, or none; the name's filter reaches the scan."""
    found = tokens.filter(F.col("name") == name)
    return (found.filter(F.col("category") == category) if category else found).orderBy("at").limit(1).drop("at")


def find_component(components: DataFrame, name: str) -> DataFrame:
    return components.filter(F.col("name") == name)


def filter_conflicts(conflicts: DataFrame, type_: str = "", status: str = "") -> DataFrame:
    found = conflicts if (type_ or "all") == "all" else conflicts.filter(F.col("type") == type_)
    status = status or "pending"
    if status == "all":
        return found
    pending = F.coalesce(F.col("resolution") == "pending", F.lit(False))
    return found.filter(pending if status == "pending" else ~pending)


def conflict_counts(conflicts: DataFrame) -> DataFrame:
    """All, pending, actionable and undecided; a missing flag is neither of the last two."""
    return conflicts.agg(F.count("*").alias("n"), F.count_if(F.col("resolution") == "pending").alias("pending"), F.count_if("actionable").alias("actionable"), F.count_if(~F.col("actionable")).alias("undecided"))


def staleness(contracts: DataFrame, now: str) -> DataFrame:
    """Whole hours since `generated_at` (timestamps), and whether and how a warning tells it. now: a timestamp literal."""
    hours = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))) / F.lit(3_600_000_000)).cast("long")
    days = F.floor(F.col("age_hours") / 24).cast("long")
    text = F.concat(days, F.when(days == 1, F.lit(" day")).otherwise(F.lit(" days")))
    return contracts.withColumn("age_hours", hours).withColumn("warning", F.when(F.col("age_hours") >= m.STALE_HOURS, text))
