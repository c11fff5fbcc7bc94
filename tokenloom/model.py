"""Schemas and fixed values of design tokens, components, conflicts, rules and the contract.

Order is data here: which write is first or last decides values, and order decides what is shown as evidence. Spark rows
have none, so every relation carries `ord`, a struct that sorts as the input stood: pattern, file, place in the file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SOURCE = "struct<adapter:string,file:string,line:int,metadata:struct<variableId:string,collectionName:string,nodeId:string,componentKey:string,storyIds:array<string>,title:string>>"
ORD = "struct<a:int,b:string,c:int>"
PROPS = "map<string,struct<type:string,required:boolean>>"

#: (category, name) is the key within a source; `ord` is where the key was first written.
TOKENS = f"category string, name string, value string, source {SOURCE}, ord {ORD}"
COMPONENTS = f"name string, source {SOURCE}, variants array<string>, props {PROPS}, ord {ORD}"
CONFLICTS = f"type string, name string, sources array<struct<source:{SOURCE},value:string>>, resolution string, suggestedFix string, actionable boolean"
RULES = "ord int, id string, category string, rule string, confidence string, evidence array<string>"

# Category names and orders, adapters, versions and limits that results depend on.
CATEGORIES = ["colors", "spacing", "typography", "borderRadius", "shadows"]
ADAPTERS = ["codebase", "figma", "storybook"]
CONTRACT_VERSION = "0.2.0"
STALE_HOURS = 24

# Prefixes and words that decide a style-sheet token's category, tried in this order.
COLOR_VALUE_PREFIXES = ["#", "rgb", "hsl", "oklch", "oklab"]
COLOR_WORDS = ["color", "bg", "background", "foreground", "border", "ring", "primary", "secondary", "muted", "accent", "destructive", "popover", "card", "sidebar", "chart", "breach"]
SPACING_WORDS = ["spacing", "margin", "padding", "gap"]
TYPOGRAPHY_WORDS = ["font", "line-height", "letter", "text-"]
RADIUS_WORDS = ["radius", "rounded"]
SHADOW_WORDS = ["shadow"]

# Words that a design tool's numeric variables are categorised by.
TOOL_TYPOGRAPHY_WORDS = ["font", "line-height", "letter"]

# Words that the inference rules count.
SEMANTIC_WORDS = ["primary", "secondary", "destructive", "warning", "success", "muted", "accent", "background", "foreground"]
DESCRIPTIVE_WORDS = ["red", "blue", "green", "yellow", "gray", "white", "black"]
STATE_WORDS = ["hover", "active", "focus"]
PREFIX_WORDS = ["color", "spacing", "font", "radius", "shadow", "border"]
PREFIX_EVIDENCE_WORDS = ["color", "spacing", "font", "radius"]

# The patterns that define what counts as a token, a component and a prop.
CSS_VARIABLE = r"--([\w-]+):\s*([^;]+);"
TS_COLOR = r"""(\w+):\s*['"]?(#[0-9a-fA-F]{3,8}|rgb[a]?\([^)]+\)|hsl[a]?\([^)]+\)|oklch\([^)]+\))['"]?"""
ALIAS = r"^var\(--[\w-]+\)$"
COMPONENT_EXPORT = r"export\s+(?:default\s+)?(?:function|const)\s+([A-Z][a-zA-Z]+)"
PROPS_BODY = r"(?:interface|type)\s+\w*[Pp]rops\s*(?:=\s*)?\{([^}]+)\}"
PROP = r"(\w+)(\?)?\s*:\s*([^;\n]+)"
PIXELS = r"^(\d+(\.\d+)?)px$"

#: What the patterns' white space means where they come from: more than Java's default.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def java(pattern: str) -> str:
    """A pattern for Spark's regex functions, with white space as in SPACE."""
    return pattern.replace(r"\s", SPACE)


@dataclass
class CodebaseSource:
    root: str
    patterns: list[str]
    ignore: list[str] = field(default_factory=list)


@dataclass
class FigmaSource:
    token: str
    fileId: str
    baseUrl: str = "https://api.figma.com/v1"


@dataclass
class StorybookSource:
    url: str


@dataclass
class Config:
    codebase: CodebaseSource | None = None
    figma: FigmaSource | None = None
    storybook: StorybookSource | None = None
    sourceOfTruth: str = "codebase"
    onConflict: str = "warn"
    outputPath: str = "design.contract.json"
