"""Looking at a project to propose its configuration, and setting up what goes with it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.config import FILE

# What is looked for, and what a new configuration ignores.
FRAMEWORKS = ["next", "vite", "react"]
#: What tells a feature: a file, a folder (with a slash behind it) or a package that the project depends on.
SIGNS = {
    "typescript": (["tsconfig.json"], "typescript"),
    "tailwind": (["tailwind.config.js", "tailwind.config.ts"], "tailwindcss"),
    "token_file": (["tokens.json", "design-tokens.json", "src/tokens.json", "src/design-tokens.json"], None),
    "storybook": ([".storybook/"], "storybook"),
    "has_src": (["src/"], None),
}
IGNORE = ["node_modules", "dist", ".next", "out", "build", "coverage", "**/*.test.*", "**/*.spec.*", "**/*.stories.*"]

SERVER_FILES = [".mcp.json", ".cursor/mcp.json"]
GUIDE_FILES = ["AGENTS.md", "CLAUDE.md"]
MARK = "<!-- tokenloom -->"
GUIDE = f"""
{MARK}
## Design system

Before changing any user interface, ask for the design context. Its source root must be this project, and it must carry
no warnings. Then look up tokens, components, conflicts and inferred rules instead of writing values by hand.
<!-- /tokenloom -->
"""
SKILL_FILE = ".claude/commands/build-component.md"
SKILL = """# Build a component

1. Load the whole design context; without a contract stop and build one.
2. Settle conflicts that have a suggested fix first; point out those that need a decision.
3. Agree on name, props, states and variants.
4. Use tokens and existing components only, with all interactive states.
5. Check names and props against the contract and build it again.
"""


@dataclass
class Project:
    framework: str
    typescript: bool
    tailwind: bool
    token_file: bool
    storybook: bool
    src_root: str
    patterns: list[str]
    ignore: list[str]


def read_json(path: str) -> dict | None:
    """None on any failure."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


TYPED, UNTYPED = ["css", "ts", "tsx"], ["css", "js", "jsx"]


def _project(framework: str, typescript: bool, tailwind: bool, token_file: bool, storybook: bool, has_src: bool) -> Project:
    endings = TYPED if typescript else UNTYPED
    return Project(framework, typescript, tailwind, token_file, storybook, "./src" if has_src else ".", [f"**/*.{e}" for e in endings], list(IGNORE))


def detect(root: str) -> Project:
    """What SIGNS and FRAMEWORKS say of the project in a folder."""
    package = read_json(os.path.join(root, "package.json")) or {}
    # the development ones take the others' place, also with an empty version, which then counts as none
    merged = (package.get("dependencies") or {}) | (package.get("devDependencies") or {})
    packages = {name for name, version in merged.items() if version}
    seen = {sign: wanted in packages or any(os.path.exists(os.path.join(root, n)) for n in names) for sign, (names, wanted) in SIGNS.items()}
    return _project(next((f for f in FRAMEWORKS if f in packages), "unknown"), **seen)


def detect_many(listings: DataFrame) -> DataFrame:
    """The same for many projects at once: (project, path, content) listings, one row per project, in one aggregate; patterns and ignored names too."""
    path = F.col("path")
    signs = [
        F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [path.startswith(n) if n.endswith("/") else path == n for n in names])), F.lit(False)).alias(sign)
        for sign, (names, _) in SIGNS.items()
    ]
    found = listings.groupBy("project").agg(F.max(F.when(path == "package.json", F.col("content"))).alias("package"), *signs)
    parsed = F.from_json("package", "dependencies map<string,string>, devDependencies map<string,string>")
    given = lambda part: F.coalesce(parsed[part], F.create_map().cast("map<string,string>"))
    kept = F.map_filter(given("dependencies"), lambda k, _: ~F.map_contains_key(given("devDependencies"), k))
    found = found.withColumn("packages", F.map_keys(F.map_filter(F.map_concat(kept, given("devDependencies")), lambda _, v: v != "")))
    has = lambda name: F.array_contains("packages", name)
    framework = F.coalesce(*[F.when(has(name), F.lit(name)) for name in FRAMEWORKS], F.lit("unknown"))
    flags = [(F.col(sign) | has(wanted) if wanted else F.col(sign)).alias(sign) for sign, (_, wanted) in SIGNS.items() if sign != "has_src"]
    patterns = lambda endings: F.array(*[F.lit(f"**/*.{e}") for e in endings])
    lists = [F.when(F.col("typescript_seen"), patterns(TYPED)).otherwise(patterns(UNTYPED)).alias("patterns"), F.array(*map(F.lit, IGNORE)).alias("ignore")]
    found = found.withColumn("typescript_seen", F.col("typescript") | (has(SIGNS["typescript"][1]) if SIGNS["typescript"][1] else F.lit(False)))
    return found.select("project", framework.alias("framework"), *flags, F.when(F.col("has_src"), "./src").otherwise(".").alias("src_root"), *lists)


def insert_absent(settings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, name, value, added): every setting as it was, and each wanted one that its project has no setting of that name for.

    A setting without a value is one all the same. Of several wanted values of one name the smallest is taken.
    """
    keys = ["project", "name"]
    one = wanted.groupBy(*keys).agg(F.min("value").alias("value"))
    missing = one.join(settings.select(*keys), keys, "left_anti")
    return settings.select(*keys, "value", F.lit(False).alias("added")).unionByName(missing.select(*keys, "value", F.lit(True).alias("added")))


def config_for(project: Project) -> dict:
    """A configuration; the remote sources stand there switched off, to be filled in. ${NAME} is read from the environment."""
    found = [name for name, on in ((project.framework, project.framework != "unknown"), ("Tailwind", project.tailwind), ("TypeScript", project.typescript), ("token file", project.token_file), ("Storybook", project.storybook)) if on]
    return {
        "detected": found,
        "sources": {
            "codebase": {"root": project.src_root, "patterns": project.patterns, "ignore": project.ignore},
            "figma": {"enabled": False, "token": "${FIGMA_ACCESS_TOKEN}", "fileId": "your-file-id"},
            "storybook": {"enabled": False, "url": "http://localhost:6006"},
        },
        "governance": {"sourceOfTruth": "figma" if project.token_file else "codebase", "onConflict": "warn"},
        "output": {"path": "./design.contract.json"},
    }


def _first(root: str, names: list[str]) -> str:
    return next((p for n in names if os.path.exists(p := os.path.join(root, n))), os.path.join(root, names[0]))


def add_server(root: str) -> bool:
    """Add this server to the first existing settings file unless it is there; everything else stays."""
    path = _first(root, SERVER_FILES)
    given = (read_json(path) or {}) if os.path.exists(path) else {}
    servers = given.get("mcpServers") or {}
    if "tokenloom" in servers:
        return False
    servers["tokenloom"] = {"command": "python", "args": ["-m", "tokenloom.cli", "serve", f"./{FILE}"]}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(given | {"mcpServers": servers}, indent=2) + "\n")
    return True


def add_guide(root: str) -> bool:
    """Append the guide to the first existing instructions file unless its mark is there."""
    path = _first(root, GUIDE_FILES)
    have = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
    if MARK in have:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(have + GUIDE)
    return True


def add_skill(root: str) -> bool:
    path = os.path.join(root, SKILL_FILE)
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(SKILL)
    return True


def init(root: str) -> Project:
    """Write a configuration and what goes with it; an existing configuration is an error."""
    path = os.path.join(root, FILE)
    if os.path.exists(path):
        raise FileExistsError(f"{path} exists. Remove it to start anew.")
    project = detect(root)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(config_for(project), indent=2) + "\n")
    add_guide(root)
    add_server(root)
    add_skill(root)
    return project
