"""The project's configuration file: JSON, with paths taken from the file's own folder."""

from __future__ import annotations

import json
import os
import re

from tokenloom.model import CodebaseSource, Config, FigmaSource, StorybookSource

FILE = "tokenloom.config.json"


def _filled(value):
    """${NAME} in any text is the environment's value, which must be there."""
    if isinstance(value, dict):
        return {k: _filled(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], value) if isinstance(value, str) else value


def _switched_on(sources: dict) -> dict:
    """The sources that are not switched off, with their values from the environment."""
    return {name: {k: v for k, v in _filled(given).items() if k != "enabled"} for name, given in sources.items() if given and given.get("enabled", True)}


def load_config(path: str | None = None) -> Config:
    """A missing file, or a missing value in the environment, is an error; the output and the source root become absolute."""
    path = os.path.abspath(path or FILE)
    if not os.path.exists(path):
        raise FileNotFoundError(f"No configuration at {path}. Run init to make one.")
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    here = os.path.dirname(path)
    sources, governance = _switched_on(given.get("sources", {})), given.get("governance", {})
    code = sources.get("codebase")
    return Config(
        codebase=CodebaseSource(os.path.normpath(os.path.join(here, code["root"])), code["patterns"], code.get("ignore", [])) if code else None,
        figma=FigmaSource(**sources["figma"]) if sources.get("figma") else None,
        storybook=StorybookSource(**sources["storybook"]) if sources.get("storybook") else None,
        sourceOfTruth=governance.get("sourceOfTruth", "codebase"),
        onConflict=governance.get("onConflict", "warn"),
        outputPath=os.path.normpath(os.path.join(here, given.get("output", {}).get("path", "design.contract.json"))),
    )
