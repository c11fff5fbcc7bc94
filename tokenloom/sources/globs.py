"""Glob patterns as regular expressions of relative paths."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """A regular expression for a relative path: ** crosses folders, * and ? do not, {a,b} chooses, [..] is a class."""
    out, k = [], 0
    depth = 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 3
            continue
        if pattern.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            out.append("[" + pattern[k + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def ignore_regex(pattern: str) -> str:
    """An ignored path and, for a folder's name, all below it."""
    return glob_regex(pattern)[:-1] + "(?:/.*)?$"
