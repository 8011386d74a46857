"""Ignore rules in the syntax of gitignore files.

A rule is a glob: ``*`` and ``?`` stay inside a path part, ``**`` spans parts,
``[...]`` is a class.  ``!`` in front re-includes, a slash at the end means
directories only, a slash elsewhere ties the rule to its folder.  The last rule
that matches decides; rules of a deeper folder come after those above.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    include: bool
    directories_only: bool


def _glob(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.+", k + 3
        elif c == "*":
            while k < len(glob) and glob[k] == "*":
                k += 1
            out += "[^/]*"
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return out


def rule(line: str) -> Rule | None:
    """The rule of a line; none for a blank or a comment."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    include = line.startswith("!")
    line = line[include:]
    only = line.endswith("/")
    line = line.rstrip("/") if only else line
    if not line:
        return None
    tied = "/" in line
    line = line.removeprefix("/")
    return Rule(re.compile(("" if tied else "(?:.*/)?") + _glob(line) + r"\Z", re.S), include, only)


def rules(text: str) -> list[Rule]:
    return [r for r in map(rule, text.split("\n")) if r is not None]


def ignored(path: str, directory: bool, sets: list[tuple[str, list[Rule]]]) -> bool:
    """Whether a path (with /, relative to the root) is ignored by (folder, rules), upper folders first."""
    out = False
    for folder, listed in sets:
        inner = path[len(folder) :].lstrip("/") if folder else path
        for r in listed:
            if (directory or not r.directories_only) and r.pattern.match(inner):
                out = not r.include
    return out
