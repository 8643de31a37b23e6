"""Ignore rules: patterns, sections and rule files, compiled to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.paths import ancestors


@dataclass(frozen=True)
class Pattern:
    """A rule: ``regex`` is matched against a path relative to the rule's directory."""

    glob: str
    anchored: bool
    negated: bool

    @property
    def regex(self) -> str:
        body = "[^/]*".join(re.escape(part) for part in self.glob.split("*"))
        return rf"(?s)^{body}\z" if self.anchored else rf"(?s)^(?:.*/)?{body}\z"


def parse_pattern(line: str) -> Pattern | None:
    """A pattern line: ``!`` negates, a leading ``/`` anchors, a trailing ``/`` is dropped, ``\\#`` and ``\\!`` at its very start escape.

    Comments, blank lines and patterns with ``?`` or ``[`` give None.
    """
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated or line[:2] in ("\\#", "\\!") else line
    line = line.rstrip("/")
    anchored = line.startswith("/")
    line = line[1:] if anchored else line
    line = line.removeprefix("**/") if not anchored else line
    return None if not line or "?" in line or "[" in line else Pattern(line, anchored, negated)


def section_matches(path: Column, lines: list[str]) -> Column:
    """The last matching pattern decides; a negated one un-matches."""
    found = F.lit(False)
    for pattern in filter(None, map(parse_pattern, lines)):
        found = F.when(path.rlike(pattern.regex), F.lit(not pattern.negated)).otherwise(found)
    return found


def rules_match(path: Column, files: dict[str, list[str]]) -> Column:
    """Rule files by directory, each against the path relative to it; one match is enough."""
    found = F.lit(False)
    for directory, lines in files.items():
        if directory:
            relative = F.substr(path, F.lit(len(directory) + 2))
            found = found | (path.startswith(directory + "/") & section_matches(relative, lines))
        else:
            found = found | section_matches(path, lines)
    return found


def is_pruned(path: Column, files: dict[str, list[str]]) -> Column:
    """The path or any of its ancestors is ignored, so that a later ``!`` cannot re-include it."""
    return F.exists(F.concat(ancestors(path, with_root=False), F.array(path)), lambda p: rules_match(p, files))


def rules_in_scope(files: dict[str, list[str]], scope: str) -> dict[str, list[str]]:
    """Rule files in ancestors or descendants of a scope."""
    related = lambda a, b: not a or a == b or b.startswith(a + "/")
    return {d: lines for d, lines in files.items() if related(d, scope) or related(scope, d)}
