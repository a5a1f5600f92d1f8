"""Shell globs on columns: case-sensitive, ``*`` also crosses ``.`` and ``/``."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_REGEX_SPECIAL = "\\.^$+{}()|"


def to_regex(pattern: str) -> str:
    """A Java/RE2 regex that accepts exactly the strings the glob accepts."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            # A "]" right after "[" or "[!" is a member, not the end.
            end = pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))
            if end < 0:
                out.append("\\[")
                continue
            members = pattern[i:end]
            negate = members.startswith("!")
            members = members[1:] if negate else members
            members = members.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
            members = members.replace("^", "\\^").replace("&", "\\&")
            out.append(f"[{'^' if negate else ''}{members}]")
            i = end + 1
        elif ch in _REGEX_SPECIAL or ch == "]":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "^(?s:" + "".join(out) + ")\\z"


def glob(column: Column, pattern: str) -> Column:
    if pattern == "*":
        return column.isNotNull()
    if not any(c in pattern for c in "*?["):
        return column == F.lit(pattern)
    return column.rlike(to_regex(pattern))


def glob_any(column: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [glob(column, p) for p in patterns], F.lit(False))


def glob_all(column: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [glob(column, p) for p in patterns], F.lit(True))


def include_exclude(column: Column, include: Iterable[str], exclude: Iterable[str] = ()) -> Column:
    """Matches any include glob and no exclude glob."""
    return glob_any(column, include) & ~glob_any(column, exclude)


def glob_column(column: Column, pattern: Column) -> Column:
    """The same test where the pattern is a column too (``*``, ``?`` and ``[...]``)."""
    regex = F.regexp_replace(pattern, r"([\\.^$+{}()|])", r"\\$1")
    regex = F.regexp_replace(regex, r"\[!", "[^")
    regex = F.regexp_replace(regex, r"\*", ".*")
    regex = F.regexp_replace(regex, r"\?", ".")
    return F.rlike(column, F.concat(F.lit("^(?s:"), regex, F.lit(")\\z")))
