"""One spelling of a pattern for two engines: ``\\b`` means an ASCII word boundary, as in RE2."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """The pattern for Spark, whose own ``\\b`` counts accented letters as parts of words."""
    return re.sub(r"(\\\\)|\\b", lambda m: m[1] or _BOUNDARY, pattern)


def sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(java(pattern))


def replace_all(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, java(pattern), by)


def replace_all_sql(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {sql(pattern)}, {sql(by)}, 'g')"


def glob(pattern: str) -> str:
    """``**/`` any directories or none, ``**`` anything, ``*`` within a segment, ``?`` one character, ``{a,b}`` either."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def glob_filter(col: Column, patterns: list[str]) -> Column:
    """Any of the globs and none of those that begin with ``!``."""
    wanted = [p for p in patterns if not p.startswith("!")]
    out = F.lit(not wanted)
    for p in wanted:
        out = out | col.rlike(glob(p))
    for p in patterns:
        if p.startswith("!"):
            out = out & ~col.rlike(glob(p[1:]))
    return out
