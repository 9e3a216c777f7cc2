"""Selections of sites by what has been decided about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rx import glob_filter
from ..functions.vocab import VERDICTS


class UnknownToken(ValueError):
    """A word of a selection that nothing can match."""


def select_sites(sites: DataFrame, verdict: str | None = None, file: str | None = None, surface: str | None = None, rule: str | None = None, ecosystem: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of ``sites`` (verdict, file, surface, rule, value, ...) for which all that is given holds.

    ``file``, ``surface`` and ``rule`` are globs; ``ecosystem`` stands for all its rules; ``value`` is looked for whatever
    its case. A verdict that there isn't, and a rule that decided nothing where others did, raise ``UnknownToken``: an
    empty answer would read like a clean one. Null fields match no glob.
    """
    if verdict is not None and verdict not in VERDICTS:
        raise UnknownToken(f"{verdict!r} is not a verdict; one of {', '.join(VERDICTS)}")
    rule = rule if rule is not None else f"{ecosystem}.*" if ecosystem else None
    asked = [(c, g) for c, g in (("file", file), ("surface", surface), ("rule", rule)) if g is not None]
    tests = [F.coalesce(glob_filter(F.col(c), [g]), F.lit(False)) for c, g in asked]
    if verdict is not None:
        tests.append(F.col("verdict") == verdict)
    if value:
        tests.append(F.contains(F.lower("value"), F.lit(value.lower())))
    if rule is not None:
        deciding = sites.filter("rule is not null")
        if deciding.filter(glob_filter(F.col("rule"), [rule])).isEmpty() and not deciding.isEmpty():
            known = [r.rule for r in deciding.select("rule").distinct().orderBy("rule").limit(8).collect()]
            raise UnknownToken(f"no rule matches {rule!r}; some that decided: {', '.join(known)}")
    return sites.filter(reduce(lambda a, b: a & b, tests)) if tests else sites


def duplicate_view(selected: DataFrame, limit: int = 50) -> DataFrame:
    """(dup_key, text, n, sites) of texts that several selected sites share, those of most sites first: a report of ``limit``
    groups. Groups are counted before sites are gathered, so only those of the report are."""
    top = selected.groupBy("dup_key").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "dup_key").limit(limit)
    met = selected.join(F.broadcast(top), "dup_key")  # ``limit`` rows
    return met.groupBy("dup_key", "n").agg(F.min(F.struct("site_key", "value"))["value"].alias("text"), F.array_sort(F.collect_list("site_key")).alias("sites")).select("dup_key", "text", "n", "sites")
