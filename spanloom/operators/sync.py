"""Catalog synchronisation: a source locale's keys against every other's, and the state that tells stale ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOLES = r"\{\d+\}|\{\{\w+\}\}|%[sd@]|\{\w+\}"


def holes(col):
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit(HOLES), F.lit(0))))


def diff(source: DataFrame, targets: DataFrame, locales: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """key, locale, class for each key of ``source`` (key, value) in each of ``locales`` (locale; a row each), and each
    key of ``targets`` (locale, key, value, cognate) that the source lacks. ``state``: key, locale, src_hash."""
    wanted = source.select("key", F.col("value").alias("src")).join(F.broadcast(locales))  # a copy of the source for each locale is what is asked for
    met = wanted.join(targets, ["locale", "key"], "full_outer")
    if state is not None:
        met = met.join(state, ["locale", "key"], "left")
    changed = F.col("src_hash").isNotNull() & (F.col("src_hash") != F.substring(F.sha2("src", 256), 1, 16)) if state is not None else F.lit(False)
    same = (F.col("src") == F.col("value")) & F.col("src").rlike(r"\p{L}{2,}")
    kind = (
        F.when(F.col("src").isNull(), "orphan")
        .when(F.col("value").isNull(), "missing")
        .when(holes(F.col("src")) != holes(F.col("value")), "arity-mismatch")
        .when(changed, "stale")
        .when(same & F.col("cognate"), "identical-ok")
        .when(same, "untranslated")
        .otherwise("ok")
    )
    return met.select("key", "locale", kind.alias("class"))


def new_state(source: DataFrame, targets: DataFrame) -> DataFrame:
    """What to remember after a run: the hash of the source at translation, by key and locale."""
    return targets.select("locale", "key").join(source.select("key", F.substring(F.sha2("value", 256), 1, 16).alias("src_hash")), "key")
