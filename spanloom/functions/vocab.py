"""Closed vocabularies, and the helper for ordered first-match columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
VERDICTS = ("translate", "do-not-translate", "needs-judgment", "locale-marker", "unclassified")
CONFLICTING = ("identifier", "module-specifier", "enum-member", "persisted-value", "api-contract", "interop-format")
PLURAL_ORDER = ("zero", "one", "two", "few", "many", "other")
GATES = {"G1": "census-complete", "G2": "no-residual", "G3": "no-unadjudicated", "G4": "source-language-clear", "G5": "exceptions-valid", "G6": "coherence", "G7": "plurals-claimed", "G8": "semantic"}


def first_match(cases: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    cases = [*cases]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(otherwise)


def assert_vocabulary(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """``df``, failing when it is computed if a value is outside the vocabulary."""
    ok = F.col(column).isNull() | F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: "), F.col(column))).cast("string")))
