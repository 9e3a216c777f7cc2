"""Plural categories of languages, as data and as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocab import PLURAL_ORDER

# Cardinal categories by base language.
CATEGORIES = {
    "one other": "en de nl sv da tr hi fa fi el hu bg et nb no",
    "one many other": "fr es it pt ca",
    "one few many other": "pl ru lt cs sk uk",
    "one few other": "ro hr sr",
    "other": "ja zh ko vi th id ms",
    "zero one two few many other": "ar cy",
    "one two few many other": "ga",
    "one two few other": "sl",
    "one two other": "he",
    "zero one other": "lv",
}
BY_LANGUAGE = {lang: cats.split() for cats, langs in CATEGORIES.items() for lang in langs.split()}

# What positions of a family are called, by the number of its forms.
POSITIONAL = {1: "other", 2: "one other", 3: "one few other", 4: "one few many other", 5: "one two few many other", 6: "zero one two few many other"}


def base_language(locale: Column) -> Column:
    return F.lower(F.regexp_extract(locale, "^([A-Za-z]+)", 1))


def table(spark: SparkSession) -> DataFrame:
    """lang, required: one row a language."""
    return spark.createDataFrame([*BY_LANGUAGE.items()], "lang string, required array<string>")


def in_order(categories: Column) -> Column:
    """Distinct categories in the order of the standard."""
    return F.filter(F.array(*map(F.lit, PLURAL_ORDER)), lambda c: F.array_contains(categories, c))


def positional(position: Column, forms: Column) -> Column:
    """The category of a form by its place, 0 at first; null for more forms than are named."""
    names = F.array(*(F.array(*map(F.lit, POSITIONAL[n].split())) for n in sorted(POSITIONAL)))
    return F.get(F.get(names, forms - 1), position)
