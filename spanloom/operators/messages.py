"""Plural arms of messages: ICU and Fluent values to arms, to families, and back to a message with a locale's categories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cldr, messages

ARMS = "argument long, parent long, depth long, start long, end long, name string, type string, offset long, selector string, default boolean, category string, body_start long, body_end long, body string"
SCANNERS = {"icu": (messages.looks_icu, messages.scan_icu), "fluent": (messages.looks_fluent, messages.scan_fluent)}


def arms(sites: DataFrame, grammar: str) -> DataFrame:
    """(site_key, and ``ARMS``) of every arm in the values of ``sites`` (site_key, value), offsets in characters.

    Defined cases: a null value, one without a selector, and one whose braces don't match have no arms; repeated rows are
    read alike; other columns are ignored; an empty table gives no rows.
    """
    looks, scan = SCANNERS[grammar]
    names = ["site_key", *(x.split()[0] for x in ARMS.split(", "))]
    types = [pa.string(), *({"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in ARMS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = scan(value) if value and looks(value) else None
                for a in found.arms if found and found.ok else ():
                    rows.append((key, a.argument, a.parent, a.depth, a.start, a.end, a.name, a.type, a.offset, a.selector, a.default, a.category, a.body_start, a.body_end, value[a.body_start : a.body_end]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return sites.select(F.col("site_key").cast("string"), F.col("value").cast("string")).mapInArrow(run, f"site_key string, {ARMS}")


def families(found: DataFrame) -> DataFrame:
    """(site_key, argument, name, categories in order, n arms) of arguments with an arm that is a plural category."""
    by = found.groupBy("site_key", "argument", "name").agg(F.collect_set("category").alias("c"), F.count("*").alias("n"))
    return by.filter(F.size("c") > 0).select("site_key", "argument", "name", cldr.in_order(F.col("c")).alias("categories"), "n")


def for_locale(sites: DataFrame, required: DataFrame) -> DataFrame:
    """(site_key, value, written): ICU messages of ``sites`` (site_key, locale, value) with the categories that their locale
    requires (lang, required: one row a language) in every outermost plural argument. A category that the message lacks
    takes the text of ``other``; one that the locale doesn't use goes; exact numbers stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                scan = messages.scan_icu(value) if value and wanted and messages.looks_icu(value) else None
                done = value
                for arg in reversed(sorted({a.argument for a in scan.arms if a.depth == 0 and a.type == "plural"}) if scan and scan.ok else []):
                    own = [a for a in scan.arms if a.argument == arg]
                    text = {a.selector: value[a.body_start : a.body_end] for a in own}
                    if "other" in text:
                        bodies = {s: b for s, b in text.items() if s.startswith("=")} | {c: text.get(c, text["other"]) for c in wanted}
                        done = done[: own[0].start] + messages.write_icu(own[0].name, own[0].type, own[0].offset, bodies) + done[own[0].end :]
                out.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["site_key", "value", "written"])

    met = sites.withColumn("_lang", cldr.base_language(F.col("locale"))).join(F.broadcast(required), F.col("_lang") == F.col("lang"), "left")  # one row a language
    return met.select("site_key", "value", "required").mapInArrow(run, "site_key string, value string, written string")
