"""Files to sites: the spans of the readers with the facts of their containers, as the rules and the cascade want them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import readers
from .script import identifiers as script_identifiers
from .script import script_spans

TEXT_FACTS = ("tier", "extractor", "attr", "element", "tag", "callee", "symbol", "branch_group")
FLAGS = ("is_key", "module_specifier", "compared", "persisted", "enum_member", "grammar_hole", "in_test", "docstring")
SITES = f"{readers.SPANS}, {', '.join(f'{n} string' for n in TEXT_FACTS)}, {', '.join(f'{n} boolean' for n in FLAGS)}, holes array<string>"

#: How well a format's reader knows what holds a text.
TIERS = {"script": "ast", "text": "prose", "markdown": "prose", "python": "lexical", "shell": "lexical", "css": "lexical", "sql": "lexical"}


def _facts(file: str, how: str, text: str) -> Iterator[tuple]:
    """(path, kind, start, end, value, facts) of a file, in characters."""
    if how == "script":
        yield from script_spans(text, file)
        return
    for path, kind, a, b, value in readers.READERS[how](text):
        facts: dict = {"is_key": kind == "key", "docstring": kind == "docstring"}
        if how == "markup" and kind == "attr":
            facts["element"], _, facts["attr"] = path.rpartition("/@")
        yield path, "comment" if kind == "docstring" else kind, a, b, value, facts


def file_sites(file: str, how: str, text: str) -> Iterator[tuple]:
    """The rows of ``SITES`` of one file."""
    if "\x00" in text:
        return
    skip, at = text.startswith("﻿"), readers.Places(text)
    tier = TIERS.get(how, "structural")
    for path, kind, a, b, value, facts in _facts(file, how, text[skip:]):
        a, b, told = a + skip, b + skip, facts.get
        texts = [told(n) or "" for n in TEXT_FACTS[2:]]
        flags = [bool(told(n)) for n in FLAGS]
        yield (file, how, path, kind, *at.of(a, b), text[a:b], value, told("tier", tier) or "", told("extractor", how) or "", *texts, *flags, told("holes") or [])


def routed(files: DataFrame) -> DataFrame:
    """(file, format, text) of ``files`` (file, text, and format where it isn't to be told by the name)."""
    kind = F.coalesce("format", readers.route(F.col("file"))) if "format" in files.columns else readers.route(F.col("file"))
    return files.select(F.col("file").cast("string"), kind.alias("format"), F.col("text").cast("string").alias("text"))


def each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, of which few are Python's at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True)


def in_batches(rows: Iterator[tuple], text: int, fields: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of ``fields`` as batches of 10,000 at most, and of about a million characters in their field number ``text``."""
    kept, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), fields.values(), strict=True)], [*fields])

    for row in rows:
        kept.append(row)
        size += len(row[text] or "")
        if len(kept) == 10_000 or size > 1_000_000:
            yield batch()
            kept, size = [], 0
    if kept:
        yield batch()


def site_types() -> dict[str, pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return {n: kinds[t] for n, t in (x.split() for x in SITES.split(", "))}


def sites(files: DataFrame, *names: str) -> DataFrame:
    """The sites of ``files`` (file, text, and format where it isn't to be told by the name). A null text has none.
    ``names``: of the columns that are asked for, value among them; all if none."""
    every = dict(x.split() for x in SITES.split(", "))
    at = [[*every].index(n) for n in names]
    taken = {n: every[n] for n in names or every}
    types = {n: site_types()[n] for n in taken}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for file, how, text in each_file(batches) if text for row in file_sites(file or "", how, text))
        return in_batches((tuple(row[i] for i in at) for row in found) if at else found, [*taken].index("value"), types)

    return routed(files).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in taken.items()))


def with_dual_use(found: DataFrame) -> DataFrame:
    """``found`` with dual_use: the value is a member of an enumeration, compared or stored somewhere, and is text here.

    Origins are combined before they are shuffled; a value that is both everywhere is one row on their side.
    """
    origin = F.col("enum_member") | F.col("compared") | F.col("persisted")
    origins = found.filter(origin).select(F.col("value").alias("_v")).distinct().withColumn("_dual", F.lit(True))
    met = found.join(origins, F.col("value") == F.col("_v"), "left")
    return met.withColumn("dual_use", F.coalesce("_dual", F.lit(False)) & ~origin).drop("_v", "_dual")


_ORIGINS = ("enum_member", "compared", "persisted")


def sites_with_dual_use(files: DataFrame, pointers: Iterable[str] = ()) -> DataFrame:
    """``with_dual_use`` of the sites of ``files``, with held: those of ``pointers`` that are paths of the file's sites.

    Values meet by digests of 128 bits alone, and a file's text is shuffled once, not each of its sites' values. Files are
    read for that once more than for the sites.
    """
    pointers = [*pointers]
    origin = F.col("enum_member") | F.col("compared") | F.col("persisted")
    held = F.when(F.col("path").isin(*pointers) & F.col("file").isNotNull(), F.col("path")) if pointers else F.lit(None).cast("string")
    marks = sites(files, "file", "path", "value", *_ORIGINS).select(F.coalesce("file", F.lit("")).alias("_f"), F.unhex(F.md5("value")).alias("_k"), origin.alias("_o"), held.alias("_p"))
    marks = marks.groupBy("_f", "_k").agg(F.max("_o").alias("_is"), F.min("_o").alias("_all"), F.collect_set("_p").alias("_p"))
    both = marks.groupBy("_k").agg(F.max("_is").alias("_is"), F.min("_all").alias("_all")).filter("_is and not _all").select("_k", F.lit(True).alias("_both"))
    dual = F.when(F.col("_both") & ~F.col("_all"), F.col("_k"))
    told = marks.join(both, "_k", "left").withColumn("_k", dual).filter("_k is not null or size(_p) > 0")
    told = told.groupBy("_f").agg(F.collect_set("_k").alias("_duals"), F.flatten(F.collect_set("_p")).alias("held"))
    met = routed(files).withColumn("_f", F.coalesce("file", F.lit(""))).join(told, "_f", "left").select("file", "format", "text", "_duals", "held")
    every = [x.split()[0] for x in SITES.split(", ")]
    value, flags = every.index("value"), [every.index(n) for n in _ORIGINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, how, text, duals, held in each_file(batches):
            keys, held = {*(duals or ())}, (held or []) if file is not None else []
            for row in file_sites(file or "", how, text) if text else ():
                yield (*row, bool(keys) and not any(row[i] for i in flags) and hashlib.md5(row[value].encode("utf-8", "surrogatepass")).digest() in keys, held)

    types = site_types() | {"dual_use": pa.bool_(), "held": pa.list_(pa.string())}
    return met.mapInArrow(lambda batches: in_batches(run(batches), value, types), f"{SITES}, dual_use boolean, held array<string>")


def identifiers(files: DataFrame) -> DataFrame:
    """(word) the names that files declare: of scripts, keys, style classes, and segments of paths; once each."""
    classes = re.compile(r"[.#](-?[A-Za-z_][\w-]*)|\b(?:class|id)=[\"']([^\"']*)[\"']").finditer
    kind = F.coalesce("format", readers.route(F.col("file"))) if "format" in files.columns else readers.route(F.col("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, how, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = {x for x in re.split(r"[/.]", file or "") if x}
                if how == "script":
                    names |= {*script_identifiers(text)}
                elif how in ("css", "markup"):
                    names |= {x for m in classes(text) for x in (m[1] or m[2]).split()}
                else:
                    names |= {v for _, k, _, _, v in readers.READERS[how](text) if k == "key"}
                yield pa.RecordBatch.from_arrays([pa.array([*names], pa.string())], ["word"])

    return files.select(F.col("file").cast("string"), kind.alias("format"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "word string").distinct()
