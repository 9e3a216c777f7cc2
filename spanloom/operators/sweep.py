"""The residual sweep: runs of text that look written by a person and that nothing has claimed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rx import sql
from . import spans

# What parts runs, and runs that aren't prose.
SEPARATOR = "[^\\p{L}\\p{M}\\p{Nd}.,;:!?'’\"“”()\\[\\]\\-–—/&%…«»  ]+"
IDENTIFIER = r"^(?:[A-Z][A-Z0-9_]*|[a-z]+(?:[A-Z][a-z0-9]*)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|\w+[-_][\w-]+)$"
NOT_PROSE = r"^(?:[0-9a-fA-F]{7,}|[A-Za-z0-9+/=]{20,}|[vV]?\d+(?:\.\d+)+|\d{4}-\d{2}-\d{2}|[\d.,%+-]+)$"


def human_runs(rows: DataFrame, key: str, text: str, identifiers: DataFrame) -> DataFrame:
    """(key, run, value) of the human-looking runs of ``text``. ``identifiers``: lower-case words that are code.

    Words are told from identifiers by a join, so neither side is held in one task; compounds are to be split before.
    """
    runs = rows.select(key, F.posexplode(F.split(text, SEPARATOR)).alias("run", "value")).select(key, F.col("run").cast("long").alias("run"), F.trim("value").alias("value"))
    runs = _candidates(runs)
    each = runs.select(key, "run", F.explode("words").alias("word"))
    known = each.join(identifiers.select(F.col("word").alias("_w")).distinct(), F.lower("word") == F.col("_w"), "left_semi").groupBy(key, "run").agg(F.count("*").alias("known"))
    return _prose(runs.join(known, [key, "run"], "left")).select(key, "run", "value")


def _candidates(runs: DataFrame) -> DataFrame:
    """Runs with enough letters that are no identifier, number or digest, with their ``words``."""
    runs = runs.filter(F.length("value") >= 3).withColumn("words", F.regexp_extract_all("value", F.lit(r"\p{L}{2,}"), F.lit(0))).filter(F.size("words") > 0)
    letters = F.regexp_count("value", F.lit(r"\p{L}"))
    return runs.filter((letters / F.length("value") >= 0.5) & ~F.col("value").rlike(NOT_PROSE) & ~F.col("value").rlike(IDENTIFIER))


def _prose(runs: DataFrame) -> DataFrame:
    """Runs of which enough words aren't ``known``."""
    runs = runs.withColumn("prose", F.size("words") - F.coalesce("known", F.lit(0)))
    one = (F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 4) & (F.col("prose") > 0) & (F.length("value") >= 12)
    more = (F.size("words") > 1) & F.col("value").rlike(r"[\s ,;:!?]") & (F.col("prose") >= 2) & (F.col("prose") / F.size("words") >= 0.5)
    return runs.filter(one | more)


def dictionary(identifiers: DataFrame) -> DataFrame:
    """(word, whole) of what declared names (word) are made of; ``whole``: the word is itself a name. Compounds are split
    at hyphens, underscores and dots."""
    whole = identifiers.select("word", F.lit(True).alias("whole"))
    parts = F.split("word", "[-_.]")
    split = identifiers.filter(F.size(parts) > 1).select(F.explode(parts).alias("word"), F.lit(False).alias("whole"))
    return whole.union(split).filter("word <> ''").groupBy("word").agg(F.max("whole").alias("whole"))


_PLACED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (file, start, text) with their bytes in the file; spaces around a run are no part of it."""
    import regex

    parts, rows = regex.compile(SEPARATOR).finditer, []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACED, strict=True)], schema=_PLACED)

    for batch in batches:
        for file, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, done = start, 0  # bytes and characters so far
            for a, b in [*((m.start(), m.end()) for m in parts(text)), (len(text), len(text))]:
                run = text[done:a]
                value = run.strip(" ")
                if len(value) >= 3:
                    begin = at + len(run) - len(run.lstrip(" "))
                    rows.append((file, begin, begin + len(value.encode()), value))
                at += len(run.encode()) + len(text[a:b].encode())
                done = b
            if len(rows) >= 5000:
                yield batch_of()
                rows = []
    if rows:
        yield batch_of()


def gap_texts(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(file, start, text) of what no claim (file, start, end: bytes) of a file (file, text) covers.

    A file's gaps come together as one list, no longer than the file, so its text is shuffled once; each gap then leaves
    with its own bytes alone.
    """
    sized = files.select("file", F.octet_length("text").cast("long").alias("total"))
    gaps = spans.complement(spans.merge(claims), sized).groupBy("file").agg(F.collect_list(F.struct("start", "end")).alias("gaps"))
    raw = F.col("text").cast("binary")
    met = files.filter("text <> ''").select("file", "text").join(gaps, "file").select("file", raw.alias("raw"), F.explode("gaps").alias("g"))
    cut = F.substring("raw", (F.col("g.start") + 1).cast("int"), (F.col("g.end") - F.col("g.start")).cast("int"))
    return met.select("file", F.col("g.start").alias("start"), F.decode(cut, "utf-8").alias("text"))


def unclaimed_runs(files: DataFrame, claims: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(file, start, end, value) of human-looking runs in what no claim covers; bytes, half open.

    ``files``: file (once each), text; ``claims``: file, start, end; ``identifiers``: word, the names that the files
    declare. A word is code if it is a name or part of a compound name, or if its lower-case form is a name.
    Defined cases: a null text has no gaps; claims may overlap, repeat and be empty; a file without claims is one gap.
    """
    runs = _candidates(gap_texts(files, claims).mapInArrow(_located, "file string, start long, end long, value string"))
    each = runs.select("file", "start", F.posexplode("words").alias("at", "word"))
    each = each.select("file", "start", "at", F.explode(F.array(F.struct(F.col("word").alias("w"), F.lit(True).alias("own")), F.struct(F.lower("word").alias("w"), F.lit(False).alias("own")))).alias("k"))
    names = dictionary(identifiers).select(F.col("word").alias("_w"), "whole")
    known = each.join(names, (F.col("k.w") == F.col("_w")) & (F.col("k.own") | F.col("whole"))).groupBy("file", "start").agg(F.countDistinct("at").alias("known"))
    return _prose(runs.join(known, ["file", "start"], "left")).select("file", "start", "end", "value")


RESIDUAL_SQL = f"""
    WITH ids AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part UNION ALL SELECT lower(event_type) FROM events)),
    parts AS (SELECT doc_id, regexp_split_to_array(text, {sql(SEPARATOR)}) AS a FROM documents),
    runs AS (SELECT doc_id, (i - 1)::BIGINT AS run, trim(value, ' ') AS value, regexp_extract_all(trim(value, ' '), '\\p{{L}}{{2,}}') AS words
      FROM (SELECT doc_id, unnest(a) AS value, generate_subscripts(a, 1) AS i FROM parts)),
    f AS (SELECT *, len(words) AS n FROM runs WHERE length(value) >= 3 AND len(words) > 0 AND len(regexp_extract_all(value, '\\p{{L}}')) / length(value) >= 0.5
      AND NOT regexp_matches(value, {sql(NOT_PROSE)}) AND NOT regexp_matches(value, {sql(IDENTIFIER)})),
    k AS (SELECT doc_id, run, count(*) AS known FROM (SELECT doc_id, run, unnest(words) AS w FROM f) WHERE lower(w) IN (SELECT word FROM ids) GROUP BY ALL),
    p AS (SELECT f.*, n - coalesce(known, 0) AS prose FROM f LEFT JOIN k USING (doc_id, run))
    SELECT doc_id, run, value FROM p WHERE (n = 1 AND length(words[1]) >= 4 AND prose > 0 AND length(value) >= 12)
      OR (n > 1 AND regexp_matches(value, '[\\s ,;:!?]') AND prose >= 2 AND prose / n >= 0.5)
"""
