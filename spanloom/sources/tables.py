"""Adapters: rows of tables as files, and their text spans as sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def line_sites(rows: DataFrame, file: Column, text: str) -> DataFrame:
    """One site for each line that is not blank: file, path, line, start, end (bytes, half open), value.

    A line's start is the bytes of all lines before it, each with its line end.
    """
    lines = F.split(F.col(text), "\n")
    sized = F.transform(lines, lambda x: F.octet_length(x) + 1)
    starts = F.aggregate(sized, F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("sum")), lambda a, n: F.struct(F.concat(a["at"], F.array(a["sum"] + n)).alias("at"), (a["sum"] + n).alias("sum")), lambda a: a["at"])
    out = rows.select(file.alias("file"), F.posexplode(F.arrays_zip(lines.alias("value"), F.slice(starts, F.lit(1), F.size(lines)).alias("start"))).alias("i", "x"))
    out = out.select("file", (F.col("i") + 1).cast("long").alias("line"), F.col("x.start").cast("long").alias("start"), F.col("x.value").alias("value"))
    out = out.filter(F.trim("value") != "")
    return out.select("file", F.concat(F.lit("line["), F.col("line").cast("string"), F.lit("]")).alias("path"), "line", "start", (F.col("start") + byte_length(F.col("value"))).alias("end"), "value")


def paragraph_sites(rows: DataFrame, file: Column, text: str) -> DataFrame:
    """One site for each paragraph (blank lines part them) that holds a word of two letters."""
    parts = F.split(F.col(text), "\n[ \t]*\n")
    out = rows.select(file.alias("file"), F.posexplode(parts).alias("i", "value"))
    out = out.filter(F.col("value").rlike(r"\p{L}{2,}"))
    return out.select("file", F.concat(F.lit("p["), F.col("i").cast("string"), F.lit("]")).alias("path"), F.col("i").cast("long").alias("paragraph"), F.regexp_replace("value", "^[ \t]+", "").alias("value"))


def with_identity(sites: DataFrame) -> DataFrame:
    """Adds site_key, id, content_hash, dup_key and dup_hash to sites with file, path and value (in normal form C)."""
    key = identity.site_key(F.col("file"), F.col("path"))
    return sites.withColumns({"site_key": key, "id": identity.short_id("ul_", key), "content_hash": identity.content_hash(F.col("value")), "dup_key": identity.dup_key(F.col("value")), "dup_hash": identity.dup_hash(F.col("value"))})


def document_file() -> Column:
    return F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))


def turn_sites(conversations: DataFrame) -> DataFrame:
    """Turns as sites: a conversation is a file, a turn a path, its role the surface."""
    return conversations.select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file"),
        F.concat(F.lit("turn["), F.col("turn").cast("string"), F.lit("]")).alias("path"),
        F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text").alias("value"),
    )


def json_line_sites(rows: DataFrame, file: Column, text: str) -> DataFrame:
    """Keys of one-line JSON objects with their values: JSON pointer paths under the line."""
    pairs = F.from_json(F.col(text), "map<string,string>")
    out = rows.select(file.alias("file"), F.explode(pairs).alias("key", "value"))
    return out.select("file", F.concat(F.lit("/"), identity.pointer_segment(F.col("key"))).alias("path"), "key", "value")


def markup_values(pages: DataFrame, pattern: str, path: str, group: int = 1) -> DataFrame:
    """Values of one kind of markup, by pattern, in order: file, path (numbered), value."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    out = pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), F.posexplode(found).alias("i", "value"))
    out = out.filter(F.trim("value") != "")
    return out.select("file", F.concat(F.lit(f"{path}["), F.col("i").cast("string"), F.lit("]")).alias("path"), "value")
