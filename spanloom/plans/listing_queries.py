"""Queries of file listings: documents as paths of a tree with ignore files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import listing
from ..sources.tables import table
from .registry import query

TOP = "# logs\n*.log\n!d1*.log\nbuild/\n!build/\n/*/fr/**/*.md\ntmp/\n!tmp/kept.txt\n"
NESTED = "*.txt\n!d?.txt\n"

_PATH_SQL = "source || '/' || lang || '/' || CASE doc_id % 4 WHEN 0 THEN 'build/' WHEN 1 THEN 'a/tmp/' ELSE '' END || 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.txt' ELSE '.md' END"


@query(f"""
    SELECT path, CASE WHEN doc_id % 4 = 1 THEN source || '/' || lang || '/a/tmp' ELSE path END AS by FROM (SELECT *, {_PATH_SQL} AS path FROM documents)
    WHERE doc_id % 4 = 1 OR (doc_id % 3 = 0 AND NOT starts_with(doc_id::VARCHAR, '1')) OR (doc_id % 3 = 2 AND lang = 'fr') OR (doc_id % 3 = 1 AND lang = 'en' AND length(doc_id::VARCHAR) <> 1)""")
def ignored_paths(spark, sf_dir):
    """Paths that ignore files leave out, with what leaves them out: the path itself or a folder above."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    folder = F.when(d % 4 == 0, "build/").when(d % 4 == 1, "a/tmp/").otherwise("")
    end = F.when(d % 3 == 0, ".log").when(d % 3 == 1, ".txt").otherwise(".md")
    paths = docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.lit("d"), d.cast("string"), end).alias("path"))
    nested = docs.filter("lang = 'en'").select(F.concat("source", F.lit("/en")).alias("folder"), F.lit(NESTED).alias("text")).distinct()
    top = docs.limit(1).select(F.lit("").alias("folder"), F.lit(TOP).alias("text"))
    return listing.ignored(paths, listing.ignore_rules(nested.union(top)))
