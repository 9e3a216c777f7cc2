"""Queries of span algebra over benchmark passages found in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages, spans
from ..sources import tables
from ..sources.tables import table
from .registry import query
from .site_queries import LINES_SQL, doc_lines

# a passage is found where it stands word for word, wherever its lines begin
_HITS_SQL = """
    SELECT 'doc/' || doc_id AS file, strlen(substring(d.text, 1, position(b.text IN d.text) - 1))::BIGINT AS start, (strlen(substring(d.text, 1, position(b.text IN d.text) - 1)) + strlen(b.text))::BIGINT AS "end", b.item_id,
      ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::BIGINT AS n FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)
"""
_SPANS_SQL = """
    SELECT 'doc/' || doc_id AS file, s AS start, s + n AS "end" FROM (SELECT doc_id,
      (hash_like * 7919 % n_bytes)::BIGINT AS s, least((hash_like * 104729 % 400)::BIGINT, n_bytes - (hash_like * 7919 % n_bytes)) AS n
      FROM (SELECT doc_id, strlen(text)::BIGINT AS n_bytes, unnest(range(1, 9)) * (doc_id + 3) AS hash_like FROM documents WHERE strlen(text) > 0)) WHERE n > 0
"""
_MERGED_SQL = f"""
    SELECT file, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(b) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM
      (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM ({_SPANS_SQL}))) GROUP BY file, island
"""


def _spans(spark, sf_dir):
    """Eight arithmetic spans of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tables.byte_length(F.col("text")).alias("n_bytes")).filter("n_bytes > 0")
    h = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")
    rows = docs.select("doc_id", "n_bytes", h).withColumn("h", F.col("k") * (F.col("doc_id") + 3))
    rows = rows.withColumn("start", F.col("h") * 7919 % F.col("n_bytes"))
    size = F.least(F.col("h") * 104729 % 400, F.col("n_bytes") - F.col("start"))
    return rows.select(tables.document_file().alias("file"), "start", (F.col("start") + size).alias("end")).filter("end > start")


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(tables.document_file().alias("file"), tables.byte_length(F.col("text")).alias("total"))


@query(_MERGED_SQL)
def span_merge(spark, sf_dir):
    return spans.merge(_spans(spark, sf_dir))


@query(f"""
    WITH m AS ({_MERGED_SQL}), e AS (SELECT file, start, "end" FROM m UNION ALL SELECT 'doc/' || doc_id, strlen(text)::BIGINT, strlen(text)::BIGINT FROM documents),
    g AS (SELECT file, coalesce(max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, start AS "end" FROM e)
    SELECT * FROM g WHERE "end" > start""")
def span_complement(spark, sf_dir):
    return spans.complement(spans.merge(_spans(spark, sf_dir)), _files(spark, sf_dir))


@query(f"""
    SELECT 'doc/' || doc_id AS file, coalesce(claimed, 0)::BIGINT AS claimed, strlen(text)::BIGINT AS total,
      CASE WHEN strlen(text) = 0 THEN 1.0::DOUBLE ELSE floor(coalesce(claimed, 0)::DOUBLE / strlen(text) * 1000 + 0.5) / 1000 END AS ratio
    FROM documents LEFT JOIN (SELECT file, sum("end" - start) AS claimed FROM ({_MERGED_SQL}) GROUP BY file) m ON m.file = 'doc/' || doc_id""")
def claim_ratio(spark, sf_dir):
    return spans.claim_ratio(spans.merge(_spans(spark, sf_dir)), _files(spark, sf_dir))


def _benchmark_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(tables.document_file().alias("file"), "text")
    return passages.find_passages(docs, table(spark, sf_dir, "benchmark"))


@query(_HITS_SQL)
def passage_places(spark, sf_dir):
    """Benchmark passages in documents, with the bytes of the first place and the number of places."""
    return _benchmark_hits(spark, sf_dir)


@query(f"SELECT b.item_id, count(DISTINCT h.file) AS files, coalesce(sum(h.n), 0)::BIGINT AS places, count(h.file) > 0 AS accounted FROM benchmark b LEFT JOIN ({_HITS_SQL}) h USING (item_id) GROUP BY b.item_id")
def accounting_coverage(spark, sf_dir):
    hits = _benchmark_hits(spark, sf_dir).select("item_id", "file", "n")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return items.join(hits, "item_id", "left").groupBy("item_id").agg(F.countDistinct("file").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"), (F.count("file") > 0).alias("accounted"))


@query(f"SELECT h.* FROM ({_HITS_SQL}) h WHERE EXISTS (SELECT 1 FROM ({_SPANS_SQL}) s WHERE s.file = h.file AND s.start < h.\"end\" AND s.\"end\" > h.start)")
def trap_violations(spark, sf_dir):
    """Benchmark passages that a claimed span touches."""
    return spans.overlaps(_benchmark_hits(spark, sf_dir), _spans(spark, sf_dir))


@query(f"""
    WITH l AS ({LINES_SQL}), c AS (SELECT l.file, l.line FROM l JOIN ({_SPANS_SQL}) s ON s.file = l.file AND s.start < l."end" AND s."end" > l.start)
    SELECT file, line, value FROM l WHERE (file, line) NOT IN (SELECT * FROM c) AND regexp_matches(value, '\\p{{L}}{{2,}}\\s+\\p{{L}}{{2,}}')""")
def audit_uncovered_lines(spark, sf_dir):
    """Lines of prose that no claimed span touches."""
    lines = doc_lines(spark, sf_dir)
    touched = spans.overlaps(lines, _spans(spark, sf_dir)).select("file", "line", F.col("line").alias("end_line"))
    return spans.uncovered_lines(lines.filter(F.col("value").rlike(r"\p{L}{2,}\s+\p{L}{2,}")), touched).select("file", "line", "value")
