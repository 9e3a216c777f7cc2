"""Queries of token shapes, the cascade, harmonisation and the residual sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lang, shapes
from ..functions.lang_data import COGNATES
from ..functions.rx import sql
from ..operators import classify as C
from ..operators import sweep
from ..sources.tables import table
from .registry import query

SHAPES = ["#1a2b3c", "oklch(0.15 0.02 255)", "1.5rem", "var(--fg)", "0 1px 2px var(--shadow)", "the 1.5rem rule", "application/json", "application/vnd.a+json; q=1", "https://x.y/z", "./a", "a-b-c", "fr-FR", "zh-Hant", "es-419", "dd/MM/yyyy", "yyyyMMdd", "EEEE d MMMM yyyy 'à' HH:mm", "masse", "assez", "aaa", "AAA-SSS", "25 / 5", "Hello world", "", "calc(1px + (2px * 3))", "0.5", "1-URGENT", "mailto:x@y.z"]

_SHAPE_ROWS = " UNION ALL ".join(f"SELECT {sql(x)} AS value" for x in SHAPES)
_POOL = f"SELECT DISTINCT value FROM (SELECT p_name AS value FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT event_type FROM events UNION ALL SELECT url FROM pages UNION ALL {_SHAPE_ROWS})"
_m = lambda p: f"regexp_matches(value, {sql(p)})"


@query(f"""
    SELECT value, CASE WHEN {shapes.is_design_token_sql('value')} THEN 'design-token' WHEN {_m(shapes.MEDIA)} THEN 'media-type' WHEN {_m(shapes.URL)} OR {_m(shapes.SLUG)} THEN 'url-or-slug'
      WHEN NOT {_m(shapes.WORDY)} THEN 'wordless' WHEN {shapes.is_date_pattern_sql('value')} THEN 'date-pattern' WHEN {_m(shapes.LOCALE)} THEN 'locale-tag' ELSE 'text' END AS shape
    FROM ({_POOL})""")
def token_shape_cascade(spark, sf_dir):
    cols = (("part", "p_name"), ("part", "p_type"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("events", "event_type"), ("pages", "url"))
    rows = spark.createDataFrame([(x,) for x in SHAPES], "value string")
    for t, c in cols:
        rows = rows.union(table(spark, sf_dir, t).select(F.col(c).alias("value")))
    v = F.col("value")
    shape = F.when(shapes.is_design_token(v), "design-token").when(v.rlike(shapes.MEDIA), "media-type").when(v.rlike(shapes.URL) | v.rlike(shapes.SLUG), "url-or-slug")
    shape = shape.when(~v.rlike(shapes.WORDY), "wordless").when(shapes.is_date_pattern(v), "date-pattern").when(v.rlike(shapes.LOCALE), "locale-tag").otherwise("text")
    return rows.distinct().select("value", shape.alias("shape"))


_PAIR = ("fr", "en")
_TURN_SQL = lang.detect_sql("conversations", "text", "conv_id, turn, role, text AS value", _PAIR)
_COGNATE = ", ".join(sql(c) for c in COGNATES)


def classified_sql(rows: str, keep: str) -> str:
    """The cascade over detected ``rows`` with a value of which nothing else is known, as SQL."""
    return f"""
    SELECT {keep}, value, detected, confidence, verdict, CASE verdict WHEN 'translate' THEN NULL ELSE reason END AS reason FROM (SELECT *,
      CASE WHEN {shapes.is_design_token_sql('value')} OR {_m(shapes.MEDIA)} OR {_m(shapes.URL)} OR {_m(shapes.SLUG)} OR NOT {_m(shapes.WORDY)} THEN 'do-not-translate'
        WHEN {shapes.is_date_pattern_sql('value')} THEN 'needs-judgment'
        WHEN {_m(shapes.LOCALE)} THEN CASE WHEN value LIKE 'fr-%' THEN 'locale-marker' ELSE 'do-not-translate' END
        WHEN detected = 'en' AND confidence >= 0.7 THEN 'do-not-translate' WHEN detected IS NULL AND lower(trim(value, ' ')) NOT IN ({_COGNATE}) THEN 'needs-judgment'
        WHEN detected = 'fr' THEN 'translate' ELSE 'needs-judgment' END AS verdict,
      CASE WHEN {shapes.is_design_token_sql('value')} THEN 'style-token' WHEN {_m(shapes.MEDIA)} THEN 'interop-format' WHEN {_m(shapes.URL)} OR {_m(shapes.SLUG)} THEN 'url-or-slug'
        WHEN NOT {_m(shapes.WORDY)} THEN 'numeric-or-symbolic' WHEN {shapes.is_date_pattern_sql('value')} THEN 'symbol-set' WHEN {_m(shapes.LOCALE)} THEN CASE WHEN value LIKE 'fr-%' THEN NULL ELSE 'code-token' END
        WHEN detected = 'en' AND confidence >= 0.7 THEN 'already-target-language'
        WHEN detected IS NULL AND lower(trim(value, ' ')) NOT IN ({_COGNATE}) THEN CASE bucket WHEN 'short' THEN 'short-string' ELSE 'ambiguous-role' END ELSE 'no-rule' END AS reason
    FROM ({rows}))
"""


CLASSIFIED_SQL = classified_sql(_TURN_SQL, "conv_id, turn, role")


def classified_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("value"))
    return C.classify(turns, *_PAIR).select("conv_id", "turn", "role", "value", "detected", "confidence", "verdict", "reason")


@query(CLASSIFIED_SQL)
def classify_turns(spark, sf_dir):
    return classified_turns(spark, sf_dir)


@query(f"SELECT verdict, count(*) AS n FROM ({CLASSIFIED_SQL}) GROUP BY verdict")
def verdict_tally(spark, sf_dir):
    return classified_turns(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"SELECT role, coalesce(reason, 'none') AS reason, count(*) AS n FROM ({CLASSIFIED_SQL}) GROUP BY ALL")
def reason_histogram(spark, sf_dir):
    return classified_turns(spark, sf_dir).groupBy("role", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
    WITH c AS ({CLASSIFIED_SQL}), g AS (SELECT conv_id, bool_or(verdict = 'translate') AS t FROM c GROUP BY conv_id)
    SELECT c.conv_id, turn, t AND coalesce(reason IN ('short-string', 'ambiguous-role', 'no-rule'), false) AS harmonised,
      CASE WHEN t AND reason IN ('short-string', 'ambiguous-role', 'no-rule') THEN 'translate' ELSE verdict END AS verdict FROM c JOIN g USING (conv_id)""")
def branch_harmonise(spark, sf_dir):
    sites = classified_turns(spark, sf_dir).withColumns({"file": F.lit("conversations"), "branch_group": F.col("conv_id")})
    return C.harmonise(sites).select("conv_id", "turn", "harmonised", "verdict")


@query(sweep.RESIDUAL_SQL)
def residual_runs(spark, sf_dir):
    """Runs of documents that look written by a person, but for words the data itself declares."""
    ids = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).union(table(spark, sf_dir, "events").select(F.lower("event_type")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sweep.human_runs(rows, "doc_id", "text", ids.distinct())
