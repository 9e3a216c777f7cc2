"""Queries about languages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lang
from ..functions.lang_data import LANGUAGES, SAMPLES
from ..functions.rx import sql
from ..sources.tables import table
from .registry import query

FOUR = ("en", "fr", "de", "es")
_DOCS = lang.detect_sql("documents", "text", "doc_id, lang, source", FOUR)
_TURNS = lang.detect_sql("conversations", "text", "conv_id, turn, role", LANGUAGES)


def _docs(spark, sf_dir):
    return lang.detect_columns(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "text", FOUR).drop("text")


@query(f"SELECT doc_id, {lang.normalized_sql('text')} AS normalized, len(regexp_extract_all({lang.normalized_sql('text')}, '\\p{{L}}')) AS letters FROM documents")
def lang_normalize_bucket(spark, sf_dir):
    norm = lang.normalized(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", norm.alias("normalized"))
    return docs.withColumn("letters", F.regexp_count("normalized", F.lit(r"\p{L}")).cast("long"))


@query(f"SELECT doc_id, letters, bucket, detected, confidence, method FROM ({_DOCS})")
def lang_detect_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "letters", "bucket", "detected", "confidence", "method")


@query(f"SELECT lang, coalesce(detected, 'none') AS detected, bucket, count(*) AS n, sum(letters)::BIGINT AS letters FROM ({_DOCS}) GROUP BY ALL")
def lang_confusion(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang", F.coalesce("detected", F.lit("none")).alias("detected"), "bucket").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"))


@query(f"""
    SELECT detected AS lang, count(*) AS sites, sum(letters)::BIGINT AS letters,
      floor(sum(letters) / sum(sum(letters)) OVER () * 1000 + 0.5) / 1000 AS share
    FROM ({_DOCS}) WHERE detected IS NOT NULL GROUP BY detected""")
def lang_profile(spark, sf_dir):
    found = _docs(spark, sf_dir).filter("detected is not null").groupBy(F.col("detected").alias("lang")).agg(F.count("*").alias("sites"), F.sum("letters").alias("letters"))
    share = F.floor(F.col("letters") / F.sum("letters").over(Window.partitionBy(F.lit(1))) * 1000 + 0.5) / 1000
    return found.withColumn("share", share)  # a row for each language


@query(f"""
    WITH v AS (SELECT detected, sum(letters) AS letters FROM ({_TURNS}) WHERE detected IS NOT NULL AND confidence >= 0.6 GROUP BY detected)
    SELECT detected AS elected, letters::BIGINT AS letters FROM v ORDER BY letters DESC, detected LIMIT 1""")
def source_language_election(spark, sf_dir):
    turns = lang.detect_columns(table(spark, sf_dir, "conversations").select("text"), "text")
    votes = turns.filter("detected is not null and confidence >= 0.6").groupBy(F.col("detected").alias("elected")).agg(F.sum("letters").alias("letters"))
    return votes.orderBy(F.desc("letters"), "elected").limit(1)


@query(f"SELECT conv_id, turn, letters, bucket, detected, confidence, method FROM ({_TURNS})")
def lang_detect_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return lang.detect_columns(turns, "text").drop("text")


@query(f"""
    WITH v AS (SELECT source, detected, sum(letters)::BIGINT AS letters FROM ({_DOCS}) WHERE detected IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY letters DESC, detected) AS k FROM v)
    SELECT source, detected AS lang, letters FROM r WHERE k = 1 ORDER BY letters DESC, source LIMIT 10""")
def loudest_sources(spark, sf_dir):
    """Each source's most written language; the ten with most of it."""
    votes = _docs(spark, sf_dir).filter("detected is not null").groupBy("source", "detected").agg(F.sum("letters").alias("letters"))
    best = votes.groupBy("source").agg(F.min(F.struct((-F.col("letters")).alias("n"), "detected")).alias("b"))
    return best.select("source", F.col("b.detected").alias("lang"), (-F.col("b.n")).alias("letters")).orderBy(F.desc("letters"), "source").limit(10)


_SAMPLES = " UNION ALL ".join(f"SELECT {sql(k)} AS lang, {sql(v)} AS text" for k, v in SAMPLES.items())


@query(f"SELECT lang, detected, confidence, coalesce(detected = lang, false) AS ok FROM ({lang.detect_sql(f'({_SAMPLES})', 'text', 'lang', LANGUAGES)})")
def detector_self_test(spark, sf_dir):
    rows = spark.createDataFrame([*SAMPLES.items()], "lang string, text string")
    return lang.detect_columns(rows, "text").select("lang", "detected", "confidence", F.coalesce(F.col("detected") == F.col("lang"), F.lit(False)).alias("ok"))


def _segments(url):
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


@query("""
    WITH s AS (SELECT page_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')) AS segment FROM pages),
    w AS (SELECT page_id, segment, unnest(list_filter(regexp_split_to_array(segment, '[^\\p{L}]+'), lambda x: x <> '')) AS word FROM s)
    SELECT page_id, segment, word, """ + "CASE " + " ".join(f"WHEN lower(word) IN ({', '.join(sql(w) for w in ws)}) THEN '{k}'" for k, ws in ((k, [w for w, x in {w: l for l, t in lang.PATH_WORDS.items() for w in t.split()}.items() if x == k]) for k in lang.PATH_WORDS)) + " END AS lang FROM w")
def path_segment_language(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(_segments(F.col("url"))).alias("segment"))
    words = pages.select("page_id", "segment", F.explode(F.filter(F.split("segment", r"[^\p{L}]+"), lambda x: x != "")).alias("word"))
    return words.withColumn("lang", lang.path_word_language(F.col("word")))


@query("""
    SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS declared, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})(/|$)', 1) AS in_url,
      regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) <> 'en' AS drifts
    FROM pages""")
def locale_marker_drift(spark, sf_dir):
    declared = F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", declared.alias("declared"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})(/|$)", 1).alias("in_url"), (declared != "en").alias("drifts"))
