"""Queries about sites: lines, identity, duplicates, markup, JSON lines, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, lang, rx
from ..sources import tables
from ..sources.tables import table
from .registry import query

LINES_SQL = """
    SELECT 'doc/' || doc_id AS file, 'line[' || i || ']' AS path, i AS line, start, start + strlen(value) AS "end", value
    FROM (SELECT doc_id, i, value, (sum(strlen(value) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(value) - 1)::BIGINT AS start
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS i FROM documents))
    WHERE trim(value, ' ') <> ''
"""
_SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def collapsed_sql(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, {rx.sql(_SPACES)}, ' ', 'g'), '^ | $', '', 'g')"


def doc_lines(spark, sf_dir):
    return tables.line_sites(table(spark, sf_dir, "documents").select("doc_id", "text"), tables.document_file(), "text")


@query(LINES_SQL)
def line_sites(spark, sf_dir):
    return doc_lines(spark, sf_dir)


@query("""
    SELECT 'doc/' || doc_id AS file, 'p[' || (i - 1) || ']' AS path, (i - 1)::BIGINT AS paragraph, regexp_replace(value, '^[ \\t]+', '') AS value
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS value, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t]*\\n'), 1) AS i FROM documents)
    WHERE regexp_matches(value, '\\p{L}{2,}')""")
def paragraph_sites(spark, sf_dir):
    return tables.paragraph_sites(table(spark, sf_dir, "documents").select("doc_id", "text"), tables.document_file(), "text")


IDENTITY_SQL = f"""
    SELECT file, path, file || '#' || path AS site_key, 'ul_' || sha1(file || '#' || path)[:12] AS id,
      sha1(nfc_normalize(value))[:8] AS content_hash, sha1({collapsed_sql('nfc_normalize(value)')})[:6] AS dup_key, sha1({collapsed_sql('nfc_normalize(value)')}) AS dup_hash
    FROM ({LINES_SQL})
"""


@query(IDENTITY_SQL)
def site_identity(spark, sf_dir):
    return tables.with_identity(doc_lines(spark, sf_dir)).select("file", "path", "site_key", "id", "content_hash", "dup_key", "dup_hash")


@query(f"SELECT dup_hash, count(*) AS n FROM ({IDENTITY_SQL}) GROUP BY dup_hash HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return tables.with_identity(doc_lines(spark, sf_dir)).groupBy("dup_hash").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""
    WITH s AS ({IDENTITY_SQL}), f AS (SELECT dup_hash, arg_min(site_key, (file, path)) AS first_key, count(*) AS n FROM s GROUP BY dup_hash HAVING count(*) > 1)
    SELECT s.site_key, f.first_key FROM s JOIN f USING (dup_hash) WHERE s.site_key <> f.first_key""")
def dup_links(spark, sf_dir):
    """Each repeated line with the first of its group: an aggregation combined before the shuffle, then a join that can split hot groups."""
    sites = tables.with_identity(doc_lines(spark, sf_dir)).select("dup_hash", "site_key", "file", "path")
    first = sites.groupBy("dup_hash").agg(F.min(F.struct("file", "path", "site_key")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    return sites.join(first, "dup_hash").select("site_key", F.col("f.site_key").alias("first_key")).filter("site_key <> first_key")


_TURN_LANG = lang.detect_sql("conversations", "text", "conv_id, turn, text", ("en", "fr", "de", "es"))


@query(f"""
    SELECT dup_hash, count(*) AS n, count(DISTINCT detected) AS languages FROM
      (SELECT detected, sha1({collapsed_sql('text')}) AS dup_hash FROM ({_TURN_LANG}))
    GROUP BY dup_hash HAVING count(*) > 1 AND count(DISTINCT detected) > 1""")
def dup_divergence(spark, sf_dir):
    turns = lang.detect_columns(table(spark, sf_dir, "conversations").select("text"), "text", ("en", "fr", "de", "es"))
    groups = turns.groupBy(identity.dup_hash(F.col("text")).alias("dup_hash")).agg(F.count("*").alias("n"), F.countDistinct("detected").alias("languages"))
    return groups.filter("n > 1 and languages > 1")


@query(f"""
    SELECT sha1({collapsed_sql('text')}) AS dup_hash, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT source) > 1""")
def dup_source_divergence(spark, sf_dir):
    """Equal documents, but for white space and case, that stand under different sources."""
    groups = table(spark, sf_dir, "documents").groupBy(identity.dup_hash(F.col("text")).alias("dup_hash")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return groups.filter("n > 1 and sources > 1")


def _markup(name: str, pattern: str, path: str) -> None:
    oracle = f"""
        SELECT 'page/' || page_id AS file, '{path}[' || (i - 1) || ']' AS path, value FROM
          (SELECT page_id, unnest(m) AS value, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {rx.sql(pattern)}, 1) AS m FROM pages))
        WHERE trim(value, ' ') <> ''"""

    def run(spark, sf_dir):
        return tables.markup_values(table(spark, sf_dir, "pages"), pattern, path)

    run.__name__ = name
    query(oracle)(run)


_markup("html_title_sites", r"<title>([^<]*)</title>", "title/text")
_markup("html_comment_sites", r"<!--\s*([^>]*?)\s*-->", "comment")
_markup("html_heading_sites", r"<h1>([^<]*)</h1>", "h1/text")
_markup("html_link_text", r"<a [^>]*>([^<]*)</a>", "a/text")
_markup("html_text_runs", r">([^<>]*\p{L}[^<>]*)<", "text")
_markup("html_link_targets", r'<a href="([^"]*)"', "a@href")


@query("""
    SELECT k AS event_key, count(*) AS n, count(DISTINCT value) AS distinct_values FROM
      (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events) GROUP BY k""")
def jsonl_sites(spark, sf_dir):
    pairs = tables.json_line_sites(table(spark, sf_dir, "events"), F.concat(F.lit("event/"), F.col("event_id").cast("string")), "props")
    return pairs.groupBy(F.col("key").alias("event_key")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


@query("SELECT 'event-type' AS kind, event_type AS value, count(*) AS uses FROM events GROUP BY event_type UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2")
def identifier_vocab(spark, sf_dir):
    kinds = (("event-type", "events", "event_type"), ("priority", "orders", "o_orderpriority"), ("type", "part", "p_type"))
    parts = [table(spark, sf_dir, t).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("uses")).select(F.lit(k).alias("kind"), "value", "uses") for k, t, c in kinds]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT 'doc/' || doc_id AS file, n_chars, text[:60] AS excerpt FROM documents WHERE regexp_matches('doc/' || doc_id, '^doc/[^/]*7$') AND lower(text) LIKE '%the%' ORDER BY file LIMIT 50")
def sites_select(spark, sf_dir):
    """A conjunctive selection: file glob and value contains, in file order, the first fifty (the report's own limit)."""
    docs = table(spark, sf_dir, "documents").select(tables.document_file().alias("file"), "n_chars", "text")
    found = docs.filter(rx.glob_filter(F.col("file"), ["doc/*7"]) & F.contains(F.lower("text"), F.lit("the")))
    return found.select("file", "n_chars", F.substring("text", 1, 60).alias("excerpt")).orderBy("file").limit(50)


ANCHORS = [("a.md", "# Getting started", "see [x](#getting-started)"), ("b.md", "# Étape deux !", "voir [y](#étape-deux) et [z](#perdu)"), ("c.md", "plain", "[q](#nowhere)"), ("d.md", "## A  b", "[r](#a--b) [s](#a-b)")]
_SLUG = r"[^\p{L}\p{N}\s-]"


@query(f"""
    WITH t(file, heading, body) AS (VALUES {', '.join('(' + ', '.join(rx.sql(x) for x in r) + ')' for r in ANCHORS)}),
    h AS (SELECT file, regexp_replace(trim(regexp_replace(lower(regexp_replace(heading, '^#+', '')), '{_SLUG}', '', 'g')), ' ', '-', 'g') AS slug FROM t WHERE heading LIKE '#%'),
    l AS (SELECT file, unnest(regexp_extract_all(body, '\\]\\(#([^)]*)\\)', 1)) AS target FROM t)
    SELECT l.file, l.target FROM l WHERE l.file IN (SELECT file FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.file = l.file AND h.slug = l.target)""")
def anchor_links_dangling(spark, sf_dir):
    """In-page links without a heading of that slug, in files that have headings."""
    rows = spark.createDataFrame(ANCHORS, "file string, heading string, body string")
    slug = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.regexp_replace("heading", "^#+", "")), _SLUG, "")), " ", "-")
    heads = rows.filter(F.col("heading").startswith("#")).select("file", slug.alias("target"))
    links = rows.select("file", F.explode(F.regexp_extract_all("body", F.lit(r"\]\(#([^)]*)\)"), F.lit(1))).alias("target"))
    return links.join(heads.select("file").distinct(), "file", "left_semi").join(heads, ["file", "target"], "left_anti")


@query("""
    SELECT lang, source, count(*) AS n, max(n_chars) AS longest, arg_min('doc/' || doc_id, (-n_chars, doc_id)) AS longest_file FROM documents GROUP BY lang, source""")
def largest_file_by_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars", "doc_id")
    best = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("b"))
    return best.select("lang", "source", "n", (-F.col("b.n")).alias("longest"), F.concat(F.lit("doc/"), F.col("b.doc_id").cast("string")).alias("longest_file"))


@query("""
    WITH c AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
    SELECT event_type, k, event_id FROM c WHERE k <= 3""")
def first_of_group(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).cast("long").alias("k")).filter("k <= 3")
