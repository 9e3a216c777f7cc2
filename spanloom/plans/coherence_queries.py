"""Queries of coherence and of paths that tell sites apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cldr
from ..functions.vocab import PLURAL_ORDER
from ..operators import coherence
from ..sources.tables import table
from .plural_queries import CLDR_SQL
from .registry import query

_LANGS = "CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'en' END"
_SITES_SQL = f"""
    SELECT 'd' || doc_id || '.md' AS file, 'd' || doc_id || '.md#v' AS site_key, 'v' AS path, lang || '-X' AS value, 'locale-marker' AS verdict, NULL AS reason, sha256('') AS dup_key, NULL AS detected, []::INT[] AS holes, '' AS raw FROM documents
    UNION ALL SELECT 'd' || doc_id || '.md', 'd' || doc_id || '.md#t', 't', coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN 'translate' ELSE 'do-not-translate' END, CASE WHEN doc_id % 2 = 1 THEN 'source-locale-bundle' END, sha256(coalesce(text, '')), {_LANGS}, [0, 1]::INT[],
      'see [a](#from-' || source || ') and [b](#' || lang || '-' || doc_id % 7 || ')' FROM documents
    UNION ALL SELECT 'd' || doc_id || '.md', 'd' || doc_id || '.md#h', 'h1[0]', ' From ' || source || '! ', 'needs-judgment', NULL, sha256('h'), NULL, []::INT[], '' FROM documents
    UNION ALL SELECT 'd' || doc_id || '.md', 'd' || doc_id || '.md#g', 'h2[1]', lang || ' ' || doc_id % 5, 'needs-judgment', NULL, sha256('h'), NULL, []::INT[], '' FROM documents
"""


def _sites(spark, sf_dir):
    """Four sites a document: a locale mark, its text with links, and two headings."""
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    detected = F.when(d % 3 == 0, F.col("lang")).when(d % 3 == 1, "en")
    links = F.concat(F.lit("see [a](#from-"), "source", F.lit(") and [b](#"), "lang", F.lit("-"), (d % 7).cast("string"), F.lit(")"))
    no_holes = F.array().cast("array<int>")

    def site(name, path, value, verdict, reason, key, lang, holes, raw):
        cols = {"path": F.lit(path), "value": value, "verdict": verdict, "reason": reason, "dup_key": F.sha2(key, 256), "detected": lang, "holes": holes, "raw": raw}
        return F.struct(F.lit(name).alias("name"), *(c.alias(n) for n, c in cols.items()))

    judged = F.lit("needs-judgment")
    four = F.array(
        site("v", "v", F.concat("lang", F.lit("-X")), F.lit("locale-marker"), none, F.lit(""), none, no_holes, F.lit("")),
        site("t", "t", F.col("text"), F.when(d % 2 == 0, "translate").otherwise("do-not-translate"), F.when(d % 2 == 1, "source-locale-bundle"), F.col("text"), detected, F.array(F.lit(0), F.lit(1)), links),
        site("h", "h1[0]", F.concat(F.lit(" From "), "source", F.lit("! ")), judged, none, F.lit("h"), none, no_holes, F.lit("")),
        site("g", "h2[1]", F.concat("lang", F.lit(" "), (d % 5).cast("string")), judged, none, F.lit("h"), none, no_holes, F.lit("")),
    )
    rows = docs.select(F.concat(F.lit("d"), d.cast("string"), F.lit(".md")).alias("file"), F.explode(four).alias("s"))
    return rows.select("file", F.concat("file", F.lit("#"), "s.name").alias("site_key"), F.lit("markdown").alias("extractor"), *(f"s.{c}" for c in ("path", "value", "verdict", "reason", "dup_key", "detected", "holes", "raw")))


_FAMILIES_SQL = f"""
    SELECT file, site_key, list_filter(required, lambda c: NOT list_contains(have, c)) AS missing, list_filter(have, lambda c: NOT list_contains(required, c)) AS extra
    FROM (SELECT source || '/' || lang AS file, source || '/' || lang || '#n' AS site_key, lang, list_filter([{', '.join(f"'{c}'" for c in PLURAL_ORDER)}], lambda c: list_contains(list(DISTINCT [{', '.join(f"'{c}'" for c in PLURAL_ORDER)}][doc_id % 6 + 1]), c)) AS have FROM documents GROUP BY source, lang) JOIN {CLDR_SQL} USING (lang)
"""


@query(f"""
    WITH s AS ({_SITES_SQL}), slugs AS (SELECT DISTINCT 'from-' || source AS a FROM documents UNION SELECT DISTINCT lang || '-' || doc_id % 5 FROM documents),
    l AS (SELECT file, site_key, lower(unnest(regexp_extract_all(raw, '\\]\\(#([^)]+)\\)', 1))) AS a FROM s),
    d AS (SELECT min({{'file': file, 'site_key': site_key}}) AS f, list_sort(list(DISTINCT detected) FILTER (detected IS NOT NULL)) AS langs FROM s WHERE verdict = 'translate' OR reason = 'source-locale-bundle' GROUP BY dup_key)
    SELECT 'G6' AS gate, 'locale-drift' AS kind, file, site_key, 'declares ' || value AS message FROM s WHERE verdict = 'locale-marker' AND split_part(value, '-', 1) <> 'en'
    UNION ALL SELECT 'G6', 'duplicate-divergence', f.file, f.site_key, 'the same text is in ' || array_to_string(langs, ' and ') FROM d WHERE len(langs) > 1
    UNION ALL SELECT 'G6', 'anchor-drift', file, site_key, 'links to #' || a FROM l WHERE a NOT IN (SELECT a FROM slugs)
    UNION ALL SELECT 'G6', 'hole-loss', file, site_key, 'placeholder {{' || h || '}} is missing' FROM (SELECT *, unnest(holes) AS h FROM s) WHERE NOT contains(value, '{{' || h || '}}')
    UNION ALL SELECT 'G6', 'plural-incomplete', file, site_key, CASE WHEN len(missing) > 0 THEN 'no ' || array_to_string(missing, ' or ') ELSE '' END || CASE WHEN len(missing) > 0 AND len(extra) > 0 THEN ', and ' ELSE '' END || CASE WHEN len(extra) > 0 THEN 'more ' || array_to_string(extra, ' and ') ELSE '' END
      FROM ({_FAMILIES_SQL}) WHERE len(missing) > 0 OR len(extra) > 0""")
def gate_coherence(spark, sf_dir):
    """G6 over sites and families made of documents."""
    docs = table(spark, sf_dir, "documents")
    category = F.get(F.array(*map(F.lit, PLURAL_ORDER)), (F.col("doc_id") % 6).cast("int"))
    have = docs.groupBy("source", "lang").agg(cldr.in_order(F.collect_set(category)).alias("have")).join(F.broadcast(cldr.table(spark)), "lang")  # one row a language
    file = F.concat("source", F.lit("/"), "lang")
    families = have.select(file.alias("file"), F.concat(file, F.lit("#n")).alias("site_key"), F.array_except("required", "have").alias("missing"), F.array_except("have", "required").alias("extra"))
    return coherence.g6_coherence(_sites(spark, sf_dir), families, "en")


@query("""
    WITH s AS (SELECT source AS file, lang || '~' || doc_id % 4 AS p, CASE WHEN doc_id % 5 = 0 THEN 'key' ELSE 'string' END AS kind, doc_id AS start FROM documents UNION ALL SELECT source, lang || '~1', 'string', doc_id FROM documents WHERE doc_id % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY file, p ORDER BY kind = 'key', start, kind) AS n, count(*) OVER (PARTITION BY file, p) AS c, sum((kind = 'key')::INT) OVER (PARTITION BY file, p) AS k FROM s)
    SELECT file, CASE WHEN n = 1 THEN p ELSE p || '~' || n END AS path, kind, start, n > 1 AND NOT (c = 2 AND k = 1) AS renamed FROM r""")
def unique_paths(spark, sf_dir):
    """Documents as sites whose paths repeat within a source."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    first = docs.select(F.col("source").alias("file"), F.concat("lang", F.lit("~"), (d % 4).cast("string")).alias("path"), F.when(d % 5 == 0, "key").otherwise("string").alias("kind"), d.alias("start"))
    second = docs.filter(d % 2 == 1).select(F.col("source").alias("file"), F.concat("lang", F.lit("~1")).alias("path"), F.lit("string").alias("kind"), d.alias("start"))
    return coherence.unique_paths(first.union(second))
