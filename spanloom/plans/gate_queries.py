"""Queries of gates, census, snapshots and catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import classify, gates, reconcile, sync
from ..sources import tables
from ..sources.tables import table
from . import plural_queries
from .registry import ORACLES, query
from .token_queries import CLASSIFIED_SQL, classified_turns

# the snapshots differ by arithmetic: some rows go, some lose a word, some are renumbered
_SNAP = """
    p AS (SELECT 'src/' || source AS file, 'doc[' || doc_id || ']' AS path, lang AS surface, sha1(text)[:8] AS content_hash, sha1(text)[:6] AS dup_key FROM documents WHERE doc_id % 17 <> 3),
    c AS (SELECT 'src/' || source AS file, CASE WHEN doc_id % 13 = 5 THEN 'new/' ELSE '' END || 'doc[' || doc_id || ']' AS path, lang AS surface, CASE WHEN doc_id % 19 = 7 THEN sha1(text || '!')[:8] ELSE sha1(text)[:8] END AS content_hash, sha1(text)[:6] AS dup_key FROM documents WHERE doc_id % 23 <> 4),
    pk AS (SELECT *, file || '#' || path AS site_key FROM p), ck AS (SELECT *, file || '#' || path AS site_key FROM c)
"""


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha1("text").alias("h"), F.sha1(F.concat("text", F.lit("!"))).alias("h2"))
    file, path = F.concat(F.lit("src/"), F.col("source")), F.concat(F.lit("doc["), F.col("doc_id").cast("string"), F.lit("]"))
    path2 = F.concat(F.when(F.col("doc_id") % 13 == 5, "new/").otherwise(""), path)

    def snap(rows, path, h):
        return rows.select(identity.site_key(file, path).alias("site_key"), file.alias("file"), F.col("lang").alias("surface"), F.substring(h, 1, 8).alias("content_hash"), F.substring("h", 1, 6).alias("dup_key"))

    return snap(docs.filter("doc_id % 17 <> 3"), path, F.col("h")), snap(docs.filter("doc_id % 23 <> 4"), path2, F.when(F.col("doc_id") % 19 == 7, F.col("h2")).otherwise(F.col("h")))


@query(f"""
    WITH {_SNAP}, same AS (SELECT site_key FROM pk INTERSECT SELECT site_key FROM ck),
    pr AS (SELECT *, row_number() OVER (PARTITION BY file, surface, content_hash ORDER BY site_key) AS k FROM pk WHERE site_key NOT IN (FROM same)),
    cr AS (SELECT *, row_number() OVER (PARTITION BY file, surface, content_hash ORDER BY site_key) AS k FROM ck WHERE site_key NOT IN (FROM same))
    SELECT 'same' AS tier, site_key AS previous, site_key AS current FROM same UNION ALL
    SELECT 'moved', pr.site_key, cr.site_key FROM pr JOIN cr USING (file, surface, content_hash, k)""")
def reconcile_exact_tiers(spark, sf_dir):
    return reconcile.reconcile(*_snapshots(spark, sf_dir)).filter("tier in ('same', 'moved')")


@query()
def reconcile_tiers(spark, sf_dir):
    """All five tiers; the greedy one has no SQL and is held against brute force in tests."""
    return reconcile.reconcile(*_snapshots(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("n"))


def _turn_findings(spark, sf_dir):
    sites = classified_turns(spark, sf_dir).withColumn("file", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")))
    sites = sites.withColumn("site_key", F.concat("file", F.lit("#turn["), F.col("turn").cast("string"), F.lit("]")))
    return gates.g3_unadjudicated(sites).union(gates.g4_source_language(sites, "fr")).union(gates.g2_residual(sites))


_FINDINGS_SQL = f"""
    SELECT CASE WHEN verdict = 'needs-judgment' THEN 'G3' ELSE 'G4' END AS gate, CASE WHEN verdict = 'needs-judgment' THEN 'unadjudicated' ELSE 'source-language' END AS kind,
      'conv/' || conv_id AS file, 'conv/' || conv_id || '#turn[' || turn || ']' AS site_key, CASE WHEN verdict = 'needs-judgment' THEN coalesce(reason, 'no reason') ELSE 'still in fr' END AS message
    FROM ({CLASSIFIED_SQL}) WHERE verdict = 'needs-judgment' OR (verdict = 'translate' AND detected = 'fr' AND confidence >= 0.7)
"""


@query(f"""
    WITH g(gate, name) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in gates.GATES.items())}), f AS (SELECT gate, count(*) AS n FROM ({_FINDINGS_SQL}) GROUP BY gate)
    SELECT gate, name, coalesce(n, 0) AS n, n IS NULL AS ok FROM g LEFT JOIN f USING (gate)""")
def gate_summary(spark, sf_dir):
    return gates.summary(_turn_findings(spark, sf_dir), spark)


@query(f"SELECT gate, kind, file, site_key, message FROM ({_FINDINGS_SQL}) WHERE NOT (gate = 'G3' AND regexp_extract(site_key, '^conv/(\\d+)', 1)::INT % 3 = 0)")
def gate_findings_excused(spark, sf_dir):
    """Findings less those that the adjudication of a conversation excuses."""
    ex = table(spark, sf_dir, "conversations").filter("conv_id % 3 = 0").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("#turn["), F.col("turn").cast("string"), F.lit("]")).alias("site_key"))
    return gates.excused(_turn_findings(spark, sf_dir), ex)


@query(f"SELECT gate, kind, file, site_key, message FROM ({_FINDINGS_SQL}) WHERE regexp_extract(site_key, 'turn\\[(\\d+)', 1)::INT % 2 = 1")
def baseline_new_findings(spark, sf_dir):
    found = _turn_findings(spark, sf_dir)
    frozen = gates.fingerprints(found).filter(F.regexp_extract("site_key", r"turn\[(\d+)", 1).cast("int") % 2 == 0).select("fingerprint").distinct()
    return gates.new_findings(found, frozen)


@query("""
    WITH e AS (SELECT 'doc/' || (doc_id + CASE WHEN doc_id % 10 = 3 THEN 1000000 ELSE 0 END) || '#0' AS site_key, doc_id, CASE WHEN quality = 1 THEN 'brand' WHEN toxic = 1 THEN 'nonsense' END AS reason, CASE WHEN toxic = 0 THEN 'ruled' ELSE ' ' END AS j FROM labels),
    m AS (SELECT e.*, sha1(text)[:8] AS now, CASE WHEN e.doc_id % 5 = 0 THEN 'xxxxxxxx' ELSE sha1(text)[:8] END AS pinned FROM e LEFT JOIN documents d ON e.site_key = 'doc/' || d.doc_id || '#0')
    SELECT kind, count(*) AS n FROM (SELECT 'dangling' AS kind FROM m WHERE now IS NULL UNION ALL SELECT 'vocabulary' FROM m WHERE coalesce(reason, '') <> 'brand' UNION ALL SELECT 'justification' FROM m WHERE trim(j, ' ') = ''
      UNION ALL SELECT 'changed' FROM m WHERE now IS NOT NULL AND pinned <> now) GROUP BY kind""")
def exceptions_valid(spark, sf_dir):
    key = lambda c: F.concat(F.lit("doc/"), c.cast("string"), F.lit("#0"))
    docs = table(spark, sf_dir, "documents").select(key(F.col("doc_id")).alias("site_key"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.substring(F.sha1("text"), 1, 8).alias("content_hash"))
    moved = F.col("doc_id") + F.when(F.col("doc_id") % 10 == 3, 1_000_000).otherwise(0)
    ex = table(spark, sf_dir, "labels").select("doc_id", key(moved).alias("site_key"), F.when(F.col("quality") == 1, "brand").when(F.col("toxic") == 1, "nonsense").alias("reason"), F.when(F.col("toxic") == 0, "ruled").otherwise(" ").alias("justification"))
    pins = docs.select("site_key", F.col("content_hash").alias("h"))
    ex = ex.join(pins, "site_key", "left").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "xxxxxxxx").otherwise(F.col("h")))
    return gates.g5_exceptions(ex, docs).groupBy("kind").agg(F.count("*").alias("n"))


_PATHS_SQL = "SELECT 'd' || (doc_id % 9) || '/' || source || '/' || doc_id AS file, doc_id FROM documents"


@query(f"""
    SELECT bucket, coalesce(reason, 'none') AS reason, count(*) AS n FROM (SELECT
      CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'scanned' ELSE 'scanned-zero' END WHEN doc_id % 4 = 1 OR file LIKE 'd3/%' OR file LIKE 'd5/src2/%' THEN 'skipped' ELSE 'unaccounted' END AS bucket,
      CASE WHEN doc_id % 4 = 1 THEN 'binary-ext' WHEN file LIKE 'd3/%' THEN 'ignore-dir' WHEN file LIKE 'd5/src2/%' THEN 'gitignored' END AS reason FROM ({_PATHS_SQL})) GROUP BY ALL""")
def census_buckets(spark, sf_dir):
    return _census(spark, sf_dir).groupBy("bucket", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def _census(spark, sf_dir):
    file = F.concat(F.lit("d"), (F.col("doc_id") % 9).cast("string"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    tracked = table(spark, sf_dir, "documents").select("doc_id", file.alias("file"))
    dirs = spark.createDataFrame([("d3", "ignore-dir"), ("d5/src2", "gitignored")], "dir string, reason string")
    walked = tracked.filter("doc_id % 4 = 0").select("file", (F.col("doc_id") % 8 == 0).alias("has_text"))
    skipped = tracked.filter("doc_id % 4 = 1").select("file", F.lit("binary-ext").alias("reason"))
    return gates.census(tracked, walked, skipped, dirs)


@query(f"""
    SELECT 'G1' AS gate, 'unaccounted' AS kind, file, file || ' is in no bucket' AS message FROM ({_PATHS_SQL}) WHERE doc_id % 4 > 1 AND file NOT LIKE 'd3/%' AND file NOT LIKE 'd5/src2/%'""")
def gate_census(spark, sf_dir):
    """G1 over the census of documents as paths."""
    return gates.g1_census(_census(spark, sf_dir)).select("gate", "kind", "file", "message")


@query("SELECT 'G2' AS gate, 'residual' AS kind, 'conv/' || conv_id AS file, 'conv/' || conv_id || '#turn[' || turn || ']' AS site_key FROM conversations WHERE turn % 5 = 0")
def gate_residual(spark, sf_dir):
    """G2: what only the sweep has found stays unclassified, whatever its text says."""
    turns = tables.turn_sites(table(spark, sf_dir, "conversations")).withColumn("tier", F.when(F.col("turn") % 5 == 0, "sweep"))
    sites = turns.withColumn("site_key", F.concat("file", F.lit("#"), "path"))
    return gates.g2_residual(classify.classify(sites, "fr", "en")).select("gate", "kind", "file", "site_key")


@query(f"SELECT 'G7' AS gate, 'unclaimed-plural' AS kind, split_part(site_key, '#', 1) AS file, site_key, list_aggregate(signals, 'string_agg', ', ') AS message FROM ({ORACLES['plural_suspects']})")
def gate_plurals(spark, sf_dir):
    """G7 over the suspicions of the bundles, none of which a dialect claims here."""
    return gates.g7_plurals(plural_queries.plural_suspects(spark, sf_dir).withColumn("file", F.substring_index("site_key", "#", 1)))


@query("SELECT 'doc/' || d.doc_id AS file FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def unaccounted_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"))


@query("""
    WITH d AS (SELECT doc_id // 4 AS k, lang, 'k' || (doc_id // 4) || '.' || row_number() OVER (PARTITION BY doc_id // 4, lang ORDER BY doc_id) AS key, text || CASE WHEN doc_id % 3 = 0 THEN ' {0}' ELSE '' END AS value FROM documents),
    s AS (SELECT key, value AS src FROM d WHERE lang = 'en'), t AS (SELECT lang AS locale, key, CASE WHEN k % 6 = 0 THEN (SELECT any_value(src) FROM s WHERE s.key = d.key) END AS same, value FROM d WHERE lang <> 'en'),
    u AS (SELECT locale, key, coalesce(same, value) AS value FROM t), w AS (SELECT key, src, locale FROM s CROSS JOIN (SELECT DISTINCT locale FROM u)),
    m AS (SELECT coalesce(w.locale, u.locale) AS locale, coalesce(w.key, u.key) AS key, src, value FROM w FULL JOIN u ON w.key = u.key AND w.locale = u.locale)
    SELECT locale, class, count(*) AS n FROM (SELECT locale, CASE WHEN src IS NULL THEN 'orphan' WHEN value IS NULL THEN 'missing'
      WHEN list_sort(list_distinct(regexp_extract_all(src, '\\{\\d+\\}|\\{\\{\\w+\\}\\}|%[sd@]|\\{\\w+\\}'))) <> list_sort(list_distinct(regexp_extract_all(value, '\\{\\d+\\}|\\{\\{\\w+\\}\\}|%[sd@]|\\{\\w+\\}'))) THEN 'arity-mismatch'
      WHEN regexp_extract(key, '^k(\\d+)', 1)::INT % 7 = 0 THEN 'stale' WHEN src = value AND regexp_matches(src, '\\p{L}{2,}') THEN 'untranslated' ELSE 'ok' END AS class FROM m) GROUP BY ALL""")
def catalog_sync_diff(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " {0}").otherwise(""))
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("k"), "lang", "doc_id", text.alias("value"))
    number = F.row_number().over(Window.partitionBy("k", "lang").orderBy("doc_id"))  # four rows at most
    rows = docs.select("k", "lang", F.concat(F.lit("k"), F.col("k").cast("string"), F.lit("."), number.cast("string")).alias("key"), "value")
    source = rows.filter("lang = 'en'").select("key", "value")
    copied = source.select("key", F.col("value").alias("src"))
    targets = rows.filter("lang <> 'en'").join(copied, "key", "left").select(F.col("lang").alias("locale"), "key", F.when(F.col("k") % 6 == 0, F.coalesce("src", "value")).otherwise(F.col("value")).alias("value"), F.lit(False).alias("cognate"))
    stale = targets.filter(F.regexp_extract("key", r"^k(\d+)", 1).cast("int") % 7 == 0).select("locale", "key", F.lit("0" * 16).alias("src_hash"))
    locales = targets.select("locale").distinct()  # a row a locale
    return sync.diff(source, targets, locales, stale).groupBy("locale", "class").agg(F.count("*").alias("n"))


@query("SELECT 'very-long-file' AS advisory, count(*) AS n FROM documents WHERE n_chars > 20000 UNION ALL SELECT 'repeated-text', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'no-sites', count(*) FROM documents WHERE NOT regexp_matches(text, '\\p{L}{2,}')")
def advisories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = (
        ("very-long-file", docs.filter("n_chars > 20000").agg(F.count("*").alias("n"))),
        ("repeated-text", docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n"))),
        ("no-sites", docs.filter(~F.col("text").rlike(r"\p{L}{2,}")).agg(F.count("*").alias("n"))),
    )
    rows = [df.select(F.lit(name).alias("advisory"), "n") for name, df in counts]
    return rows[0].union(rows[1]).union(rows[2])
