"""Queries of the joins by containment: lines in intervals, rulings over groups, names in texts, sets in sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import PLURAL_ORDER
from ..operators import audit, passages, plan, plural
from ..sources import tables
from ..sources.tables import table
from .registry import query
from .site_queries import LINES_SQL, doc_lines

# Six arithmetic sites a document, on its lines; verdicts in turn.
_VERDICTS = ("translate", "do-not-translate", "needs-judgment", "locale-marker", "unclassified", "do-not-translate")
_LIST = "[" + ", ".join(f"'{v}'" for v in _VERDICTS) + "]"
_SITES_SQL = f"""
    SELECT 'doc/' || doc_id AS file, h * 7919 % n + 1 AS line, h * 7919 % n + 1 + h * 104729 % 5 AS end_line, {_LIST}[k] AS verdict
    FROM (SELECT doc_id, n, k, k * (doc_id + 3) AS h FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(range(1, 7)) AS k FROM documents WHERE text <> ''))
"""


@query(f"""
    WITH l AS ({LINES_SQL}), s AS ({_SITES_SQL}),
    c AS (SELECT 'doc/' || doc_id AS file, CASE WHEN doc_id % 11 = 0 THEN 'skipped' ELSE 'read' END AS bucket, doc_id % 3 = 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS asserted FROM documents WHERE doc_id % 13 <> 0),
    v AS (SELECT l.file, l.line, length(l.value) > 80 AS strong, (SELECT list(DISTINCT verdict) FROM s WHERE s.file = l.file AND s.line <= l.line AND l.line <= s.end_line) AS v FROM l)
    SELECT file, line, CASE WHEN v IS NULL THEN CASE WHEN bucket IS NULL OR bucket = 'skipped' THEN 'explained-skip' WHEN asserted AND strong THEN 'confirmed-miss' ELSE 'candidate' END
      WHEN list_contains(v, 'translate') OR list_contains(v, 'locale-marker') THEN 'claimed' WHEN list_contains(v, 'do-not-translate') THEN 'protected' WHEN list_contains(v, 'needs-judgment') THEN 'refused' ELSE 'surfaced' END AS bucket
    FROM v LEFT JOIN c USING (file)""")
def line_buckets(spark, sf_dir):
    """Every line of a document as a hit, against sites by line containment and the census."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    h = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).withColumn("h", F.col("k") * (F.col("doc_id") + 3))
    line = F.col("h") * 7919 % F.col("n") + 1
    sites = h.select(tables.document_file().alias("file"), line.alias("line"), (line + F.col("h") * 104729 % 5).alias("end_line"), F.get(F.array(*map(F.lit, _VERDICTS)), F.col("k") - 1).alias("verdict"))
    d = F.col("doc_id")
    census = table(spark, sf_dir, "documents").filter(d % 13 != 0).select(
        tables.document_file().alias("file"),
        F.when(d % 11 == 0, "skipped").otherwise("read").alias("bucket"),
        F.when(d % 3 == 0, 1.0).otherwise(0.5).alias("claim_ratio"),
        (d % 7 != 0).alias("byte_addressable"),
        F.when(d % 5 == 0, "residual-sweep").otherwise("markdown").alias("extractor"),
    )
    hits = doc_lines(spark, sf_dir).select("file", "line", F.when(F.length("value") > 80, "strong").otherwise("weak").alias("confidence"))
    return audit.hit_buckets(hits, sites, census).select("file", "line", "bucket")


def _ruled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    ruled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    ruled = ruled.select(F.col("doc_id").alias("site_key"), F.when(F.col("toxic") == 1, "changed").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("quality") == 0, "exclude").otherwise("keep").alias("verdict"))
    members = docs.select(F.col("content_hash").alias("group"), F.col("doc_id").alias("site_key"))
    return plan.rulings(members, docs.select(F.col("doc_id").alias("site_key"), "content_hash"), ruled)


_RULED_SQL = """
    SELECT "group", site_key, given AND NOT changed AS held, given AND changed AS stale, excluded FROM (SELECT sha256(coalesce(text, '')) AS "group", d.doc_id AS site_key, l.doc_id IS NOT NULL AS given, coalesce(toxic = 1, false) AS changed, coalesce(quality = 0, false) AS excluded
      FROM documents d LEFT JOIN labels l USING (doc_id))
"""
_STATUS_SQL = f"""
    SELECT "group", CASE WHEN NOT bool_and(held) THEN 'open' WHEN bool_and(excluded) THEN 'all-excluded' ELSE 'resolved' END AS status, count(*) AS n, sum(stale::INT)::BIGINT AS stale FROM ({_RULED_SQL}) GROUP BY "group"
"""


@query(_STATUS_SQL)
def group_rulings(spark, sf_dir):
    """Groups of equal documents, decided where every copy is ruled on as it is now; labels are the rulings."""
    return _ruled(spark, sf_dir)[0]


@query(f"""SELECT "group", site_key FROM ({_RULED_SQL}) JOIN ({_STATUS_SQL}) USING ("group") WHERE status = 'open' OR NOT excluded""")
def group_rulings_members(spark, sf_dir):
    return _ruled(spark, sf_dir)[1]


@query(f"""
    WITH t AS (SELECT DISTINCT 'nav' || x AS target, substring(x, 2) AS name FROM (SELECT unnest(regexp_extract_all(html, '<a href="(/[^"/]{{9,}})"', 1)) AS x FROM pages))
    SELECT target, l.file || '.md' AS file, line FROM ({LINES_SQL}) l JOIN t ON contains(l.value, t.name)""")
def path_referrers(spark, sf_dir):
    """Lines of documents that name a target of the pages' links, of nine letters or more."""
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"/]{9,})"'), F.lit(1))).alias("x"))
    files = table(spark, sf_dir, "documents").select(F.concat(tables.document_file(), F.lit(".md")).alias("file"), "text")
    return passages.referrers(files, links.select(F.concat(F.lit("nav"), "x").alias("target")))


_TARGETS = (("one", "other"), ("one", "few", "many", "other"), ("other",))
_TARGETS_SQL = "CASE length(p_name) % 3 " + " ".join(f"WHEN {i} THEN [{', '.join(repr(c) for c in t)}]" for i, t in enumerate(_TARGETS)) + " END"
_ORDER_SQL = "[" + ", ".join(repr(c) for c in PLURAL_ORDER) + "]"


@query(f"""
    WITH forms AS (SELECT DISTINCT p_brand || '/' || p_name AS family, p_brand AS file, {_ORDER_SQL}[p_size % 6 + 1] AS category FROM part),
    asked AS (SELECT DISTINCT p_brand || '/' || p_name || x AS family, p_brand AS file, {_TARGETS_SQL} AS targets FROM part, (VALUES (''), ('#old')) v(x)),
    claims AS (SELECT family FROM asked WHERE length(family) % 2 = 0 UNION ALL SELECT family FROM asked WHERE length(family) % 5 = 0 UNION ALL SELECT DISTINCT 'stray/' || p_brand FROM part),
    c AS (SELECT family, count(*) AS claims FROM claims GROUP BY family),
    sets AS (SELECT family, file, list(category) AS have FROM forms GROUP BY ALL),
    a AS (SELECT a.family, s.family IS NOT NULL AS there, CASE WHEN s.family IS NOT NULL THEN list_has_all(s.have, targets) ELSE EXISTS (SELECT 1 FROM sets o WHERE o.file = a.file AND list_has_all(o.have, targets)) END AS found
      FROM asked a LEFT JOIN sets s ON s.family = a.family),
    w AS (SELECT family, coalesce(claims, 0) AS claims, CASE WHEN a.found IS NULL THEN 'not handed out' WHEN claims IS NULL THEN 'unclaimed' WHEN claims > 1 THEN 'claimed twice' WHEN found THEN NULL WHEN there THEN 'forms are missing' ELSE 'not seen again' END AS why FROM a FULL JOIN c USING (family))
    SELECT family, claims, why IS NULL AS ok, why FROM w""")
def plural_claims_verified(spark, sf_dir):
    """Families of parts by brand; those handed out as they are and those whose key has gone."""
    part = table(spark, sf_dir, "part")
    family = F.concat("p_brand", F.lit("/"), "p_name")
    forms = part.select(family.alias("family"), F.col("p_brand").alias("file"), F.get(F.array(*map(F.lit, PLURAL_ORDER)), F.col("p_size") % 6).alias("category"))
    targets = F.get(F.array(*(F.array(*map(F.lit, t)) for t in _TARGETS)), F.length("p_name") % 3)
    asked = part.select(F.explode(F.array(family, F.concat(family, F.lit("#old")))).alias("family"), F.col("p_brand").alias("file"), targets.alias("targets")).distinct()
    claims = asked.filter(F.length("family") % 2 == 0).select("family").union(asked.filter(F.length("family") % 5 == 0).select("family")).union(part.select(F.concat(F.lit("stray/"), "p_brand")).distinct())
    return plural.verify_claims(claims, asked, forms)
