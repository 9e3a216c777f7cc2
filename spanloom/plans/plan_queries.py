"""Queries of planning, batching and validation over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import plan, validate
from ..sources.tables import table
from .registry import query
from .site_queries import collapsed_sql

# Sites of the plan: every turn, and every line of every document that isn't blank; the role tells verdict and reason.
_SITES_SQL = """
    SELECT 'conv/' || conv_id || '#turn[' || turn || ']' AS site_key, text AS value, role FROM conversations
    UNION ALL SELECT 'doc/' || doc_id || '#' || i, value, CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 11 = 0 THEN 'enum' ELSE 'doc' END
      FROM (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(value, ' ') <> ''
"""
_RULED_SQL = f"""
    SELECT *, regexp_matches(value, '\\d') AS has_holes, value LIKE '%|%' AS grammar_hole, {collapsed_sql('value')} AS norm,
      CASE WHEN role IN ('test', 'enum') THEN 'do-not-translate' ELSE 'translate' END AS verdict,
      CASE role WHEN 'test' THEN 'test-fixture' WHEN 'enum' THEN 'enum-member' END AS reason,
      CASE WHEN role = 'user' THEN 'ui-short' WHEN role = 'doc' THEN 'doc' ELSE 'ui-long' END AS role_class FROM ({_SITES_SQL})
"""
GROUPS_SQL = f"""
    WITH s AS ({_RULED_SQL}), t AS (SELECT *, sha256(norm || chr(0) || role_class || chr(0) || CASE WHEN has_holes THEN 'holes' ELSE 'plain' END) AS key FROM s),
    g AS (SELECT key, norm, role_class, arg_min(value, site_key) AS text, count(*) AS sites, bool_or(grammar_hole) AS grammar FROM t WHERE verdict = 'translate' GROUP BY ALL),
    c AS (SELECT DISTINCT norm FROM s WHERE reason = 'enum-member')
    SELECT 'g_' || key[:12] AS id, text, role_class, CASE WHEN grammar THEN 'structural' WHEN c.norm IS NOT NULL THEN 'hazard' ELSE 'pending' END AS status,
      CASE WHEN role_class = 'ui-short' THEN (ceil(length(text) * 1.35::DOUBLE) + 4)::BIGINT END AS max, sites, g.norm FROM g LEFT JOIN c ON g.norm = c.norm
"""


def _sites(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("#turn["), F.col("turn").cast("string"), F.lit("]")).alias("site_key"), F.col("text").alias("value"), "role")
    kind = F.when(F.col("doc_id") % 7 == 0, "test").when(F.col("doc_id") % 11 == 0, "enum").otherwise("doc")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value")).filter(F.trim("value") != "")
    docs = lines.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("#"), F.col("i").cast("string")).alias("site_key"), "value", kind.alias("role"))
    rows = turns.union(docs)
    return rows.select(
        "site_key",
        "value",
        F.when(F.col("role") == "user", "button").when(F.col("role") == "doc", "doc-prose").otherwise("paragraph").alias("role"),
        F.when(F.col("role").isin("test", "enum"), "do-not-translate").otherwise("translate").alias("verdict"),
        F.when(F.col("role") == "test", "test-fixture").when(F.col("role") == "enum", "enum-member").alias("reason"),
        F.col("value").rlike(r"\d").alias("has_holes"),
        F.col("value").contains("|").alias("grammar_hole"),
    )


def _groups(spark, sf_dir):
    return plan.groups(_sites(spark, sf_dir))


@query(GROUPS_SQL)
def plan_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(f"SELECT id, text FROM ({GROUPS_SQL}) WHERE status = 'hazard'")
def plan_hazards(spark, sf_dir):
    return _groups(spark, sf_dir).filter("status = 'hazard'").select("id", "text")


@query(f"SELECT status, role_class, count(*) AS n, sum(sites)::BIGINT AS sites FROM ({GROUPS_SQL}) GROUP BY ALL")
def plan_counts(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("status", "role_class").agg(F.count("*").alias("n"), F.sum("sites").alias("sites"))


@query(f"SELECT s.site_key, max(g.id) AS group_id FROM ({_RULED_SQL}) s JOIN ({GROUPS_SQL}) g USING (norm) WHERE s.reason = 'test-fixture' GROUP BY s.site_key")
def plan_mirrors(spark, sf_dir):
    return plan.mirrors(_sites(spark, sf_dir), _groups(spark, sf_dir))


@query(f"SELECT site_key, value FROM ({_RULED_SQL}) WHERE reason = 'test-fixture' AND (regexp_matches(value, '\\p{{L}}{{2,}}\\s+\\p{{L}}{{2,}}') OR length(value) >= 8) AND norm NOT IN (SELECT norm FROM ({GROUPS_SQL}))")
def plan_unlinked(spark, sf_dir):
    return plan.unlinked(_sites(spark, sf_dir), _groups(spark, sf_dir))


_BATCHED = f"SELECT *, (row_number() OVER (ORDER BY id) - 1) // 8 AS batch FROM ({GROUPS_SQL}) WHERE status = 'pending'"


@query(f"""
    SELECT printf('%03d', batch) AS batch_id, sha256(string_agg(id || chr(1) || text || chr(1) || coalesce(max::VARCHAR, ''), chr(2) ORDER BY id))[:16] AS digest, count(*) AS n_items, list(id ORDER BY id) AS ids
    FROM ({_BATCHED}) GROUP BY batch""")
def batches_digest(spark, sf_dir):
    return plan.batches(_groups(spark, sf_dir))


@query(f"""
    WITH t AS (SELECT DISTINCT lower(term) AS word, term FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS term FROM benchmark) WHERE length(term) >= 6),
    w AS (SELECT DISTINCT batch, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM ({_BATCHED})),
    r AS (SELECT batch, term, row_number() OVER (PARTITION BY batch ORDER BY term) AS k FROM (SELECT DISTINCT batch, term FROM w JOIN t USING (word)))
    SELECT batch::BIGINT AS batch_id, term FROM r WHERE k <= 25""")
def glossary_slice(spark, sf_dir):
    items = plan.ranked(_groups(spark, sf_dir).filter("status = 'pending'"), "id").select(F.floor(F.col("position") / plan.BATCH).alias("batch_id"), "text")
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("term")).filter(F.length("term") >= 6).distinct()
    return plan.glossary_slices(items, terms)


# Pairs: a user's turn and the next one; every third turn gets a placeholder, a brace or a backtick.
_PAIRS_SQL = """
    WITH a AS (SELECT conv_id, turn, role, text || CASE turn % 3 WHEN 0 THEN ' {0}' WHEN 1 THEN ' {0} {1}' ELSE '' END || CASE WHEN conv_id % 5 = 0 AND turn % 2 = 1 THEN ' `x` ${y}' WHEN conv_id % 7 = 0 AND turn % 2 = 1 THEN ' {O} ' ELSE '' END AS t FROM conversations),
    p AS (SELECT u.conv_id, u.turn, u.t AS source, CASE WHEN u.conv_id % 9 = 0 THEN u.t WHEN u.conv_id % 13 = 0 THEN ' ' ELSE v.t END AS translation, (ceil(length(u.t) * 1.35::DOUBLE) + 4)::BIGINT AS max FROM a u JOIN a v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user')
"""


def _pairs(spark, sf_dir):
    t = F.concat(
        F.col("text"),
        F.when(F.col("turn") % 3 == 0, " {0}").when(F.col("turn") % 3 == 1, " {0} {1}").otherwise(""),
        F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") % 2 == 1), " `x` ${y}").when((F.col("conv_id") % 7 == 0) & (F.col("turn") % 2 == 1), " {O} ").otherwise(""),
    )
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("t"))
    nxt = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("n"))
    met = a.filter("role = 'user'").join(nxt, ["conv_id", "turn"])
    translation = F.when(F.col("conv_id") % 9 == 0, F.col("t")).when(F.col("conv_id") % 13 == 0, F.lit(" ")).otherwise(F.col("n"))
    return met.select("conv_id", "turn", F.col("t").alias("source"), translation.alias("translation"), (F.ceil(F.length("t") * 1.35) + 4).cast("long").alias("max"))


_H = r"'\{(\d+)\}'"


@query(_PAIRS_SQL + f"""
    , h AS (SELECT conv_id, turn, unnest(list_distinct(list_concat(regexp_extract_all(source, {_H}, 1), regexp_extract_all(translation, {_H}, 1)))) AS i, regexp_extract_all(source, {_H}, 1) AS s, regexp_extract_all(translation, {_H}, 1) AS t FROM p),
    c AS (SELECT conv_id, turn, i, len(list_filter(s, lambda x: x = i)) AS want, len(list_filter(t, lambda x: x = i)) AS have FROM h)
    SELECT conv_id, turn, CASE WHEN want = 0 THEN 'placeholder {{' || i || '}} was invented' WHEN have = 0 THEN 'placeholder {{' || i || '}} was dropped' ELSE 'placeholder {{' || i || '}} appears ' || have || ' time(s), source has ' || want END AS message FROM c WHERE want <> have""")
def validate_placeholders(spark, sf_dir):
    return validate.violations(_pairs(spark, sf_dir), ["conv_id", "turn"]).filter("validator = 'V1'").select("conv_id", "turn", "message")


_SKELETON = lambda c: f"regexp_replace(regexp_replace({c}, {_H}, '', 'g'), '[^{{}}]', '', 'g')"


@query(_PAIRS_SQL + f"SELECT conv_id, turn FROM p WHERE {_SKELETON('source')} <> {_SKELETON('translation')}")
def validate_braces(spark, sf_dir):
    return validate.violations(_pairs(spark, sf_dir), ["conv_id", "turn"]).filter("validator = 'V2'").select("conv_id", "turn")


@query(_PAIRS_SQL + """
    SELECT conv_id, turn, 'the translation introduced a JavaScript interpolation' AS message FROM p WHERE translation LIKE '%${%' AND source NOT LIKE '%${%'
    UNION ALL SELECT conv_id, turn, 'the translation introduced a backtick' FROM p WHERE translation LIKE '%`%' AND source NOT LIKE '%`%'""")
def validate_leak(spark, sf_dir):
    return validate.violations(_pairs(spark, sf_dir), ["conv_id", "turn"]).filter("validator = 'V3'").select("conv_id", "turn", "message")


@query(_PAIRS_SQL + "SELECT conv_id, turn, length(translation) || ' characters exceeds the ' || max || ' available' AS message FROM p WHERE length(translation) > max")
def validate_length(spark, sf_dir):
    return validate.violations(_pairs(spark, sf_dir), ["conv_id", "turn"]).filter("validator = 'V5'").select("conv_id", "turn", "message")


@query(_PAIRS_SQL + f"SELECT conv_id, turn FROM p WHERE source = translation AND regexp_matches(source, '\\p{{L}}{{2,}}') AND length(trim(regexp_replace(source, {_H}, '', 'g'), ' ')) >= 3")
def validate_identical(spark, sf_dir):
    return validate.violations(_pairs(spark, sf_dir), ["conv_id", "turn"]).filter("validator = 'V4'").select("conv_id", "turn")


@query(_PAIRS_SQL + """
    SELECT 'empty' AS what, count(*) AS n FROM p WHERE trim(translation, ' ') = '' AND trim(source, ' ') <> ''
    UNION ALL SELECT 'space', count(*) FROM p WHERE translation <> trim(translation, ' ') AND source = trim(source, ' ')
    UNION ALL SELECT 'break', count(*) FROM p WHERE translation LIKE '%' || chr(10) || '%' AND source NOT LIKE '%' || chr(10) || '%'""")
def validate_whitespace(spark, sf_dir):
    v = validate.violations(_pairs(spark, sf_dir), ["conv_id", "turn"]).filter("validator = 'V6'")
    what = F.when(F.col("message").endswith("empty"), "empty").when(F.col("message").endswith("whitespace"), "space").otherwise("break")
    counts = v.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("empty",), ("space",), ("break",)], "what string")
    return kinds.join(counts, "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""
    WITH g AS ({GROUPS_SQL}), a AS (SELECT id, CASE WHEN sites % 5 = 0 THEN NULL ELSE text END AS text, CASE WHEN ascii(substr(id, 3, 1)) % 4 = 0 THEN 'no' END AS refuse FROM g WHERE ascii(substr(id, 14, 1)) % 8 <> 1 UNION ALL SELECT 'g_unknown', 'x', NULL)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN g.id IS NULL THEN 'unknown' WHEN a.id IS NULL THEN 'missing' WHEN refuse IS NOT NULL THEN 'refused' WHEN a.text IS NULL OR (g.max IS NOT NULL AND length(a.text) > g.max) THEN 'rejected' ELSE 'accepted' END AS outcome FROM g FULL JOIN a USING (id)) GROUP BY outcome""")
def fold_report(spark, sf_dir):
    g = _groups(spark, sf_dir)
    some = g.filter(F.ascii(F.substring("id", 14, 1)) % 8 != 1)
    answers = some.select("id", F.when(F.col("sites") % 5 != 0, F.col("text")).alias("text"), F.when(F.ascii(F.substring("id", 3, 1)) % 4 == 0, "no").alias("refuse"))
    answers = answers.union(spark.sql("select 'g_unknown', 'x', cast(null as string)"))
    pairs = some.select("id", F.col("text").alias("source"), F.col("text").alias("translation"), "max")
    return plan.fold(g, answers, validate.violations(pairs, ["id"])).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM ({GROUPS_SQL})) WHERE k % 10 = 0")
def review_sample(spark, sf_dir):
    """Every tenth group by id: a sampling operator."""
    return plan.ranked(_groups(spark, sf_dir), "id").filter("position % 10 = 0").select("id")


@query("SELECT conv_id, list(DISTINCT p ORDER BY p) AS placeholders FROM (SELECT conv_id, unnest(regexp_extract_all(text || CASE turn % 3 WHEN 0 THEN ' {0} {{count}}' ELSE ' %s' END, '\\{\\{\\s*[\\w.]+\\s*\\}\\}|\\{\\d+\\}|\\{[\\w.]+\\}|%\\{[\\w.]+\\}|%\\d*\\$?[sd@]|#')) AS p FROM conversations) GROUP BY conv_id")
def placeholder_sets(spark, sf_dir):
    marks = r"\{\{\s*[\w.]+\s*\}\}|\{\d+\}|\{[\w.]+\}|%\{[\w.]+\}|%\d*\$?[sd@]|#"
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " {0} {{count}}").otherwise(" %s"))
    found = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(text, F.lit(marks), F.lit(0))).alias("p"))
    return found.groupBy("conv_id").agg(F.array_sort(F.collect_set("p")).alias("placeholders"))
