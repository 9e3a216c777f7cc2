"""Queries of plural families over bundles built from small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cldr
from ..functions.vocab import PLURAL_ORDER
from ..operators import plural
from ..sources.tables import table
from .registry import query

LOCALES = ("en", "fr-FR", "ru", "ja", "ar")
# one key for each nation, locale and category, but for some that arithmetic leaves out
_BUNDLE_SQL = f"""
    SELECT 'locales/' || l.locale || '.json' AS file, l.locale, CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_name || '_' || c.category ELSE '/' || n_name || '/' || c.category END AS path, n_name || ' {{count}} ' || c.category AS value
    FROM nation, (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(LOCALES))}) l(locale, li), (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(PLURAL_ORDER))}) c(category, ci)
    WHERE (n_nationkey + li + ci) % 4 <> 1
"""
_S, _C = plural.KEY_SUFFIX.replace("'", "''"), plural.KEY_CHILD
_SPLIT_SQL = f"""
    SELECT file, locale, path, CASE WHEN regexp_matches(path, '{_C}') THEN regexp_extract(path, '{_C}', 1) WHEN regexp_matches(path, '{_S}') THEN regexp_extract(path, '{_S}', 1) END AS base,
      CASE WHEN regexp_matches(path, '{_C}') THEN regexp_extract(path, '{_C}', 2) WHEN regexp_matches(path, '{_S}') THEN CASE regexp_extract(path, '{_S}', 2) WHEN 'singular' THEN 'one' WHEN 'plural' THEN 'other' ELSE regexp_extract(path, '{_S}', 2) END END AS category
    FROM ({_BUNDLE_SQL})
"""
CLDR_SQL = "(VALUES " + ", ".join(f"('{k}', [{', '.join(repr(c) for c in v)}])" for k, v in cldr.BY_LANGUAGE.items()) + ") r(lang, required)"


def _bundle(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    locales = spark.createDataFrame([(x, i) for i, x in enumerate(LOCALES)], "locale string, li int")
    categories = spark.createDataFrame([(x, i) for i, x in enumerate(PLURAL_ORDER)], "category string, ci int")
    rows = nation.join(F.broadcast(locales)).join(F.broadcast(categories)).filter("(n_nationkey + li + ci) % 4 <> 1")  # a bundle is every locale and category of a key
    path = F.concat(F.lit("/"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "_").otherwise("/"), F.col("category"))
    return rows.select(F.concat(F.lit("locales/"), F.col("locale"), F.lit(".json")).alias("file"), "locale", path.alias("path"), F.concat("n_name", F.lit(" {count} "), F.col("category")).alias("value"))


@query(_SPLIT_SQL)
def plural_key_split(spark, sf_dir):
    base, category = plural.split_key(F.col("path"))
    return _bundle(spark, sf_dir).select("file", "locale", "path", base.alias("base"), category.alias("category"))


_ORDER = "[" + ", ".join(repr(c) for c in PLURAL_ORDER) + "]"


@query(f"""
    WITH f AS (SELECT file, locale, base, list(DISTINCT category) AS have, count(*) AS n FROM ({_SPLIT_SQL}) WHERE base IS NOT NULL GROUP BY ALL),
    o AS (SELECT file, locale, base, list_filter({_ORDER}, lambda c: list_contains(have, c)) AS categories, n FROM f)
    SELECT o.*, list_filter(required, lambda c: NOT list_contains(categories, c)) AS missing, list_filter(categories, lambda c: NOT list_contains(required, c)) AS extra
    FROM o LEFT JOIN {CLDR_SQL} ON r.lang = lower(regexp_extract(locale, '^([A-Za-z]+)', 1))""")
def plural_missing_extra(spark, sf_dir):
    return plural.completeness(plural.families(_bundle(spark, sf_dir)), cldr.table(spark))


_VALUES = ["{n} item | {n} items", "%d file |||| %d files", "a | b", "one | two | three {x}", "no pipe {n}", "{0} | {1}", "none | one {n} car | {n} cars", "x {n} yy | zz | ww | vv"]


@query("""
    WITH v(value) AS (VALUES """ + ", ".join("('" + x + "')" for x in _VALUES) + """),
    p AS (SELECT value, list_transform(string_split(value, CASE WHEN value LIKE '%||||%' THEN '||||' ELSE '|' END), lambda x: trim(x, ' ')) AS parts FROM v)
    SELECT value, CASE WHEN regexp_matches(value, '\\d|\\{[^}]*\\}|%[sd@]|%\\{|#') AND value LIKE '%|%' AND len(parts) BETWEEN 2 AND 3 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '\\p{L}{2,}'))) = 0
      THEN array_to_string(list_transform(parts, lambda x, i: CASE len(parts) WHEN 2 THEN ['one', 'other'][i] ELSE ['one', 'few', 'other'][i] END || '=' || x), ';') END AS forms FROM p""")
def plural_value_split(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in _VALUES], "value string")
    forms = F.transform(plural.value_split(F.col("value")), lambda x: F.concat(x["category"], F.lit("="), x["text"]))
    return rows.select("value", F.when(forms.isNotNull(), F.array_join(forms, ";")).alias("forms"))


@query(f"""
    WITH s AS (SELECT locale AS file, n_nationkey % 5 AS parent, locale || '#' || path AS site_key, left(n_name, 4 + (li + ci) % 4) || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' {{n}} ' || left(n_name, 4 + (li + ci) % 4) END AS value
      FROM (SELECT *, '/' || n_name || '/' || category AS path FROM nation, (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(LOCALES))}) l(locale, li), (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(PLURAL_ORDER))}) c(category, ci)))
    SELECT a.site_key AS shorter, b.site_key AS longer FROM s a JOIN s b ON a.file = b.file AND a.parent = b.parent AND b.value LIKE a.value || '%' AND length(b.value) - length(a.value) BETWEEN 1 AND 3
    WHERE length(a.value) >= 3 AND regexp_matches(substr(b.value, length(a.value) + 1), '^\\p{{L}}+$') AND (regexp_matches(a.value, '\\d|\\{{[^}}]*\\}}|%[sd@]|%\\{{|#') OR regexp_matches(b.value, '\\d|\\{{[^}}]*\\}}|%[sd@]|%\\{{|#'))""")
def plural_suffix_pairs(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    locales = spark.createDataFrame([(x, i) for i, x in enumerate(LOCALES)], "file string, li int")
    categories = spark.createDataFrame([(x, i) for i, x in enumerate(PLURAL_ORDER)], "category string, ci int")
    rows = nation.join(F.broadcast(locales)).join(F.broadcast(categories))
    stem = F.expr("left(n_name, 4 + (li + ci) % 4)")
    value = F.concat(stem, F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit(" {n} "), stem)))
    sites = rows.select("file", (F.col("n_nationkey") % 5).alias("parent"), F.concat("file", F.lit("#/"), F.col("n_name"), F.lit("/"), F.col("category")).alias("site_key"), value.alias("value"))
    return plural.suffix_pairs(sites)


_CANDIDATES = """
    SELECT d.dialect, d.precedence, d.dialect || ':' || (n_nationkey // d.width) AS family, n_nationkey AS site FROM nation,
      (VALUES ('icu', 10, 3, 4), ('android', 20, 2, 3), ('i18next', 30, 4, 1)) d(dialect, precedence, width, every) WHERE n_nationkey % d.every <> 1 OR d.every = 1
"""


@query(f"""
    WITH c AS ({_CANDIDATES}), w AS (SELECT site, min(precedence) AS best FROM c GROUP BY site)
    SELECT dialect, precedence, family, count(*) AS sites FROM c JOIN w USING (site) GROUP BY ALL HAVING bool_and(precedence = best)""")
def plural_claim_precedence(spark, sf_dir):
    dialects = spark.createDataFrame([("icu", 10, 3, 4), ("android", 20, 2, 3), ("i18next", 30, 4, 1)], "dialect string, precedence int, width int, every int")
    rows = table(spark, sf_dir, "nation").join(F.broadcast(dialects)).filter("n_nationkey % every <> 1 or every = 1")
    family = F.concat("dialect", F.lit(":"), F.floor(F.col("n_nationkey") / F.col("width")).cast("string"))
    return plural.claims(rows.select("dialect", "precedence", family.alias("family"), F.col("n_nationkey").alias("site")))


@query(f"""
    SELECT locale || '#' || path AS site_key, ['category-key'] AS signals FROM ({_BUNDLE_SQL}) WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?:^|[_.\\-/\\[])({'|'.join(PLURAL_ORDER)}|singular|plural)\\]?$')""")
def plural_suspects(spark, sf_dir):
    sites = _bundle(spark, sf_dir).select(F.concat("locale", F.lit("#"), F.col("path")).alias("site_key"), "file", F.col("path").alias("parent"), "path", "value")
    return plural.suspicions(sites)


@query(f"SELECT lang, array_to_string(required, ' ') AS categories, len(required)::BIGINT AS n FROM {CLDR_SQL}")
def plural_categories(spark, sf_dir):
    return cldr.table(spark).select("lang", F.array_join("required", " ").alias("categories"), F.size("required").cast("long").alias("n"))


_ENDINGS = ("", "s", "es", "!", "-en")


@query(f"""
    WITH s AS (SELECT DISTINCT p_type AS file, p_brand AS parent, p_type || '/' || p_brand || '/' || p_name || x AS site_key, CASE WHEN p_size % 2 = 0 THEN '{{n}} ' ELSE '' END || p_name || x AS value FROM part, (VALUES {', '.join(f"('{x}')" for x in _ENDINGS)}) e(x))
    SELECT a.site_key AS shorter, b.site_key AS longer FROM s a JOIN s b ON a.file = b.file AND a.parent = b.parent AND starts_with(b.value, a.value) AND length(b.value) - length(a.value) BETWEEN 1 AND 3
    WHERE regexp_matches(substr(b.value, length(a.value) + 1), '^\\p{{L}}+$') AND (contains(a.value, '{{n}}') OR contains(b.value, '{{n}}'))""")
def plural_suffix_siblings(spark, sf_dir):
    """Names of parts with endings, of one type and brand, of which one is the other with a few letters more, and one counts."""
    ends = F.explode(F.array(*map(F.lit, _ENDINGS))).alias("x")
    part = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_name", "p_size", ends)
    value = F.concat(F.when(F.col("p_size") % 2 == 0, "{n} ").otherwise(""), "p_name", "x")
    sites = part.select(F.col("p_type").alias("file"), F.col("p_brand").alias("parent"), F.concat_ws("/", "p_type", "p_brand", F.concat("p_name", "x")).alias("site_key"), value.alias("value"))
    return plural.suffix_pairs(sites.distinct())
