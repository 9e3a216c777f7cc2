"""Queries of selections: documents as decided sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select
from ..sources.tables import table
from .registry import query

_V = ("translate", "do-not-translate", "needs-judgment", "locale-marker")
_R = ("npm.package-json.description", "npm.scripts", "web.manifest.text-fields")
_SITES_SQL = f"""
    SELECT 'src/' || source || '/' || lang || '/d' || doc_id || '.ts' AS file, 'd' || doc_id AS site_key, [{', '.join(f"'{v}'" for v in _V)}][doc_id % 4 + 1] AS verdict, CASE doc_id % 2 WHEN 0 THEN 'ui.string-literal' ELSE 'doc.markdown-prose' END AS surface,
      [{', '.join(f"'{r}'" for r in _R)}][doc_id % 5 + 1] AS rule, coalesce(text, '') AS value, sha256(coalesce(text, '')) AS dup_key FROM documents
"""


def _sites(spark, sf_dir):
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (d % n).cast("int"))
    docs = table(spark, sf_dir, "documents")
    file = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), d.cast("string"), F.lit(".ts"))
    return docs.select(file.alias("file"), F.concat(F.lit("d"), d.cast("string")).alias("site_key"), pick(_V, 4).alias("verdict"), F.when(d % 2 == 0, "ui.string-literal").otherwise("doc.markdown-prose").alias("surface"), pick(_R, 5).alias("rule"), text.alias("value"), F.sha2(text, 256).alias("dup_key"))


@query(f"SELECT site_key, file, rule FROM ({_SITES_SQL}) WHERE verdict = 'translate' AND regexp_matches(file, '^src/src1[^/]*/(.*/)?[^/]*\\.ts$') AND starts_with(surface, 'ui.') AND starts_with(rule, 'npm.') AND contains(lower(value), 'the')")
def sites_by_all_predicates(spark, sf_dir):
    found = select.select_sites(_sites(spark, sf_dir), verdict="translate", file="src/src1*/**/*.ts", surface="ui.*", ecosystem="npm", value="THE")
    return found.select("site_key", "file", "rule")


@query(f"""
    WITH s AS (SELECT * FROM ({_SITES_SQL}) WHERE starts_with(surface, 'ui.')), t AS (SELECT dup_key, count(*) AS n FROM s GROUP BY dup_key HAVING count(*) > 1 ORDER BY n DESC, dup_key LIMIT 50)
    SELECT dup_key, min({{'k': site_key, 'v': value}}).v AS text, n, list_sort(list(site_key)) AS sites FROM s JOIN t USING (dup_key) GROUP BY dup_key, n""")
def sites_duplicate_view(spark, sf_dir):
    """Texts that most sites of one surface share: a report of fifty groups."""
    return select.duplicate_view(select.select_sites(_sites(spark, sf_dir), surface="ui.*"))
