"""Queries of the rule catalog: documents as files, each with one site, of the kinds that rules tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rx import sql
from ..operators import rules
from ..sources.tables import table
from .registry import query

# file (with the document's id), path, element, attr, and what the first rule that holds says
CASES = (
    ("a{}/package.json", "/description", None, None, "npm.package-json.description", "translate", None),
    ("a{}/package.json", "/scripts/build", None, None, "npm.package-json.description", "do-not-translate", "identifier"),
    ("a{}/package.json", "/exports/./import", None, None, "npm.package-json.description", "do-not-translate", "identifier"),
    ("a{}/package.json", "/scripts/build/more", None, None, None, None, None),
    ("a{}/node_modules/b/package.json", "/description", None, None, None, None, None),
    ("a{}/package.json", "/keywords/3", None, None, "npm.package-json.description", "needs-judgment", "discovery-token"),
    ("w{}/vite.config.ts", "/VitePWA()/manifest/description", None, None, "web.manifest.inlined-in-build-config", "translate", None),
    ("w{}/vite.config.ts", "/VitePWA()/manifest/lang", None, None, "web.manifest.inlined-in-build-config", "locale-marker", None),
    ("w{}/manifest.json", "/shortcuts/0/name", None, None, "web.manifest.text-fields", "translate", None),
    ("w{}/manifest.json", "/omnibox/keyword", None, None, None, None, None),
    ("w{}/manifest.json", "/permissions/1", None, None, "webext.manifest.text", "do-not-translate", "api-contract"),
    ("x{}/_locales/fr/messages.json", "/hello/message", None, None, "webext.locales.messages", "translate", None),
    ("x{}/_locales/fr/messages.json", "/hello/placeholders/a/content", None, None, "webext.locales.messages", "do-not-translate", "interpolation"),
    (".github/ISSUE_TEMPLATE/f{}.yml", "/body/2/attributes/label", None, None, "github.issue-forms", "translate", None),
    (".github/workflows/f{}.yml", "/jobs/a/steps/3/with/body/p[0]", None, None, "github.release-notes-body", "translate", None),
    (".github/workflows/f{}.yml", "/jobs/a/steps/3/run", None, None, "github.release-notes-body", "do-not-translate", "code-token"),
    (".github/workflows/f{}.yml", "/jobs/a/name", None, None, "github.workflow-prose", "translate", None),
    ("h{}/index.html", "meta", "meta", "og:title", "html.meta.prose", "translate", None),
    ("h{}/index.html", "meta", "meta", "viewport", "html.meta.prose", "do-not-translate", "code-token"),
    ("h{}/index.html", "html", "html", "lang", "html.meta.prose", "locale-marker", None),
    ("h{}/index.html", "title/text[3]", None, None, "html.title", "translate", None),
    ("p{}/fr.po", "/12/msgstr[1]", None, None, "gettext.po-catalog", "translate", None),
    ("p{}/fr.po", "/12/msgid", None, None, "gettext.po-catalog", "needs-judgment", "dual-use"),
    ("i{}/locales/fr/app.json", "/a/b", None, None, "i18n.message-bundles", "translate", None),
    ("i{}/dist/locales/fr/app.json", "/a/b", None, None, None, None, None),
    ("c{}/Cargo.toml", "/package/keywords/0", None, None, "cargo.package.description", "translate", None),
    ("c{}/pyproject.toml", "/project/description", None, None, "python.pyproject.description", "translate", None),
    ("c{}/composer.json", "/description", None, None, "php.composer.description", "translate", None),
    ("c{}/pubspec.yaml", "/description", None, None, "dart.pubspec.description", "translate", None),
    ("d{}/res/values-fr/strings.xml", "/resources/string[0]", None, None, "android.strings-xml", "translate", None),
    ("d{}/Dockerfile", "/LABEL/org.opencontainers.image.title", None, None, "docker.label", "translate", None),
    ("d{}/Info.plist", "/NSCameraUsageDescription", None, None, "apple.plist.usage-description", "translate", None),
    ("d{}/Info.plist", "/CFBundleName", None, None, "apple.plist.usage-description", "do-not-translate", "api-contract"),
    ("l{}/third_party/x/package.json", "/description", None, None, "legal.vendored-verbatim", "do-not-translate", "vendored-legal"),
    ("l{}/notes.txt", "p[0]", None, None, None, None, None),
)
_KEYS = ("i", "file", "path", "element", "attr", "rule", "verdict", "reason")
_ROWS = ", ".join(f"({i}, {', '.join('NULL' if x is None else sql(x) for x in row)})" for i, row in enumerate(CASES))


def catalog_sites(spark, sf_dir):
    cases = spark.createDataFrame([(i, *row[:4]) for i, row in enumerate(CASES)], "i long, template string, path string, element string, attr string")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(CASES)).alias("i"))
    met = docs.join(F.broadcast(cases), "i")  # a fixed number of cases
    return met.select(F.replace("template", F.lit("{}"), F.col("doc_id").cast("string")).alias("file"), "path", "element", "attr")


@query(f"""
    WITH c({', '.join(_KEYS)}) AS (VALUES {_ROWS})
    SELECT replace(file, '{{}}', doc_id::VARCHAR) AS file, path, rule, verdict, reason, coalesce(rule = 'legal.vendored-verbatim', false) AS hard FROM documents JOIN c ON doc_id % {len(CASES)} = i""")
def classify_catalog(spark, sf_dir):
    found = rules.match_rules(catalog_sites(spark, sf_dir))
    return found.select("file", "path", "rule", F.col("rule_verdict").alias("verdict"), F.col("rule_reason").alias("reason"), F.coalesce("rule_hard", F.lit(False)).alias("hard"))


@query(f"""
    WITH c({', '.join(_KEYS)}) AS (VALUES {_ROWS})
    SELECT coalesce(rule, 'none') AS rule, count(*) AS n FROM documents JOIN c ON doc_id % {len(CASES)} = i GROUP BY ALL""")
def rules_exercised(spark, sf_dir):
    return rules.match_rules(catalog_sites(spark, sf_dir)).groupBy(F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))
