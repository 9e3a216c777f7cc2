"""Queries of the format readers: texts are written as files of a format, read back, and must come out as they were."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.tables import table
from .registry import query


def quoted(text: Column) -> Column:
    """The text as a quoted JSON string."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def markup_escaped(text: Column) -> Column:
    """The text with its marks as entities."""
    for c, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _doc() -> Column:
    return F.col("doc_id").cast("string")


#: Format: the ending of the file's name, its text, and the path of the span that holds the document's text.
FILES = {
    "json": (".json", lambda: F.concat(F.lit('{"lang": "'), "lang", F.lit('", // note\n "body": [{"text": '), quoted(F.col("text")), F.lit("},]}")), "/body/0/text"),
    "yaml": (".yml", lambda: F.concat(F.lit("# note\nlang: "), "lang", F.lit("\nbody:\n  - text: "), quoted(F.col("text")), F.lit("\n    n: 1\n")), "/body/0/text"),
    "toml": (".toml", lambda: F.concat(F.lit("[[body]]\nlang = '"), "lang", F.lit("'\ntext = "), quoted(F.col("text")), F.lit(" # note\n")), "/body/0/text"),
    "po": (".po", lambda: F.concat(F.lit('# note\nmsgid "'), _doc(), F.lit('"\nmsgstr '), quoted(F.col("text")), F.lit("\n")), "/0/msgstr"),
    "markup": (".html", lambda: F.concat(F.lit("<!-- note --><p lang='"), "lang", F.lit("' title=\""), markup_escaped(F.col("text")), F.lit("\">x</p>")), "p/@title"),
}


def _reads(kind: str) -> None:
    suffix, text, path = FILES[kind]

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").filter("text <> ''")
        found = readers.spans(docs.select(F.concat(F.lit("d/"), _doc(), F.lit(suffix)).alias("file"), text().alias("text")))
        return found.filter(F.col("path") == path).filter("kind <> 'key'").select("file", "format", "path", "value")

    run.__name__ = f"read_{kind}"
    query(f"SELECT 'd/' || doc_id || '{suffix}' AS file, '{kind}' AS format, '{path}' AS path, text AS value FROM documents WHERE text <> ''")(run)


for _kind in FILES:
    _reads(_kind)


@query("""
    SELECT 'e/' || event_id || '.jsonl' AS file, '/0/type' AS path, event_type AS value FROM events
    UNION ALL SELECT 'e/' || event_id || '.jsonl', '/1/0', 'é "' || props FROM events
    UNION ALL SELECT 'e/' || event_id || '.jsonl', '/1/1/p', event_type || chr(10) FROM events""")
def read_jsonl(spark, sf_dir):
    """An object a line, then a list; paths begin with the line."""
    second = F.concat(F.lit("["), quoted(F.concat(F.lit('é "'), "props")), F.lit(', {"p": '), quoted(F.concat("event_type", F.lit("\n"))), F.lit("}]\n"))
    text = F.concat(F.to_json(F.struct(F.col("event_type").alias("type"), "value")), F.lit("\n"), second)
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".jsonl")).alias("file"), text.alias("text"))
    return readers.spans(files).filter("kind = 'string'").select("file", "path", "value")


@query("""
    SELECT format, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'dockerfile' WHEN 1 THEN 'script' WHEN 2 THEN 'fluent' WHEN 3 THEN 'shell' WHEN 4 THEN 'markdown' ELSE 'text' END AS format FROM documents) GROUP BY format""")
def route_formats(spark, sf_dir):
    ends = F.array(*(F.lit(x) for x in ("/Dockerfile.dev", ".TSX", ".ftl", "/.gitignore", ".MD", ".unknown")))
    file = F.concat(F.lit("d/"), _doc(), F.get(ends, (F.col("doc_id") % 6).cast("int")))
    return table(spark, sf_dir, "documents").select(readers.route(file).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@query()
def page_spans(spark, sf_dir):
    """Text runs, attributes and comments of all pages, with their bytes; fixtures and slices test it."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), F.lit("markup").alias("format"), F.col("html").alias("text"))
    return readers.spans(files)


@query()
def document_prose(spark, sf_dir):
    """Documents read as Markdown: headings, items, cells and paragraphs, with their bytes."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), _doc(), F.lit(".md")).alias("file"), "text")
    return readers.spans(files)
