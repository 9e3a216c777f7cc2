"""Queries of scripts: documents written as the literals of a TSX file, read with their containers, and decided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lang
from ..functions.rx import sql
from ..operators import rules, spans, sweep
from ..sources import inventory
from ..sources.tables import table
from .reader_queries import markup_escaped, quoted
from .registry import query
from .token_queries import classified_sql

PAIR = ("fr", "en")


def _template(text: Column) -> Column:
    for c, by in (("\\", "\\\\"), ("`", "\\`"), ("${", "\\${")):
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def script_files(spark, sf_dir):
    """One TSX file a document; its whole text stands in a string, a template, an attribute and an element."""
    text, key = F.col("text"), F.col("doc_id").cast("string")
    parts = (
        'import x from "./mod', key, '";\n// made of a document\nexport const title = ', quoted(text), ';\nif (kind === "', F.col("lang"), '") go();\n',
        'type Kind = "k', key, '" | \'other kind\';\nexport default function Page({ n }) {\n  localStorage.setItem("k', key, '", 1);\n  const note = `${n} {', _template(text), '} ${ok ? `a ${b}` : "c"}`;\n',
        '  return <Card label="', markup_escaped(text), '"><p>{ok ? \'yes\' : \'no\'}</p>\n    <h1 className={cn("x-', key, '")}>Text: ', F.regexp_replace(text, "[<>{}]", " "), " .</h1></Card>;\n}\n",
    )
    whole = F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return table(spark, sf_dir, "documents").filter("text <> ''").select(F.concat(F.lit("src/d"), key, F.lit(".tsx")).alias("file"), whole.alias("text"))


#: path, kind, value (SQL), symbol, and the facts that hold
ROWS = (
    ("[0]", "string", "'./mod' || doc_id", "", "module_specifier"),
    ("comment[0]", "comment", "'made of a document'", "", ""),
    ("title", "string", "text", "title", ""),
    ("[2]", "string", "lang", "", "compared"),
    ("Kind", "string", "'k' || doc_id", "Kind", "enum_member"),
    ("Kind~2", "string", "'other kind'", "Kind", "enum_member"),
    ("default/Page/localStorage.setItem()/[0]", "string", "'k' || doc_id", "Page", "callee=localStorage.setItem persisted"),
    ("default/Page/note", "template", "'{0} {' || text || '} {1}'", "note", ""),
    ("default/Page/Card/@label", "attr", "text", "Page", "attr=label element=Card"),
    ("default/Page/Card/p/?then", "string", "'yes'", "Page", "element=p"),
    ("default/Page/Card/p/?else", "string", "'no'", "Page", "element=p"),
    ("default/Page/Card/h1/@className/cn()/[0]", "attr", "'x-' || doc_id", "Page", "attr=className element=h1 callee=cn"),
    ("default/Page/Card/h1", "jsx-text", "'Text: ' || regexp_replace(text, '[<>{}]', ' ', 'g') || ' .'", "Page", "element=h1"),
)
_FLAGS = ("compared", "persisted", "module_specifier", "enum_member", "is_key", "grammar_hole")
_TEXTS = ("attr", "element", "callee")


def _row(path: str, kind: str, value: str, symbol: str, facts: str) -> str:
    told = dict(f.split("=") if "=" in f else (f, "true") for f in facts.split())
    cols = [f"'{path}' AS path", f"'{kind}' AS kind", f"{value} AS value", f"'{symbol}' AS symbol", *(f"{told.get(f, 'false')} AS {f}" for f in _FLAGS), *(f"'{told.get(t, '')}' AS {t}" for t in _TEXTS)]
    return f"SELECT 'src/d' || doc_id || '.tsx' AS file, {', '.join(cols)} FROM documents WHERE text <> ''"


FACTS_SQL = " UNION ALL ".join(_row(*r) for r in ROWS)


@query(FACTS_SQL)
def script_facts(spark, sf_dir):
    """Every literal of the files with what holds it."""
    return inventory.sites(script_files(spark, sf_dir)).select("file", "path", "kind", "value", "symbol", *_FLAGS, *_TEXTS)


_DETECTED = lang.detect_sql(f"(SELECT *, value AS v FROM ({FACTS_SQL}) WHERE kind <> 'comment')", "v", "*", PAIR)
_DECIDED = classified_sql(_DETECTED, "file, path, kind, compared, persisted, module_specifier, enum_member, attr")


@query(f"""
    WITH c AS ({_DECIDED}),
    d AS (SELECT file, path, value, CASE WHEN module_specifier OR compared OR persisted OR enum_member OR attr = 'className' THEN 'do-not-translate' ELSE verdict END AS verdict,
        CASE WHEN module_specifier THEN 'module-specifier' WHEN compared THEN 'api-contract' WHEN persisted THEN 'persisted-value' WHEN enum_member THEN 'enum-member' WHEN attr = 'className' THEN 'style-token' ELSE reason END AS reason FROM c)
    SELECT file, path, value, verdict, reason FROM d""")
def inventory_verdicts(spark, sf_dir):
    """Files to verdicts: readers, container facts, dual use, rules, language, cascade and harmonised branches in one plan."""
    found = rules.verdicts(script_files(spark, sf_dir), *PAIR).filter("kind <> 'comment'")
    return found.select("file", "path", "value", "verdict", "reason")


def _bare(text: Column) -> Column:
    """A text without the marks that SQL gives a meaning."""
    return F.regexp_replace(text, "[-'\"`/*]", " ")


def sql_files(spark, sf_dir):
    """One SQL file a document, with a comment and a string that the reader claims and the text where none stands."""
    key = F.col("doc_id").cast("string")
    whole = F.concat(F.lit("-- "), "lang", F.lit("\nSELECT '"), key, F.lit("';\n"), _bare(F.col("text")))
    return table(spark, sf_dir, "documents").filter("text <> ''").select(F.concat(F.lit("d"), key, F.lit(".sql")).alias("file"), whole.alias("text"))


_BARE_SQL = f"regexp_replace(text, {sql("[-'\"`/*]")}, ' ', 'g')"
_HEAD_SQL = "'-- ' || lang || chr(10) || 'SELECT ''' || doc_id || ''';' || chr(10)"


@query(f"""
    SELECT 'd' || doc_id || '.sql' AS file, strlen('-- ' || lang) + strlen(doc_id::VARCHAR) AS claimed, strlen({_HEAD_SQL} || {_BARE_SQL}) - strlen('-- ' || lang) - strlen(doc_id::VARCHAR) AS swept,
      strlen({_HEAD_SQL} || {_BARE_SQL}) AS total FROM documents WHERE text <> ''""")
def sweep_accounting(spark, sf_dir):
    """Every byte of a file is claimed by its reader or handed to the sweep."""
    files = sql_files(spark, sf_dir)
    claims = inventory.sites(files).select("file", "start", "end")
    claimed = spans.merge(claims).groupBy("file").agg(F.sum(F.col("end") - F.col("start")).alias("claimed"))
    swept = sweep.gap_texts(files, claims).groupBy("file").agg(F.sum(F.octet_length("text")).alias("swept"))
    sizes = files.select("file", F.octet_length("text").cast("long").alias("total"))
    return sizes.join(claimed, "file", "left").join(swept, "file", "left").select("file", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("claimed", "swept")), "total")


@query(f"""
    WITH ids AS (SELECT DISTINCT word FROM (SELECT p_name AS word FROM part UNION ALL SELECT replace(p_name, ' ', '-') FROM part UNION ALL SELECT event_type FROM events)),
    names AS (SELECT word, bool_or(own) AS own FROM (SELECT word, true AS own FROM ids UNION ALL SELECT unnest(regexp_split_to_array(word, '[-_.]')), false FROM ids WHERE regexp_matches(word, '[-_.]')) WHERE word <> '' GROUP BY word),
    whole AS (SELECT doc_id, ''';' || chr(10) || {_BARE_SQL} AS t, strlen({_HEAD_SQL}) - 3 AS base FROM documents WHERE text <> ''),
    cut AS (SELECT doc_id, base, regexp_split_to_array(t, {sql(sweep.SEPARATOR)}) AS a, regexp_extract_all(t, {sql(sweep.SEPARATOR)}) AS s FROM whole),
    each AS (SELECT doc_id, base, i, a[i] AS run, coalesce(s[i], '') AS sep FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM cut)),
    placed AS (SELECT doc_id, run, base + coalesce(sum(strlen(run) + strlen(sep)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM each),
    runs AS (SELECT doc_id, pos + strlen(run) - strlen(ltrim(run, ' ')) AS s, trim(run, ' ') AS value, regexp_extract_all(trim(run, ' '), '\\p{{L}}{{2,}}') AS words FROM placed),
    f AS (SELECT *, len(words) AS n FROM runs WHERE length(value) >= 3 AND len(words) > 0 AND len(regexp_extract_all(value, '\\p{{L}}')) / length(value) >= 0.5
      AND NOT regexp_matches(value, {sql(sweep.NOT_PROSE)}) AND NOT regexp_matches(value, {sql(sweep.IDENTIFIER)})),
    k AS (SELECT doc_id, s, count(*) AS known FROM (SELECT doc_id, s, unnest(words) AS w FROM f) WHERE w IN (SELECT word FROM names) OR lower(w) IN (SELECT word FROM names WHERE own) GROUP BY ALL),
    p AS (SELECT f.*, n - coalesce(known, 0) AS prose FROM f LEFT JOIN k USING (doc_id, s))
    SELECT 'd' || doc_id || '.sql' AS file, s::BIGINT AS start, (s + strlen(value))::BIGINT AS "end", value FROM p WHERE (n = 1 AND length(words[1]) >= 4 AND prose > 0 AND length(value) >= 12)
      OR (n > 1 AND regexp_matches(value, '[\\s ,;:!?]') AND prose >= 2 AND prose / n >= 0.5)""")
def sweep_unclaimed(spark, sf_dir):
    """Readers, claims, their complement and its human-looking runs, with bytes, in one plan."""
    files = sql_files(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("-")))).alias("word")).union(table(spark, sf_dir, "events").select("event_type"))
    return sweep.unclaimed_runs(files, inventory.sites(files).select("file", "start", "end"), names.distinct())
