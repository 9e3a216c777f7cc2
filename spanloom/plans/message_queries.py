"""Queries of messages with arms: documents written into ICU and Fluent messages, read, grouped and written for a locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cldr
from ..operators import messages
from ..sources import inventory
from ..sources.tables import table
from .plural_queries import CLDR_SQL
from .registry import query


def _icu(text: Column) -> Column:
    """A text without marks that ICU gives a meaning."""
    text = F.replace(text, F.lit("'"), F.lit("''"))
    for c in "{}#|":
        text = F.replace(text, F.lit(c), F.lit(f"'{c}'"))
    return text


_ESC = "replace(replace(replace(replace(replace(text, '''', ''''''), '{', '''{'''), '}', '''}'''), '#', '''#'''), '|', '''|''')"
_INNER = "{g, select, male {he} other {it''s}} {who}"
_PARTS = f"""
    SELECT doc_id, lang, '# ' || lang AS one, {_ESC} AS esc, '{{n, plural, offset:1 =0 {{none}} one {{# ' || lang || '}} other {{' AS head FROM documents WHERE text <> ''
"""


def icu_messages(spark, sf_dir):
    """site_key, locale, value: a message a document, its whole text in the last arm, behind it a select argument."""
    parts = (F.lit("{n, plural, offset:1 =0 {none} one {# "), F.col("lang"), F.lit("} other {"), _icu(F.col("text")), F.lit(f" {_INNER}}}}} tail"))
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    return docs.select(F.col("doc_id").cast("string").alias("site_key"), F.col("lang").alias("locale"), F.concat(*parts).alias("value"))


def _arm(argument: int, parent: int, depth: int, start: str, end: str, name: str, kind: str, offset: str, selector: str, category: str, at: str, body: str) -> str:
    return f"SELECT doc_id::VARCHAR AS site_key, {argument}::BIGINT AS argument, {parent}::BIGINT AS parent, {depth}::BIGINT AS depth, ({start})::BIGINT AS start, ({end})::BIGINT AS \"end\", '{name}' AS name, '{kind}' AS type, {offset}::BIGINT AS \"offset\", '{selector}' AS selector, {category} AS category, ({at})::BIGINT AS body_start, {body} AS body FROM p"


_LITERAL = _INNER.replace("'", "''")
_END = f"length(head) + length(esc) + length(' {_LITERAL}}}}}')"
_G = "length(head) + length(esc) + 1"


@query(f"""
    WITH p AS ({_PARTS})
    {_arm(0, -1, 0, '0', _END, 'n', 'plural', '1', '=0', 'NULL', "length('{n, plural, offset:1 =0 {')", "'none'")}
    UNION ALL {_arm(0, -1, 0, '0', _END, 'n', 'plural', '1', 'one', "'one'", "length('{n, plural, offset:1 =0 {none} one {')", "one")}
    UNION ALL {_arm(0, -1, 0, '0', _END, 'n', 'plural', '1', 'other', "'other'", "length(head)", f"esc || ' {_LITERAL}'")}
    UNION ALL {_arm(1, 2, 1, _G, f"{_G} + length('{_LITERAL.removesuffix(' {who}')}')", 'g', 'select', 'NULL', 'male', 'NULL', f"{_G} + length('{{g, select, male {{')", "'he'")}
    UNION ALL {_arm(1, 2, 1, _G, f"{_G} + length('{_LITERAL.removesuffix(' {who}')}')", 'g', 'select', 'NULL', 'other', 'NULL', f"{_G} + length('{{g, select, male {{he}} other {{')", "'it''''s'")}""")
def icu_arms(spark, sf_dir):
    found = messages.arms(icu_messages(spark, sf_dir), "icu")
    return found.select("site_key", "argument", "parent", "depth", "start", "end", "name", "type", "offset", "selector", "category", "body_start", "body")


@query(f"""
    WITH p AS ({_PARTS})
    SELECT doc_id::VARCHAR AS site_key, head || esc || ' {_LITERAL}}}}} tail' AS value, CASE WHEN required IS NULL THEN head || esc || ' {_LITERAL}}}}} tail' ELSE
      '{{n, plural, offset:1 =0 {{none}} ' || array_to_string(list_transform(required, lambda c: c || ' {{' || CASE c WHEN 'one' THEN one ELSE esc || ' {_LITERAL}' END || '}}'), ' ') || '}} tail' END AS written
    FROM p LEFT JOIN {CLDR_SQL} ON r.lang = lower(regexp_extract(p.lang, '^([A-Za-z]+)', 1))""")
def icu_for_locale(spark, sf_dir):
    """Messages with the arms that their locale requires; the whole argument is rewritten, its arms' texts are kept."""
    return messages.for_locale(icu_messages(spark, sf_dir), cldr.table(spark))


_FLAT = "'T ' || regexp_replace(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), '[\\[\\]*{}\"]', '_', 'g') || ' .'"


def fluent_files(spark, sf_dir):
    """A resource a document: a message with arms that closes at the margin, a line of junk, a plain message with an attribute."""
    flat = F.concat(F.lit("T "), F.regexp_replace(F.regexp_replace("text", "[ \\t\\n\\r]+", " "), '[\\[\\]*{}"]', "_"), F.lit(" ."))
    parts = (F.lit("# note\nmsg = { $n ->\n    [one] One "), F.col("lang"), F.lit("\n   *[other] "), flat, F.lit('\n      { NUMBER($n) ->\n         [0] { "{" } none\n        *[few] some\n      }\n}\njunk line\nplain = Plain '), F.col("lang"), F.lit("\n    .title = "), flat, F.lit("\n"))
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".ftl")).alias("file"), F.concat(*parts).alias("text"))


@query(f"""
    WITH p AS (SELECT doc_id || '.ftl' AS file, lang, {_FLAT} AS flat FROM documents WHERE text <> '')
    SELECT file, 0::BIGINT AS argument, '$n' AS name, 'variable' AS type, 'one' AS selector, false AS "default", 'one' AS category, 'One ' || lang AS body FROM p
    UNION ALL SELECT file, 0::BIGINT, '$n', 'variable', 'other', true, 'other', flat || chr(10) || '{{ NUMBER($n) ->' || chr(10) || '[0] {{ "{{" }} none' || chr(10) || '*[few] some' || chr(10) || '}}' FROM p
    UNION ALL SELECT file, 1::BIGINT, 'NUMBER($n)', 'function', '0', false, NULL, '{{ "{{" }} none' FROM p
    UNION ALL SELECT file, 1::BIGINT, 'NUMBER($n)', 'function', 'few', true, 'few', 'some' FROM p""")
def fluent_arms(spark, sf_dir):
    """Resources to entries to arms."""
    values = inventory.sites(fluent_files(spark, sf_dir)).filter("kind = 'message'").select(F.concat("file", F.lit("#"), "path").alias("site_key"), "value")
    found = messages.arms(values, "fluent")
    return found.select(F.substring_index("site_key", "#", 1).alias("file"), "argument", "name", "type", "selector", "default", "category", F.regexp_replace("body", "^\\s+|\\s+$", "").alias("body"))


@query(f"""
    WITH p AS (SELECT doc_id || '.ftl' AS file, {_FLAT} AS flat FROM documents WHERE text <> '')
    SELECT file, '/msg' AS path, ['one', 'other'] AS categories, 2::BIGINT AS n FROM p UNION ALL SELECT file, '/msg', ['few'], 2::BIGINT FROM p""")
def fluent_families(spark, sf_dir):
    """Families of categories that the arms of a resource's messages make; the attribute without arms makes none."""
    values = inventory.sites(fluent_files(spark, sf_dir)).filter("kind = 'message'").select(F.concat("file", F.lit("#"), "path").alias("site_key"), "value")
    found = messages.families(messages.arms(values, "fluent"))
    return found.select(F.substring_index("site_key", "#", 1).alias("file"), F.substring_index("site_key", "#", -1).alias("path"), "categories", "n")
