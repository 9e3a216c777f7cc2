"""Operators on small fixtures: nulls, empty tables, ties, and the cases that the tables don't hold."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from spanloom.functions import cldr, identity, lang, lang_data, rx
from spanloom.operators import plural, reconcile, spans
from spanloom.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SPANS = "file string, start long, end long"


def test_spans_merge_touching_and_leave_gaps(spark):
    s = spark.createDataFrame([("a", 2, 4), ("a", 4, 6), ("a", 8, 9), ("a", 8, 9), ("b", 0, 5)], SPANS)
    files = spark.createDataFrame([("a", 12), ("b", 5), ("c", 3), ("d", 0)], "file string, total long")
    merged = spans.merge(s)
    assert rows(merged) == [("a", 2, 6), ("a", 8, 9), ("b", 0, 5)]
    assert rows(spans.complement(merged, files)) == [("a", 0, 2), ("a", 6, 8), ("a", 9, 12), ("c", 0, 3)]
    assert {r[0]: r[3] for r in spans.claim_ratio(merged, files).collect()} == {"a": 0.417, "b": 1.0, "c": 0.0, "d": 1.0}
    none = spark.createDataFrame([], SPANS)
    assert rows(spans.merge(none)) == []
    assert rows(spans.complement(none, files)) == [("a", 0, 12), ("b", 0, 5), ("c", 0, 3)]


def test_spans_overlap_is_half_open(spark):
    left = spark.createDataFrame([("a", 0, 4), ("a", 4, 6)], SPANS)
    assert rows(spans.overlaps(left, spark.createDataFrame([("a", 4, 5), ("b", 0, 9)], SPANS))) == [("a", 4, 6)]


def test_uncovered_lines(spark):
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "file string, line long")
    covered = spark.createDataFrame([("a", 2, 3), ("a", 2, 2)], "file string, line long, end_line long")
    assert rows(spans.uncovered_lines(lines, covered)) == [("a", 1), ("b", 1)]


def test_line_sites_count_bytes(spark):
    df = spark.createDataFrame([("f", "é\n\n  x"), ("g", None), ("h", "")], "file string, text string")
    assert rows(tables.line_sites(df, F.col("file"), "text")) == [("f", "line[1]", 1, 0, 2, "é"), ("f", "line[3]", 3, 4, 7, "  x")]


def test_identity(spark):
    df = spark.createDataFrame([(" A  b\n",), ("A b",), ("a b",), ("é",), (None,)], "v string")
    out = df.select(identity.collapsed(F.col("v")), identity.dup_key(F.col("v")), identity.nfc("v")).collect()
    assert out[0][0] == "A b" and out[0][1] == out[1][1] != out[2][1]
    assert out[3][2] == unicodedata.normalize("NFC", "é") and out[4][2] is None
    assert spark.range(1).select(identity.pointer_segment(F.lit("a/b~c"))).first()[0] == "a~1b~0c"


def test_ordinal_distance():
    assert reconcile.ordinal_distance("a[1]/b", "a[1]/b") == 0
    assert reconcile.ordinal_distance("a[1]/b", "a[3]/b") == 2
    assert reconcile.ordinal_distance("a[1]/b", "a[1]/c") == float("inf")


def test_reconcile_tiers(spark):
    cols = "site_key string, file string, surface string, content_hash string, dup_key string"
    before = spark.createDataFrame([("f#p[0]", "f", "s", "h0", "d0"), ("f#p[1]", "f", "s", "h1", "d1"), ("f#p[2]", "f", "s", "h2", "d2"), ("f#p[9]", "f", "s", "h9", "d9")], cols)
    after = spark.createDataFrame([("f#p[0]", "f", "s", "h0", "d0"), ("f#q[7]", "f", "s", "h1", "d1"), ("f#p[4]", "f", "s", "hx", "d2"), ("f#p[50]", "f", "s", "hy", "d9")], cols)
    assert rows(reconcile.reconcile(before, after)) == sorted(
        [("same", "f#p[0]", "f#p[0]"), ("moved", "f#p[1]", "f#q[7]"), ("renumbered", "f#p[2]", "f#p[4]"), ("added", None, "f#p[50]"), ("removed", "f#p[9]", None)], key=str
    )
    assert rows(reconcile.reconcile(before.limit(0), after.limit(0))) == []


def test_plural_families_and_completeness(spark):
    sites = spark.createDataFrame([("f", "ru", "days_one", "x"), ("f", "ru", "days_other", "y"), ("f", "ja-JP", "n/one", "a"), ("f", "ja-JP", "n/other", "b"), ("f", "ru", "title", "t")], "file string, locale string, path string, value string")
    found = plural.completeness(plural.families(sites), cldr.table(spark))
    got = {(r.locale, r.base): (r.categories, r.missing, r.extra) for r in found.collect()}
    assert got == {("ru", "days"): (["one", "other"], ["few", "many"], []), ("ja-JP", "n"): (["one", "other"], [], ["one"])}


def test_plural_values(spark):
    df = spark.createDataFrame([("{n} day | {n} days",), ("one day |||| %d days",), ("a | b",), ("plain",), (None,)], "v string")
    got = [None if r[0] is None else [x.category for x in r[0]] for r in df.select(plural.value_split(F.col("v"))).collect()]
    assert got[:2] == [["one", "other"], ["one", "other"]] and got[2:] == [None, None, None]


def test_plural_claims_by_precedence(spark):
    c = spark.createDataFrame([("x", 1, "fx", "s1"), ("y", 2, "fy", "s1"), ("y", 2, "fy", "s2"), ("y", 2, "fz", "s3")], "dialect string, precedence int, family string, site string")
    assert {r.family for r in plural.claims(c).collect()} == {"fx", "fz"}


def test_next_site(spark):
    pragmas = spark.createDataFrame([("f", 5, "note"), ("f", 90, "last")], "file string, start long, note string")
    sites = spark.createDataFrame([("f", 1, "a"), ("f", 8, "b"), ("g", 6, "c")], "file string, start long, site_key string")
    assert rows(plural.next_site(pragmas, sites)) == [("f", 5, "note", "b"), ("f", 90, "last", None)]


def test_rules_that_need_a_pointer_in_the_file(spark):
    from spanloom.operators import rules

    rows = [("a/manifest.json", "/omnibox/keyword"), ("a/manifest.json", "/manifest_version"), ("b/manifest.json", "/omnibox/keyword"), ("LICENSE", None), (None, "/description")]
    out = {(r.file, r.path): (r.rule, r.rule_hard) for r in rules.match_rules(spark.createDataFrame(rows, "file string, path string").withColumn("rule", F.lit("old"))).collect()}
    assert out["a/manifest.json", "/omnibox/keyword"] == ("webext.manifest.text", False)
    assert out["b/manifest.json", "/omnibox/keyword"] == (None, None)
    assert out["LICENSE", None] == ("legal.vendored-verbatim", True)
    assert out[None, "/description"] == (None, None)
    assert len({r["rule"] for r in rules.catalog()}) == 20


def test_quick_spellings_blank_what_the_patterns_do(spark):
    """Patterns that begin or end beside a word's own character, and marks without which a text isn't searched."""
    rng = random.Random(7)
    parts = [*"aBcZ09_-./é🙂ß ñ{}%<>`:\n\t", "{0}", "{{x}}", "%s", "%1$d", "http://", "`a`", "<b>", "aB", "ABC", "a_b", "a.b"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))),) for _ in range(3000)], "v string")
    plain = F.col("v")
    for p in lang_data.NOT_PROSE:
        plain = rx.replace_all(plain, p, " ")
    assert {*lang.QUICK, *lang.MARKS} <= {*lang_data.NOT_PROSE}
    assert df.filter(lang.normalized(F.col("v")) != F.trim(F.regexp_replace(plain, r"\s+", " "))).isEmpty()
    # far less work than one look at every place: each quick spelling is used
    assert "(?<!\\w)[a-z]++[A-Z]\\w*+" in df.select(lang.normalized(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
