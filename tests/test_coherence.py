"""The coherence gate and unique paths on small fixtures."""

from __future__ import annotations

import random

from spanloom.operators import coherence

SITE = "file string, site_key string, path string, extractor string, value string, raw string, verdict string, reason string, dup_key string, detected string, holes array<int>"


def test_findings_of_five_kinds(spark):
    rows = [
        ("a.md", "1", "h1[0]", "markdown", "Été, déjà!", "", "x", None, "1", None, []),
        ("a.md", "2", "p[0]", "markdown", "t", "[a](#été-déjà) [b](#gone) [c](#Gone)", "x", None, "2", None, []),
        ("b.ts", "3", "p", "script", "[a](#gone)", "[a](#gone)", "x", None, "3", None, []),
        ("b.ts", "4", "q", "script", "fr-CA", "", "locale-marker", None, "4", None, []),
        ("b.ts", "5", "q", "script", "en_GB", "", "locale-marker", None, "5", None, []),
        ("b.ts", "6", "q", "script", None, None, "locale-marker", None, None, None, None),
        ("b.ts", "7", "q", "script", "Hi {0}", "", "translate", None, "same", "fr", [0, 1]),
        ("c.ts", "8", "q", "script", "hi", "", "x", "already-target-language", "same", "en", []),
        ("c.ts", "9", "q", "script", "hi", "", "x", "other", "same", "de", []),
        ("c.ts", "10", "q", "script", "hi", "", "translate", None, "same", None, []),
    ]
    families = [("f", "k1", ["few", "many"], []), ("f", "k2", [], ["two"]), ("f", "k3", ["one"], ["two"]), ("f", "k4", [], [])]
    sites, fams = spark.createDataFrame(rows, SITE), spark.createDataFrame(families, "file string, site_key string, missing array<string>, extra array<string>")
    got = sorted((r.kind, r.site_key, r.message) for r in coherence.g6_coherence(sites, fams, "en").collect())
    assert got == sorted([
        ("anchor-drift", "2", "links to #gone"), ("anchor-drift", "2", "links to #gone"), ("locale-drift", "4", "declares fr-CA"), ("hole-loss", "7", "placeholder {1} is missing"),
        ("duplicate-divergence", "7", "the same text is in en and fr"), ("plural-incomplete", "k1", "no few or many"), ("plural-incomplete", "k2", "more two"), ("plural-incomplete", "k3", "no one, and more two"),
    ])
    assert coherence.g6_coherence(sites.filter("path not like 'h%'"), fams.limit(0), "en").filter("kind = 'anchor-drift'").count() == 0  # no headings at all
    assert coherence.g6_coherence(sites.limit(0), fams.limit(0), "en").count() == 0


def test_paths_become_unique(spark):
    rng = random.Random(4)
    rows = [("f", "k", "key", 1), ("f", "k", "string", 5), ("g", "x", "string", 9), ("g", "x", "string", 3), ("g", "x~2", "string", 4), ("g", "x~3", "string", 4), ("g", "x", "key", 1)]
    rows += [("h", rng.choice(["p", "p~2", "p~2~2", "p~3", "q"]), rng.choice(["key", "string"]), i) for i in range(40)]
    out = coherence.unique_paths(spark.createDataFrame(rows, "file string, path string, kind string, start long")).collect()
    assert len({(r.file, r.path) for r in out}) == len(rows) == len(out)
    assert {(r.kind, r.path, r.renamed) for r in out if r.file == "f"} == {("string", "k", False), ("key", "k~2", False)}
    assert {(r.start, r.path, r.renamed) for r in out if r.file == "g"} == {(3, "x", False), (9, "x~4", True), (1, "x~5", True), (4, "x~2", False), (4, "x~3", False)}


def test_selections(spark):
    import pytest

    from spanloom.operators.select import UnknownToken, select_sites

    rows = [("a/b.ts", "translate", "ui.x", "npm.a", "Hello"), ("a/c.ts", "translate", "doc.y", None, "hello there"), (None, "needs-judgment", None, "web.m", None), ("b.ts", "unclassified", "ui.z", "npm.b.c", "HELLO")]
    sites = spark.createDataFrame(rows, "file string, verdict string, surface string, rule string, value string")
    pick = lambda **by: sorted(r.value or "" for r in select_sites(sites, **by).collect())
    assert pick() == sorted(r[4] or "" for r in rows) and pick(value="hello") == ["HELLO", "Hello", "hello there"]
    assert pick(file="a/*", value="THERE") == ["hello there"] and pick(surface="ui.*", verdict="translate") == ["Hello"] and pick(rule="web.m") == [""] and pick(ecosystem="npm") == ["HELLO", "Hello"]
    with pytest.raises(UnknownToken, match="not a verdict"):
        pick(verdict="done")
    with pytest.raises(UnknownToken, match="no rule matches 'go"):
        pick(ecosystem="go")
    assert select_sites(sites.filter("rule is null"), rule="go.*").count() == 0
