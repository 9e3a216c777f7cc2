"""Readers against files by hand: paths, values, and bytes that slice to the raw text."""

from __future__ import annotations

import pytest

from spanloom.sources import readers

FILES = {
    "json": ('{"a": "x\\u00e9", // c\n "b": [1, "y", {"c/d": "z"},], "e": {}, "f": "last"}', {"/a": "xé", "/b/1": "y", "/b/2/c~1d": "z", "/f": "last"}),
    "jsonl": ('{"a":"é"}\n{"a":"y","b":["q"]}\n', {"/0/a": "é", "/1/a": "y", "/1/b/0": "q"}),
    "yaml": (
        "# top\nname: My é app # note\njobs:\n  build:\n    steps:\n      - name: \"One\\n\"\n        run: |\n          echo a\n          echo b\n      - uses: x\n        with:\n          body: 'it''s'\nlist:\n- a\n- b\nlast: z\n",
        {"/name": "My é app", "/jobs/build/steps/0/name": "One\n", "/jobs/build/steps/0/run": "          echo a\n          echo b", "/jobs/build/steps/1/uses": "x", "/jobs/build/steps/1/with/body": "it's", "/list/0": "a", "/list/1": "b", "/last": "z"},
    ),
    "markdown": (
        "---\nt: x\n---\n# Head é #\n\npara one\nwraps\n\n- item\n- two\n  more\n\n| a | b |\n|---|---|\n| c | d |\n\n```js\ncode\n```\n> quote\nend\n\n* * *\nSetext\nhead\n===\nsmall\n---\n",
        {"/front/t": "x", "h1[1]": "Setext head", "h2[2]": "small", "h1[0]": "Head é", "p[0]": "para one wraps", "p[1]": "item", "p[2]": "two more", "cell[0]": "a", "cell[1]": "b", "cell[2]": "c", "cell[3]": "d", "p[3]": "quote end"},
    ),
    "markup": ('<p title="a &amp; b">Hi <b>there é</b></p><script>if (a<b) "x"</script><!-- c --><br/>tail &lt;', {"p/@title": "a & b", "p/text[0]": "Hi", "b/text[1]": "there é", "/text[2]": "tail <", "script/code[0]": 'if (a<b) "x"'}),
    "po": (
        '# c\nmsgid ""\nmsgstr ""\n"Lang: x\\n"\n\nmsgctxt "m"\nmsgid "one é"\nmsgid_plural "many"\nmsgstr[0] "un"\nmsgstr[1] "des"\n',
        {"/0/msgstr": "Lang: x\n", "/1/msgctxt": "m", "/1/msgid": "one é", "/1/msgid_plural": "many", "/1/msgstr[0]": "un", "/1/msgstr[1]": "des"},
    ),
    "toml": (
        '# c\n[package]\nname = "x" # d\ndescription = """long\ntext"""\nkeywords = ["a", \'b\']\n[[bin]]\nname = "q"\n[[bin]]\nname = "r"\n',
        {"/package/name": "x", "/package/description": "long\ntext", "/package/keywords/0": "a", "/package/keywords/1": "b", "/bin/0/name": "q", "/bin/1/name": "r"},
    ),
    "fluent": (
        "# c\nhello = Hi { $n }\n    more é\n    .title = T\n-term = Q\nsel = { $n ->\n    [one] One\n   *[other] Many\n }\n",
        {"/hello": "Hi { $n }\nmore é", "/hello/title": "T", "/-term": "Q", "/sel": "{ $n ->\n[one] One\n*[other] Many\n}"},
    ),
    "script": ("// c\nconst a = 'it\\'s', b = `t ${x}`; /* d */ f(\"é\")", {"a": "it's", "b": "t {0}", "f()/[0]": "é"}),
    "python": ('def f():\n    """Doc é."""\n    x = "s" # c\n', {"docstring[0]": "Doc é.", "string[0]": "s"}),
    "shell": ("#!/bin/sh\n# c\necho \"hi é\" 'x' a#b\n", {"string[0]": "hi é", "string[1]": "x"}),
    "css": ('/* c */ a::before { content: "é"; }', {"string[0]": "é"}),
    "sql": ("-- c\nSELECT 'it''s' AS \"q\" /* d */", {"string[0]": "it's"}),
    "dockerfile": ('# c\nLABEL org.opencontainers.image.title="My é" a=b\nRUN x\n', {"/LABEL/org.opencontainers.image.title": "My é", "/LABEL/a": "b"}),
    "text": ("one\ntwo\n\n three é \n", {"p[0]": "one\ntwo", "p[1]": "three é"}),
}


@pytest.mark.parametrize("kind", FILES)
def test_reader(kind):
    text, values = FILES[kind]
    for mark in ("", "\ufeff"):
        whole = mark + text
        found = readers.located(whole, kind)
        for _, _, start, end, line, column, raw, _ in found:
            assert whole.encode()[start:end].decode() == raw
            assert whole.split("\n")[line - 1][column - 1 :].startswith(raw.split("\n")[0])
        assert {p: v for p, k, *_, v in found if k not in ("key", "comment")} == values
    assert kind in ("text", "jsonl", "markdown") or any(k == "comment" for _, k, *_ in found)


@pytest.mark.parametrize("kind", FILES)
def test_broken_and_binary_files(kind):
    text = FILES[kind][0]
    for cut in range(len(text)):
        for piece in (text[:cut], text[cut:]):
            for _, _, start, end, _, _, raw, _ in readers.located(piece, kind):
                assert piece.encode()[start:end].decode() == raw
    assert readers.located("a\x00b", kind) == [] == readers.located("", kind)


def test_spans_of_pages_slice_to_their_raw_text(spark):
    from spanloom import catalog

    sf = "/root/testdata/sf0.001"
    html = {f"page/{r.page_id}": (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = catalog.queries()["page_spans"](spark, sf).collect()
    assert len(rows) > 100 and all(html[r.file][r.start : r.end].decode() == r.raw for r in rows)


def test_files_with_nulls_and_other_columns(spark):
    rows = spark.createDataFrame([("a.json", None, 1), (None, "x", 2), ("b.json", '{"k": "v"}', 3), ("b.json", '{"k": "v"}', 3)], "file string, text string, value int")
    out = sorted((r.file or "", r.format, r.kind, r.value) for r in readers.spans(rows).collect())
    assert out == [("", "text", "prose-run", "x"), *[("b.json", "json", "key", "k")] * 2, *[("b.json", "json", "string", "v")] * 2]
    assert readers.spans(rows.limit(0)).count() == 0
