"""Escapes, patches, listings and the incremental inventory: round trips, brute force, git, and batches against one run."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import escapes
from spanloom.operators import patch
from spanloom.sources import inventory, listing, readers
from spanloom.streaming import incremental

ALPHABET = ["a", "B ", "é", "🙂", "'", '"', "`", "\\", "${", "{", "}", "<", ">", "&", "&amp;", "\\n", "\n", "\t", "#", "- ", ": ", "*/", "''", '"""', "1. ", "|", "\\u00e9", "&#233;"]


def random_text(rng):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("syntax", [*escapes.CODECS, "json-string", "yaml-block", "yaml-plain", "md-text"])
def test_every_syntax_round_trips(syntax):
    rng, held = random.Random(1), 0
    for _ in range(3000):
        text = random_text(rng)
        for ascii_only in (False, True):
            raw = escapes.encode(syntax, text, ascii_only, "  ")
            if raw is not None:
                back = escapes.decode(syntax, raw, "  ")
                held += back == text
                # what a syntax cannot tell apart is refused by the patch, never written
                assert back == text or syntax in ("line-comment", "plain", "block-comment", "md-text", "toml-literal", "yaml-plain", *escapes.UNICODE, *escapes.ENTITY), (text, raw, back)
                if ascii_only and syntax in (*escapes.UNICODE, *escapes.ENTITY):
                    assert raw.isascii()
    assert held > 1500


#: name, file with a place for @@, path of the site
HOSTS = [
    ("a.json", '{"k": "@@"}', "/k"), ("a.yml", 'k: "@@"\n', "/k"), ("b.yml", "k: '@@'\n", "/k"), ("a.toml", 'k = "@@"\n', "/k"), ("b.toml", "k = '@@'\n", "/k"),
    ("a.po", 'msgid "x"\nmsgstr "@@"\n', "/0/msgstr"), ("a.html", '<p title="@@">x</p>', "p/@title"), ("b.html", "<p title='@@'>x</p>", "p/@title"),
    ("a.ts", "f('@@')", "f()/[0]"), ("b.ts", 'f("@@")', "f()/[0]"), ("c.ts", "f(`@@`)", "f()/[0]"), ("a.tsx", '<P t="@@"/>', "P/@t"), ("b.tsx", "<P t='@@'/>", "P/@t"),
    ("a.sql", "SELECT '@@'", "string[0]"), ("a.py", "x = '@@'", "string[0]"), ("b.py", 'x = "@@"', "string[0]"), ("a.css", 'a{content: "@@"}', "string[0]"), ("Dockerfile", 'LABEL a="@@"\n', "/LABEL/a"),
]


@pytest.mark.parametrize("file,host,path", HOSTS)
def test_patched_files_read_as_meant(file, host, path):
    rng, done = random.Random(2), 0
    how = next((k for p, k in readers.ROUTES if __import__("re").search(p, file.lower())), "text")
    text = host.replace("@@", "old é")
    (site,) = (s for s in inventory.file_sites(file, how, text) if s[2] == path and s[3] != "key")
    for _ in range(400):
        new = random_text(rng)
        data, told = patch.splice(text.encode(), [{"site_key": "k", "start": site[4], "end": site[5], "raw": site[8], "extractor": how, "kind": site[3], "text": new, "holes": []}])
        if told[0]["status"] == "applied":
            found = [s[9] for s in inventory.file_sites(file, how, data.decode()) if s[2] == path and s[3] != "key"]
            assert found == [new] or not new, (data, new)
            done += 1
        else:
            assert told[0]["status"] == "the syntax cannot hold the text" and data.decode() == text
    assert done > 30


def test_splice_against_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("abcdé🙂 ") for _ in range(rng.randint(5, 60)))
        data, at, patches = text.encode(), 0, []
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 2 * rng.randint(0, 4))))
        want = text
        for a, b in reversed([*zip(cuts[::2], cuts[1::2], strict=False)]):
            new = rng.choice(["", "new é", "x"])
            want = want[:a] + new + want[b:]
            start = len(text[:a].encode())
            patches.append({"site_key": str(a), "start": start, "end": start + len(text[a:b].encode()), "raw": text[a:b], "extractor": "text", "kind": "prose-run", "text": new, "holes": []})
        rng.shuffle(patches)
        out, told = patch.splice(data, patches)
        assert out.decode() == want and {t["status"] for t in told} <= {"applied"} and at == 0


def test_patches_that_drift_or_overlap(spark):
    p = lambda key, start, end, raw, text, file="a.txt": (file, key, start, end, raw, "text", "prose-run", text, [])
    files = [("a.txt", "one two three two"), ("b.txt", "kept"), ("c.txt", None), ("d.ts", "f(`a ${x} b`)")]
    patches = [p("moved", 1, 4, "one", "1"), p("gone", 0, 4, "four", "4"), p("twice", 0, 3, "two", "2"), p("left", 8, 13, "three", "3"), p("right", 10, 17, "ree two", "r"), p("left", 8, 13, "three", "3"), p("lost", 0, 1, "x", "y", "z.txt"), p("none", 0, 1, "x", "y", "c.txt")]
    patches += [("d.ts", "hole", 3, 11, "a ${x} b", "script", "template", "B {0} `A", ["x"])]
    kind = "file string, site_key string, start long, end long, raw string, extractor string, kind string, text string, holes array<string>"
    out = {r.file: (r.text, {t.site_key: t.status for t in r.report}) for r in patch.apply_patches(spark.createDataFrame(files, "file string, text string"), spark.createDataFrame(patches, kind)).collect()}
    assert out["a.txt"] == ("1 two three two", {"moved": "recovered", "gone": "drift: the text is gone", "twice": "drift: the text is there more than once", "left": "overlap", "right": "overlap"})
    assert out["b.txt"] == ("kept", {}) and out["c.txt"] == ("", {"none": "drift: the text is gone"})
    assert out["d.ts"] == ("f(`B ${x} \\`A`)", {"hole": "applied"})


PATTERNS = "bld/\n*.log\n!important.log\n/root-only.txt\npapers/**/draft.md\na**b.txt\n*.py[cod]\n[Tt]humbs.db\nspace\\ file.txt\n\\#note\n\\!bang\nlogs/**\n!logs/keep.txt\n**/deep\nx/**/y/\n*.t?t  \nq/[!a]z\n"
PATHS = "bld/x.js nested/bld/x.js bld.js app.log important.log logs/app.log logs/keep.txt logs/in/z.md root-only.txt sub/root-only.md papers/a/b/draft.md papers/draft.md papers/a/x.md aXXb.txt aXX.md a/b.md mod.pyc mod.pyx Thumbs.db thumbs.db #note !bang note x/y/f x/a/b/y/f x/yy/f in/deep/f deep deeper/f one.tat two.tt q/bz q/az sub/q/bz sub/keep/a.log sub/keep/b.md plain.ts".split(" ") + ["space file.txt"]
NESTED = "!*.log\n/keep/\n"


@pytest.mark.skipif(not shutil.which("git"), reason="git tells what it ignores")
def test_ignore_files_as_git_reads_them(spark, tmp_path):
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    for path in PATHS:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".gitignore").write_text(PATTERNS)
    (tmp_path / "sub/.gitignore").write_text(NESTED)
    git = {p for p in PATHS if subprocess.run(["git", "check-ignore", "-q", "--no-index", p], cwd=tmp_path).returncode == 0}
    rules = listing.ignore_rules(spark.createDataFrame([("", PATTERNS), ("sub", NESTED), ("none", None)], "folder string, text string"))
    got = {r.path for r in listing.ignored(spark.createDataFrame([(p,) for p in PATHS] + [(PATHS[0],), ("",)], "path string"), rules).collect()}
    assert got == git


def test_census_of_listed_files(spark, tmp_path):
    made = {
        "src/a.ts": b"const a = 1", "empty.ts": b"", "b.dat": b"\x01\0\x02", "bom.json": b"\xef\xbb\xbf{}", "u.txt": b"\xff\xfe" + "é".encode("utf-16-le"), "l.txt": b"caf\xe9", "shot.PNG": b"\x89P", "f.woff2": b"x",
        "pnpm-lock.yaml": b"x: 1", "node_modules/m/i.js": b"x", "big.txt": b"x" * (listing.SIZE_CAP + 1), "t.tmp": b"x", "gen/x.ts": b"x", ".gitignore": b"*.tmp\ngen/\n", "a b/\xc3\xa9.md".encode("latin-1").decode(): b"# \xc3\xa9",
    }
    for path, data in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    unlisted = {p: made[p] for p in ("empty.ts", ".gitignore")}
    files = listing.list_files(spark, str(tmp_path))
    assert {r.path for r in files.select("path").collect()} == {*made} - {*unlisted}
    more = spark.createDataFrame([(p, len(d), bytearray(d)) for p, d in unlisted.items()], "path string, length long, content binary")
    rows = {r.path: r for r in listing.census(files.union(more)).collect()}
    assert {*rows} == {*made}
    assert {p: r.reason for p, r in rows.items() if r.reason} == {"empty.ts": "empty", "b.dat": "binary", "shot.PNG": "binary-ext", "f.woff2": "binary-ext", "pnpm-lock.yaml": "lockfile", "node_modules/m/i.js": "ignored-folder", "big.txt": "oversize", "t.tmp": "gitignored", "gen/x.ts": "gitignored"}
    assert rows["shot.PNG"].readable and not rows["f.woff2"].readable and all((r.bucket == "read") == (r.reason is None) for r in rows.values())
    told = {p: (r.text, r.encoding, r.byte_addressable, r.body_start) for p, r in rows.items()}
    assert told["bom.json"] == ("{}", "utf8-bom", True, 3) and told["u.txt"] == ("é", "utf16le", False, 2) and told["l.txt"] == ("café", "latin1", False, 0)
    assert told["src/a.ts"] == ("const a = 1", "utf8", True, 0) and told["empty.ts"] == ("", "utf8", True, 0) and told["b.dat"] == (None,) * 4


def test_batches_equal_one_run(spark, tmp_path):
    one = [("a.json", 1, '{"k": "v", "l": "w"}'), ("b.json", 1, "{}"), ("c.md", 1, "# Head\n\npara"), (None, 1, "x"), ("d.json", 5, '{"k": "new"}')]
    two = [("a.json", 2, '{"k": "w"}'), ("a.json", 3, '{"k": "x"}'), ("c.md", 2, None), ("e.ts", 2, "f('s')"), ("d.json", 4, '{"k": "old"}'), ("b.json", 1, '{"k": "same version"}')]
    store = incremental.Store(spark, str(tmp_path / "store"), 4)
    kind = "file string, version long, text string"
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.follow(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), store, str(tmp_path / "progress")).awaitTermination()
        for _ in range(i + 1):  # a batch that is run again, after later ones or not, changes nothing
            store.merge(spark.createDataFrame(rows, kind), i)
    last = spark.createDataFrame([("a.json", '{"k": "x"}'), ("b.json", "{}"), ("d.json", '{"k": "new"}'), ("e.ts", "f('s')")], "file string, text string")
    show = lambda df: sorted(map(str, df.collect()))
    assert show(store.sites()) == show(inventory.sites(last)) and store.sites().count() == 5
    assert incremental.Store(spark, str(tmp_path / "other")).sites().count() == 0
    assert store.rows().filter(F.col("file") == "c.md").count() == 1  # known to be gone


def test_rewritten_files_are_those_of_a_table_of_patches(spark):
    """Patches made of a file's own sites: as with a table of them, but nothing is shuffled."""
    files = spark.createDataFrame([("a.json", '{"t": "one é", "n": "two"}'), ("b.po", 'msgid "x"\nmsgstr "y"\n'), ("c.tsx", "const t = `a ${x}`;\n"), ("d.txt", None), ("e.txt", "")], "file string, text string")

    def patches_of(sites):
        made = [s | {"site_key": s["file"] + s["path"], "text": s["value"] + ' "ü"'} for s in sites if s["kind"] != "key"]
        return made + made[:1]

    wanted = inventory.sites(files).filter("kind <> 'key'").select("file", F.concat("file", "path").alias("site_key"), "start", "end", "raw", "extractor", "kind", F.concat("value", F.lit(' "ü"')).alias("text"), "holes")
    done = patch.rewrite(files, patches_of)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, done.collect())) == sorted(map(str, patch.apply_patches(files, wanted.union(wanted.limit(1))).collect()))


def test_round_trip_of_patches_shuffles_no_text(spark):
    for name in ("patch_round_trip", "patch_report"):
        assert "Exchange" not in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_places_in_any_order():
    text = "a\né🙂b\n\n  c d\nlast"
    for order in (range(len(text)), reversed(range(len(text))), [5, 2, 9, 9, 0, 11, 3]):
        at = readers.Places(text)
        for a in order:
            before = text[:a]
            assert at.of(a, a + 1) == (len(before.encode()), len(text[: a + 1].encode()), before.count("\n") + 1, a - before.rfind("\n"))
