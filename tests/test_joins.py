"""Joins by containment against brute force, with hot files and lines, nulls, repeats and empty tables."""

from __future__ import annotations

import random

import pytest

from spanloom.operators import audit, passages, plan, plural, spans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n, top: [(rng.choice("ab"), s := rng.randint(0, 300), s + rng.choice([0, 1, 5, 70, top]), rng.randint(0, 1)) for _ in range(n)]
    left, right = make(150, 400), make(40, 30)
    left += left[:20]
    want = [x for x in left if any(x[0] == y[0] and x[1] < y[2] and x[2] > y[1] and x[2] > x[1] and y[2] > y[1] for y in right)]
    kind = "file string, start long, end long, tag int"
    for width in (7, 64, 4096):
        got = spans.overlaps(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), width)
        assert rows(got) == sorted(want, key=str)
    assert spans.overlaps(spark.createDataFrame([], kind), spark.createDataFrame(right, kind)).count() == 0


def test_covering_of_a_hot_file_and_line(spark):
    rng = random.Random(2)
    points = [("hot", rng.choice([5, rng.randint(1, 400)]), i) for i in range(300)] + [("cold", 3, 1), (None, 3, 2), ("hot", None, 3)]
    intervals = [("hot", a := rng.choice([5, rng.randint(1, 400)]), a + rng.choice([0, 0, 3, 90]), rng.randint(1, 5)) for _ in range(500)] + [("cold", 4, 9, 7), (None, 1, 9, 9), ("hot", 9, 2, 9)]
    want = [(*p, max((m for f, a, b, m in intervals if f == p[0] and f and p[1] is not None and a <= p[1] <= b), default=None)) for p in points]
    for width in (4, 64):
        got = spans.covering(spark.createDataFrame(points, "file string, line long, id long"), spark.createDataFrame(intervals, "file string, line long, end_line long, m int"), ["m"], width)
        assert sorted((r.file, r.line, r.id, r.m) for r in got.collect() if r.file and r.line) == sorted(w for w in want if w[0] and w[1])
        assert got.count() == len(points)


def test_seven_buckets(spark):
    sites = [("a", 1, 2, "do-not-translate"), ("a", 2, 2, "translate"), ("a", 3, 3, "locale-marker"), ("a", 4, 9, "needs-judgment"), ("a", 9, 9, "unclassified"), ("a", 10, 10, "unclassified")]
    census = [("a", "read", 1.0, None, "ts"), ("s", "skipped", 1.0, True, "x"), ("r", "read", 1.0, True, "residual-sweep"), ("b", "read", 1.0, False, "md"), ("h", "read", 0.5, True, "md")]
    hits = [("a", 1, "weak"), ("a", 2, "weak"), ("a", 3, "weak"), ("a", 9, "weak"), ("a", 10, "weak"), ("a", 11, "strong"), ("a", 12, "weak"), ("s", 1, "strong"), ("n", 1, "strong"), ("r", 1, "strong"), ("b", 1, "strong"), ("h", 1, "strong")]
    got = audit.hit_buckets(spark.createDataFrame(hits, "file string, line long, confidence string"), spark.createDataFrame(sites, "file string, line long, end_line long, verdict string"), spark.createDataFrame(census, "file string, bucket string, claim_ratio double, byte_addressable boolean, extractor string"))
    assert {(r.file, r.line): r.bucket for r in got.collect()} == {
        ("a", 1): "protected", ("a", 2): "claimed", ("a", 3): "claimed", ("a", 9): "refused", ("a", 10): "surfaced", ("a", 11): "confirmed-miss", ("a", 12): "candidate",
        ("s", 1): "explained-skip", ("n", 1): "explained-skip", ("r", 1): "candidate", ("b", 1): "candidate", ("h", 1): "candidate",
    }


def test_passages_against_containment(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "ccc", "d.", "é", "\\E", "$1", "x\ty", "ab"])
    texts = [(f"f{i}", " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)] + [("n", None), ("e", ""), ("m", "a\n b  bb\n\nccc d.")]
    items = [(i, t[a : a + rng.randint(1, 40)]) for i, (_, t) in enumerate(texts[:40]) for a in [rng.randint(0, max(0, len(t) - 5))]]
    items += [(100, "a"), (101, ""), (102, None), (103, "a b"), (104, "b  bb\n\nccc"), (105, "nowhere"), (106, "\\E"), (107, "a bb ccc nowhere else"), (108, "a")]
    want = [(f, i, len(t[: t.index(p)].encode()), len(t[: t.index(p)].encode()) + len(p.encode()), t.count(p)) for f, t in texts if t for i, p in items if p and p in t]
    for words in (1, 3, 8):
        got = passages.find_passages(spark.createDataFrame(texts, "file string, text string"), spark.createDataFrame(items, "item_id long, text string"), words)
        assert rows(got) == sorted(want, key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert passages.find_passages(spark.createDataFrame(texts, "file string, text string"), none).count() == 0


def test_names_in_shards_and_slices(spark, monkeypatch):
    monkeypatch.setattr(passages, "PER_SHARD", 3)
    monkeypatch.setattr(passages, "PER_GROUP", 50)
    files = [("a.md", "see page-3.html\nnot pag-3\npage-3.htmlx"), ("d/page-3.html", "self page-3.html"), ("b.bin", "page-3.html"), ("c.ts", "Ü.png é"), ("n.md", None)]
    targets = [("d/page-3.html",), ("img/Ü.png",), ("x/none.md",), ("y/",), ("other/page-3.html",), ("d/page-3.html",), *((f"z/{i}q.md",) for i in range(10))]
    got = passages.referrers(spark.createDataFrame(files, "file string, text string"), spark.createDataFrame(targets, "target string"))
    assert rows(got) == sorted([("d/page-3.html", "a.md", 1), ("d/page-3.html", "a.md", 3), ("other/page-3.html", "a.md", 1), ("other/page-3.html", "a.md", 3), ("other/page-3.html", "d/page-3.html", 1), ("img/Ü.png", "c.ts", 1)], key=str)


def test_rulings(spark):
    members = [("open", "a"), ("open", "b"), ("done", "c"), ("done", "d"), ("done", "d"), ("out", "e"), ("stale", "f"), ("gone", "x"), ("mixed", "a"), ("mixed", "c")]
    sites = [(k, f"h{k}") for k in "abcdef"]
    ruled = [("a", "ha", "keep"), ("c", "hc", "exclude"), ("d", "hd", "keep"), ("e", "old", "keep"), ("e", "he", "exclude"), ("f", "old", "exclude")]
    groups, stay = plan.rulings(spark.createDataFrame(members, "group string, site_key string"), spark.createDataFrame(sites, "site_key string, content_hash string"), spark.createDataFrame(ruled, "site_key string, content_hash string, verdict string"))
    assert rows(groups) == sorted([("open", "open", 2, 0), ("done", "resolved", 2, 0), ("out", "all-excluded", 1, 0), ("stale", "open", 1, 1), ("gone", "open", 1, 0), ("mixed", "resolved", 2, 0)], key=str)
    assert rows(stay) == sorted([("open", "a"), ("open", "b"), ("done", "d"), ("stale", "f"), ("gone", "x"), ("mixed", "a")], key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_claims(spark, empty):
    forms = [("f1", "x", "one"), ("f1", "x", "other"), ("f1", "x", "other"), ("f2", "x", "other"), ("f3", "y", "one")]
    asked = [("f1", "x", ["one", "other"]), ("f2", "x", ["one", "other"]), ("g1", "x", ["other", "one"]), ("g2", "y", ["one", "other"]), ("f3", "y", []), ("g3", "y", None), ("g4", "z", []), ("u", "x", ["one"])]
    claims = [] if empty else [("f1",), ("f2",), ("g1",), ("g2",), ("f3",), ("g3",), ("g4",), ("s",), ("f1x",), ("f1x",)]
    got = plural.verify_claims(spark.createDataFrame(claims, "family string"), spark.createDataFrame(asked, "family string, file string, targets array<string>"), spark.createDataFrame(forms, "family string, file string, category string"))
    if empty:
        assert {r.why for r in got.collect()} == {"unclaimed"} and got.count() == len(asked)
        return
    assert {r.family: r.why for r in got.collect()} == {"f1": None, "f2": "forms are missing", "g1": None, "g2": "not seen again", "f3": None, "g3": None, "g4": "not seen again", "u": "unclaimed", "s": "not handed out", "f1x": "not handed out"}
