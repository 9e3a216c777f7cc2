"""ICU and Fluent grammars against generators that know the arms, written messages read back, resources by hand."""

from __future__ import annotations

import random
import time

import pytest

from spanloom.functions import cldr, messages
from spanloom.operators import messages as M
from spanloom.sources import fluent

PLAIN = ["text", "it's", "l'été", "''", "'{'", "'}{ x'", "'#'", "# items", "é 🙂", ", ", "|", "other"]


def icu(rng, depth):
    """(source, arms as (name, type, offset, selector, body) outside in by argument, placeholders)."""
    source, mine, below, names = "", [], [], []
    for _ in range(rng.randint(0, 3)):
        roll = rng.random()
        if depth and roll < 0.5:
            name, kind, offset = rng.choice(["n", "a.b", "user_name", "x-1"]), rng.choice(["plural", "selectordinal", "select"]), rng.choice([None, None, 1, -2])
            offset = offset if kind == "plural" else None
            arms = []
            for selector in rng.sample(["=0", "=1", "one", "few", "many", "other", "male"], rng.randint(1, 3)):
                body, arms_, nested, more = icu(rng, depth - 1)
                arms.append((name, kind, offset, selector, body))
                below += [(arms_, nested)]
                names += more
            space = rng.choice(["", " ", "\n  "])
            source += "{" + rng.choice(["", " "]) + name + " , " + kind + "," + (f" offset:{offset}" if offset is not None else "") + "".join(f"{space or ' '}{s}{space}{{{b}}}" for _, _, _, s, b in arms) + rng.choice(["", " "]) + "}"
            mine.append(arms)
        elif roll < 0.7:
            name = rng.choice(["who", "when"])
            source += "{" + name + rng.choice(["", ", number", " , date, short"]) + "}"
            names.append(name)
        else:
            source += rng.choice(PLAIN) + " "
    return source, mine, below, names


def level_order(mine, below):
    """Arms by argument, outside in and from left to right, as a scan numbers them."""
    out, level = [], [(mine, below)]
    while level:
        nxt = []
        for own, nested in level:
            out += own
            nxt += nested
        level = nxt
    return [a for arms in out for a in arms]


def test_icu_arms_against_their_generator():
    rng = random.Random(1)
    for _ in range(1500):
        source, mine, below, names = icu(rng, rng.randint(0, 4))
        scan = messages.scan_icu(source)
        assert scan.ok
        assert [(a.name, a.type, a.offset, a.selector, source[a.body_start : a.body_end]) for a in scan.arms] == level_order(mine, below), source
        assert sorted(scan.placeholders) == sorted(names)
        assert all(source[a.start] == "{" and source[a.end - 1] == "}" for a in scan.arms)
        for a in scan.arms:
            assert a.parent < 0 or scan.arms[a.parent].body_start <= a.start < a.end <= scan.arms[a.parent].body_end
            assert a.category == (a.selector if a.selector in cldr.PLURAL_ORDER and a.type != "select" else None)


@pytest.mark.parametrize("text,ok,arms,names", [
    ("{n, plural, one {a} other {b}", False, [], []),
    ("x } y {n}", True, [], ["n"]),
    ("{n, plural, }", True, [], ["n"]),
    ("{n, plural, one a}", True, [], ["n"]),
    ("{n, plural, one {a} broken", False, [], []),
    ("{a b, plural, one {x}}", True, [], ["a b", "x"][:1]),
    ("'{n, plural, one {a}}'", True, [], []),
    ("{}", True, [], []),
])
def test_icu_that_is_broken_or_quoted(text, ok, arms, names):
    scan = messages.scan_icu(text)
    assert (scan.ok, scan.arms, scan.placeholders) == (ok, arms, names)


def test_icu_is_written_back():
    text = "{n, plural, offset:1 =1 {x} =0 {none} one {# thing} other {{g, select, male {his} other {its}} '{'things'}'}}"
    arms = [a for a in messages.scan_icu(text).arms if a.depth == 0]
    bodies = {a.selector: text[a.body_start : a.body_end] for a in arms}
    again = messages.write_icu("n", "plural", 1, bodies | {"few": "few things"})
    assert again == "{n, plural, offset:1 =0 {none} =1 {x} one {# thing} few {few things} other {{g, select, male {his} other {its}} '{'things'}'}}"
    assert {a.selector: again[a.body_start : a.body_end] for a in messages.scan_icu(again).arms if a.depth == 0} == bodies | {"few": "few things"}


def ftl(rng, depth):
    source, mine, below, names = "", [], [], []
    for _ in range(rng.randint(1, 3)):
        roll = rng.random()
        if depth and roll < 0.5:
            selector = rng.choice(["$n", "NUMBER($n, a: 1)", "-brand.x", "other"])
            keys = rng.sample(["one", "few", "other", "0", "1.5", "a-b"], rng.randint(1, 3))
            star, arms = rng.choice(keys), []
            for key in keys:
                body, arms_, nested, more = ftl(rng, depth - 1)
                arms.append((selector, key, key == star, body.strip()))
                below.append((arms_, nested))
                names += more
            source += f"{{ {selector} ->\n" + "".join(f"   {'*' if d else ' '}[{k}] {b}\n" for _, k, d, b in arms) + "}"
            mine.append(arms)
        elif roll < 0.7:
            name = rng.choice(["$who", '"{"', '"}"', "DATE($d)"])
            source += f"{{ {name} }}"
            names.append(name)
        else:
            source += rng.choice(["some text ", "é 🙂 ", "a -> b ", "star * here ", "it's "])
    return source, mine, below, names


def test_fluent_arms_against_their_generator():
    rng = random.Random(2)
    for _ in range(1500):
        source, mine, below, names = ftl(rng, rng.randint(0, 4))
        scan = messages.scan_fluent(source)
        assert scan.ok, source
        assert [(a.name, a.selector, a.default, source[a.body_start : a.body_end].strip()) for a in scan.arms] == level_order(mine, below), source
        assert sorted(scan.placeholders) == sorted(names)


def test_fluent_is_written_back():
    out = messages.write_fluent("$n", {"one": "One", "few": " Few { $n } ", "other": "Many"}, "other")
    assert out == "{ $n ->\n    [one] One\n    [few] Few { $n }\n   *[other] Many\n}"
    assert [(a.selector, a.default, out[a.body_start : a.body_end].strip()) for a in messages.scan_fluent(out).arms] == [("one", False, "One"), ("few", False, "Few { $n }"), ("other", True, "Many")]
    assert not messages.scan_fluent("{ $n ->\n [one] a\n [other] b\n}").ok  # no default
    assert not messages.scan_fluent("{ $n ->\n *[one] a").ok
    with pytest.raises(ValueError, match="default"):
        messages.write_fluent("$n", {"one": "a"}, "other")


def test_fluent_resources_and_junk():
    text = "# note\nhello = Hi\n    more é\n\n    last\n    .title = T\n      wide\n-term = Q\njunk here\nsel =\n    { $n ->\n        [one] One\n       *[other] Many\n}\n\nempty =\n    .only = A\n 12 = no\nx = { \"{\" } y"
    found = [(e.kind, e.id, [(p.name, p.text) for p in e.patterns]) for e in fluent.entries(text)]
    assert found == [
        ("comment", "", []),
        ("message", "hello", [("", "Hi\nmore é\n\nlast"), ("title", "T\nwide")]),
        ("term", "-term", [("", "Q")]),
        ("junk", "", []),
        ("message", "sel", [("", "{ $n ->\n[one] One\n*[other] Many\n}")]),
        ("message", "empty", [("only", "A\n12 = no")]),
        ("message", "x", [("", '{ "{" } y')]),
    ]
    for e in fluent.entries(text):
        for p in e.patterns:
            assert [x.strip() for x in text[p.start : p.end].split("\n")] == p.text.split("\n")


@pytest.mark.parametrize("scan,unit", [(messages.scan_icu, "{n, plural, other {"), (messages.scan_icu, "{a} '{' "), (messages.scan_icu, "{n, plural, one {a} other {b}} "), (messages.scan_fluent, "{ $n ->\n *[a] "), (messages.scan_fluent, "{ $n ->\n [a] x *[b] y }\n")])
def test_time_is_in_proportion(scan, unit):
    closed = unit * 20_000 + ("}}" * 20_000 if unit.count("{") == 2 and unit.count("}") == 0 else "}" * 20_000 if unit.count("}") == 0 else "")
    began = time.perf_counter()
    scan(unit * 20_000)
    if scan is messages.scan_icu:
        scan(closed)
    assert time.perf_counter() - began < 20


def test_arms_families_and_messages_for_a_locale(spark):
    rows = [("a", "en", "{n, plural, one {# file} other {# files}}"), ("b", "ru", "{n, plural, one {x} other {y}} and {m, plural, =0 {no} other {z}}"), ("c", "ja", "no arms"), ("d", "en", None), ("e", "xx", "{n, plural, other {q}}"), ("e", "xx", "{n, plural, other {q}}"), ("f", "en", "{n, plural, one {a}")]
    sites = spark.createDataFrame(rows, "site_key string, locale string, value string")
    arms = M.arms(sites, "icu")
    assert sorted((r.site_key, r.argument, r.selector, r.body) for r in arms.collect()) == sorted([("a", 0, "one", "# file"), ("a", 0, "other", "# files"), ("b", 0, "one", "x"), ("b", 0, "other", "y"), ("b", 1, "=0", "no"), ("b", 1, "other", "z"), ("e", 0, "other", "q"), ("e", 0, "other", "q")])
    assert sorted((r.site_key, r.argument, r.categories, r.n) for r in M.families(arms).collect()) == [("a", 0, ["one", "other"], 2), ("b", 0, ["one", "other"], 2), ("b", 1, ["other"], 2), ("e", 0, ["other"], 2)]
    got = {r.site_key: r.written for r in M.for_locale(sites, cldr.table(spark)).collect()}
    assert got == {"a": rows[0][2], "b": "{n, plural, one {x} few {y} many {y} other {y}} and {m, plural, =0 {no} one {z} few {z} many {z} other {z}}", "c": "no arms", "d": None, "e": rows[4][2], "f": rows[6][2]}
    assert M.arms(sites.limit(0), "fluent").count() == 0
