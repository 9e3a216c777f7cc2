"""Readers against public parsers on generated files: every string at its path, with its value and its bytes."""

from __future__ import annotations

import json
import random
import tomllib

import pytest

from spanloom.sources import readers

STRINGS = ["", "a", "plain text", "it's", 'say "x"', "a: b", "# no", "- dash", "x #y", "é 🙂", "back\\slash", "[x]", "{y}", "tab\there", "true", "12", "null", "~", "many words that go on and on so that a writer breaks the line somewhere in between", "two\nlines", "a\n\nb\n", " lead", "trail ", "&a", "*b", "!c", "|", "%", "@", "`", ",", "a,b", "http://x.y/z", "key:", "?"]
KEYS = ["a", "b c", "d.e", "f/g", "h~i", "é", "it's", 'q"r', "k-1", "1", "x:y", "#z", "-", "- a"]


def tree(rng, depth, keys=KEYS, top=True):
    if top or (depth and rng.random() < 0.5):
        if top or rng.random() < 0.6:
            return {k: tree(rng, depth - 1, keys, False) for k in rng.sample(keys, rng.randint(1, 4))}
        return [tree(rng, depth - 1, keys, False) for _ in range(rng.randint(1, 4))]
    return rng.choice(STRINGS) if rng.random() < 0.85 else rng.choice([1, 2.5, True])


def leaves(x, path=""):
    if isinstance(x, dict):
        return {p: v for k, y in x.items() for p, v in leaves(y, path + readers.segment(k)).items()}
    if isinstance(x, list):
        return {p: v for i, y in enumerate(x) for p, v in leaves(y, f"{path}/{i}").items()}
    return {path: x}


def held(text, kind, truth, bare=()):
    """Strings are found at their paths; what else is found are values of other kinds."""
    found = readers.located(text, kind)
    for _, _, start, end, _, _, raw, _ in found:
        assert text.encode()[start:end].decode() == raw
    values = {p: v for p, k, *_, v in found if k not in ("key", "comment")}
    want = {p: v for p, v in leaves(truth).items() if isinstance(v, str)}
    assert {p: values.get(p) for p in want} == want, text
    assert {p for p in {*values} - {*want}} <= {p for p, v in leaves(truth).items() if not isinstance(v, str)}, text


def test_yaml_against_pyyaml():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(1)
    for _ in range(600):
        data = tree(rng, 4)
        style = rng.choice([None, None, '"', "'"])
        text = yaml.safe_dump(data, allow_unicode=rng.random() < 0.7, width=rng.choice([20, 40, 1000]), indent=rng.choice([2, 4]), default_flow_style=rng.choice([None, False, False, True]), default_style=style, sort_keys=False, explicit_start=rng.random() < 0.3)
        if "\n? " in "\n" + text or " ? " in text:  # complex keys are left out
            continue
        truth = yaml.safe_load(text)
        held(text, "yaml", truth)


def test_yaml_by_hand():
    text = 'a: "foo\n  bar\n\n  baz"\nb: plain\n  goes on\n  # no more\n---\nc: [x, "y", {k: v, w: [z]}, ] # t\nd: &n !!str one\ne: *n\nf: \'it\'\'s\n  two\'\n'
    values = {p: v for p, k, *_, v in readers.located(text, "yaml") if k not in ("key", "comment")}
    assert values == {"/a": "foo bar\nbaz", "/b": "plain goes on", "/c/0": "x", "/c/1": "y", "/c/2/k": "v", "/c/2/w/0": "z", "/d": "one", "/f": "it's two"}


def toml_value(rng, x, depth=0):
    if isinstance(x, str):
        if rng.random() < 0.3 and not set(x) & {"'", "\n", "\t"}:
            return f"'{x}'"
        if rng.random() < 0.2 and '"""' not in x and not x.endswith(("\\", '"')):
            return '"""' + "\n" * (rng.random() < 0.5 or x.startswith("\n")) + x.replace("\\", "\\\\") + '"""'
        return json.dumps(x, ensure_ascii=rng.random() < 0.3 and all(ord(c) < 0x10000 for c in x))
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        gap = rng.choice([" ", "\n  # note\n  "])
        return f"[{gap}" + f",{gap}".join(toml_value(rng, y, depth + 1) for y in x) + rng.choice(["", ","]) + "]"
    if isinstance(x, dict):
        return "{ " + ", ".join(f"{toml_key(rng, k)} = {toml_value(rng, y, depth + 1)}" for k, y in x.items()) + " }"
    return str(x)


def toml_key(rng, k):
    return k if all(c.isascii() and (c.isalnum() or c in "-_") for c in k) and rng.random() < 0.7 else json.dumps(k, ensure_ascii=False)


def toml_file(rng, data, at=""):
    here, later = "", ""
    for k, v in data.items():
        name = at + toml_key(rng, k)
        if isinstance(v, dict) and rng.random() < 0.7:
            later += f"[{name}]" + rng.choice(["", " # c"]) + "\n" + toml_file(rng, v, name + ".")
        elif isinstance(v, list) and v and all(isinstance(y, dict) for y in v):
            later += "".join(f"[[ {name} ]]\n" + toml_file(rng, y, name + ".") for y in v)
        else:
            here += f"{toml_key(rng, k)} = {toml_value(rng, v)}" + rng.choice(["", "  # note"]) + "\n"
    return here + later


def test_toml_against_the_library():
    rng, done = random.Random(2), 0
    for _ in range(800):
        data = tree(rng, 4)
        if rng.random() < 0.5:
            data["many"] = [tree(rng, 2), {"in": [tree(rng, 1), tree(rng, 1)]}]
        text = toml_file(rng, data)
        try:
            truth = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            continue
        held(text, "toml", truth)
        done += 1
    assert done > 500


def test_toml_by_hand():
    text = 'a.b = "x"\n"c d".e = "z"\n[[a1]]\nk = "1"\n[[a1.b]]\nk = "2"\n[[a1]]\n[[a1.b]]\nk = "3"\nt = { u = "4", v = { w = ["5"] } }\n'
    assert {p: v for p, k, *_, v in readers.located(text, "toml") if k != "comment"} == {"/a/b": "x", "/c d/e": "z", "/a1/0/k": "1", "/a1/0/b/0/k": "2", "/a1/1/b/0/k": "3", "/a1/1/b/0/t/u": "4", "/a1/1/b/0/t/v/w/0": "5"}


def test_json_with_bare_keys_and_single_quotes():
    rng = random.Random(3)

    def show(x):
        if isinstance(x, dict):
            return "{" + ", ".join((k if k.isidentifier() and k.isascii() and rng.random() < 0.6 else show(k)) + ": " + show(v) for k, v in x.items()) + rng.choice(["", ","]) + "}"
        if isinstance(x, list):
            return "[" + ", ".join(map(show, x)) + "]"
        if isinstance(x, str) and rng.random() < 0.5:
            return "'" + json.dumps(x)[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
        return json.dumps(x) + rng.choice(["", " /* c */", " // d\n"])

    for _ in range(500):
        data = tree(rng, 4)
        held(show(data), "json", data)


def test_gettext_strings_of_several_lines():
    text = '# c\n#, fuzzy\nmsgid ""\n"one "\n"two"\nmsgstr "un "\n"deux\\n"\n\n#~ msgid "old"\n#~ msgstr "vieux"\nmsgid "three"\nmsgstr ""\n'
    found = readers.located(text, "po")
    assert [(p, v) for p, k, *_, v in found if k == "string"] == [("/0/msgid", "one two"), ("/0/msgstr", "un deux\n"), ("/1/msgid", "three")]
    assert [v for _, k, *_, v in found if k == "comment"] == ["# c", "#, fuzzy"]


def test_markup_names_are_equal_whatever_their_case():
    found = readers.located("<P>one</p><b>two</B>three", "markup")
    assert [(p, v) for p, *_, v in found] == [("P/text[0]", "one"), ("b/text[1]", "two"), ("/text[2]", "three")]
