"""The script reader: containers of literals by hand, templates of any depth against a generator, broken files."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.sources import inventory, readers
from spanloom.sources.script import comment_body, identifiers, script_spans

PAGE = r"""
import React from 'react';
export { x } from './y';
// Top comment
/**
 * Doc block
 *
 * more
 */
export const WEEKDAY = ['Mon', "Tue"];
const title = `Move ${name} up ${ n > 1 ? `deep ${a ? 's' : ''} x` : "no" } end`
const plural = `pomodoro${n > 1 ? 's' : ''}`
type Status = 'active' | 'done';
enum Channel { Email = 'email', Sms = "sms" }
const re = /['"`]/g, half = a / b / c;
function Page({ user }: Props) {
  if (user.role === 'admin' && /x"y/.test(s)) return <p>Only "admins" can't see</p>;
  localStorage.setItem('theme-key', 'dark');
  switch (mode) {
    case 'sync': return 'Synchronising now';
    default: return cond ? 'Yes please' : 'No thanks';
  }
  return (
    <Layout title="Caf&eacute; menu" onAdopt={() => save('adopted it')} empty={<p>No projects yet</p>} wide>
      {/* jsx comment */}
      Hello <b className={clsx('a-b', on && "c-d")}>bold {user.name} text</b>, welcome
      {items.map(i => <li key={i}>Item label</li>)}
      <Foo<string> label='x y' />
      <>frag text</>
    </Layout>
  );
}
const css1 = css`color: red;`;
const d = styled.div`margin: 0`;
const obj = { 'Content-Type': 'text/html', label: 'Save file', nested: { deep: "Deep value" }, method() { return 'from method' } };
class A { greet(name) { return 'Hello from class' } static label = 'Static label' }
expect(screen.getByText('Hi there')).toBe('final value')
const schema = z.enum(['one', 'two']);
if (list.includes('member')) {}
const f = <T,>(x: T) => x;
const g = a < b && c > d;
const bad = "no end
const after = 'still read';
export default { name: 'Default name' }
"""

#: value: (path, facts that hold)
EXPECTED = {
    "react": (None, {"module_specifier"}),
    "./y": (None, {"module_specifier"}),
    "Top comment": ("comment[0]", set()),
    "Doc block\n\nmore": ("comment[1]", set()),
    "Mon": ("WEEKDAY/[0]", set()),
    "Tue": ("WEEKDAY/[1]", set()),
    "Move {0} up {1} end": ("title", set()),
    "pomodoro{0}": ("plural", {"grammar_hole"}),
    "active": ("Status", {"enum_member"}),
    "done": ("Status~2", {"enum_member"}),
    "email": ("Channel/Email", {"enum_member"}),
    "sms": ("Channel/Sms", {"enum_member"}),
    "admin": ("Page", {"compared"}),
    "Only \"admins\" can't see": ("Page/p", {"element=p"}),
    "theme-key": ("Page/localStorage.setItem()/[0]", {"callee=localStorage.setItem", "persisted"}),
    "dark": ("Page/localStorage.setItem()/[1]", {"callee=localStorage.setItem", "persisted"}),
    "sync": ("Page/case[sync]", {"compared"}),
    "Synchronising now": ("Page/case[sync]~2", set()),
    "Yes please": ("Page/case[default]/?then", set()),
    "No thanks": ("Page/case[default]/?else", set()),
    "Café menu": ("Page/Layout/@title", {"attr=title", "element=Layout"}),
    "adopted it": ("Page/Layout/@onAdopt/save()/[0]", {"attr=onAdopt", "callee=save", "element=Layout"}),
    "No projects yet": ("Page/Layout/@empty/p", {"attr=empty", "element=p"}),
    "jsx comment": ("comment[2]", set()),
    "Hello": ("Page/Layout", {"element=Layout"}),
    "a-b": ("Page/Layout/b/@className/clsx()/[0]", {"attr=className", "callee=clsx", "element=b"}),
    "c-d": ("Page/Layout/b/@className/clsx()/[1]", {"attr=className", "callee=clsx", "element=b"}),
    "bold": ("Page/Layout/b", {"element=b"}),
    "text": ("Page/Layout/b~2", {"element=b"}),
    ", welcome": ("Page/Layout~2", {"element=Layout"}),
    "Item label": ("Page/Layout/items.map()/li", {"element=li"}),
    "x y": ("Page/Layout/Foo/@label", {"attr=label", "element=Foo"}),
    "frag text": ("Page/Layout/fragment", {"element=fragment"}),
    "color: red;": ("css1", {"tag=css"}),
    "margin: 0": ("d", {"tag=styled.div"}),
    "Content-Type": ("obj/Content-Type", {"is_key"}),
    "text/html": ("obj/Content-Type~2", set()),
    "Save file": ("obj/label", set()),
    "Deep value": ("obj/nested/deep", set()),
    "from method": ("obj/method/method", set()),
    "Hello from class": ("A/greet", set()),
    "Static label": ("A/label", set()),
    "Hi there": ("expect()/screen.getByText()/[0]", {"callee=screen.getByText"}),
    "final value": ("expect(screen.getByText('Hi there')).toBe()/[0]", {"callee=expect(screen.getByText('Hi there')).toBe"}),
    "one": ("schema/z.enum()/[0]", {"callee=z.enum", "enum_member"}),
    "two": ("schema/z.enum()/[1]", {"callee=z.enum", "enum_member"}),
    "member": ("list.includes()/[0]", {"callee=list.includes", "compared"}),
    "still read": ("after", set()),
    "Default name": ("default/name", set()),
}
SHOWN = ("attr", "element", "tag", "callee", "is_key", "module_specifier", "compared", "persisted", "enum_member", "grammar_hole")


def test_containers():
    found = {}
    for path, _, a, b, value, facts in script_spans(PAGE, "src/page.tsx"):
        assert PAGE[a:b]
        found[value] = (path, {n if facts[n] is True else f"{n}={facts[n]}" for n in SHOWN if facts.get(n)})
    assert {*found} == {*EXPECTED}
    for value, (path, facts) in EXPECTED.items():
        assert found[value][1] == facts and path in (None, found[value][0]), value
    holes = next(f["holes"] for *_, v, f in script_spans(PAGE) if v.startswith("Move"))
    assert holes == ["name", "n > 1 ? `deep ${a ? 's' : ''} x` : \"no\""]
    branches = {v: f["branch_group"] for *_, v, f in script_spans(PAGE) if f.get("branch_group")}
    assert branches["Yes please"] == branches["No thanks"] != branches["Synchronising now"] == branches["sync"]
    assert {"useState", "React", "className", "Foo"} - {*identifiers(PAGE)} == {"useState", "Foo"}


def template(rng, depth):
    """(source, value, holes) of a random template."""
    source, value, holes = "`", "", []
    for _ in range(rng.randint(0, 4)):
        if depth and rng.random() < 0.6:
            inner = [template(rng, depth - 1)[0] if rng.random() < 0.6 else rng.choice(["'a}b'", '"`"', "x", "/[}`]/", "{ k: '}' }", "f({a: [1]})", "/* } */ y"]) for _ in range(rng.randint(1, 3))]
            expr = " + ".join(inner)
            source, value = source + "${" + expr + "}", value + f"{{{len(holes)}}}"
            holes.append(expr)
        else:
            text = rng.choice(["plain", "it's", "$5", "{", "}", '"', "\\`", "\\${", "\\n", "é 🙂"])
            source, value = source + text, value + {"\\`": "`", "\\${": "${", "\\n": "\n"}.get(text, text)
    return source + "`", value, holes


def test_nested_templates_against_their_generator():
    rng = random.Random(7)
    for _ in range(2000):
        made = [template(rng, rng.randint(0, 5)) for _ in range(3)]
        text = "f(" + made[0][0] + ");\nconst b = " + made[1][0] + " + 'x';\nreturn <p title={" + made[2][0] + "}>t</p>"
        found = [(v, f["holes"]) for _, k, *_, v, f in script_spans(text) if k in ("template", "attr")]
        assert found == [(v, h) for _, v, h in made], text


@pytest.mark.parametrize("name", ["a.tsx", "a.ts"])
def test_broken_scripts(name):
    for cut in range(0, len(PAGE), 3):
        for piece in (PAGE[:cut], PAGE[cut:]):
            for _, kind, a, b, _, _ in script_spans(piece, name):
                assert 0 <= a <= b <= len(piece) and (kind not in ("string", "template") or a)
    for odd in ("`${", "<a", "<a b=", "<p>{", "'", '"', "/", "/*", "}}))]]", "<></>", "<", "a<b>c", "`${`${`", "\\", "class", "enum {", "case", "x ? y", "=> {"):
        assert len([*script_spans(odd, name)]) <= 1


def test_time_is_in_proportion_to_the_text():
    for unit in ("<p>", "`${", "((", "{", "f('x', ", "a ? 'b' : ", "// c\n", "<a b='c' ", "'q' + ", "const a = 'x'\n"):
        began = time.perf_counter()
        assert [*script_spans(unit * 4000, "a.tsx")] is not None
        assert time.perf_counter() - began < 20, unit


def test_comment_bodies():
    assert comment_body("//! note ") == "note "
    assert comment_body("/* one */") == "one"
    assert comment_body("/**\n   * a\n   *\n   *  b\n   */") == "a\n\n b"


def test_sites_carry_facts_and_bytes(spark):
    from spanloom.sources import inventory

    text = "é('x');\nconst t = <Ü title='ß é'>größe</Ü>"
    df = spark.createDataFrame([("a.test.tsx", text), ("b.html", "<p title='t'>x</p>"), ("c.json", '{"k": "v"}'), ("n.ts", None), ("z.py", '"""d"""')], "file string, text string")
    rows = inventory.sites(df).collect()
    assert all(text.encode()[r.start : r.end].decode() == r.raw for r in rows if r.file == "a.test.tsx")
    assert {(r.file, r.kind, r.value, r.attr, r.element, r.is_key, r.in_test, r.docstring, r.tier) for r in rows} == {
        ("a.test.tsx", "string", "x", "", "", False, True, False, "ast"),
        ("a.test.tsx", "attr", "ß é", "title", "Ü", False, True, False, "ast"),
        ("a.test.tsx", "jsx-text", "größe", "", "Ü", False, True, False, "ast"),
        ("b.html", "attr", "t", "title", "p", False, False, False, "structural"),
        ("b.html", "prose-run", "x", "", "", False, False, False, "structural"),
        ("c.json", "key", "k", "", "", True, False, False, "structural"),
        ("c.json", "string", "v", "", "", False, False, False, "structural"),
        ("z.py", "comment", "d", "", "", False, False, True, "lexical"),
    }
    assert readers.located("", "script") == [] and inventory.sites(df.limit(0)).count() == 0


def test_dual_use_tells_text_from_its_enumeration(spark):
    from spanloom.sources import inventory

    df = spark.createDataFrame([("a.ts", "type S = 'done' | 'open'"), ("b.tsx", "<b>done</b>"), ("c.ts", "if (x === 'late') f('early')")], "file string, text string")
    assert {(r.value, r.dual_use) for r in inventory.with_dual_use(inventory.sites(df)).collect()} == {("done", False), ("done", True), ("open", False), ("late", False), ("early", False)}


def test_dual_use_by_digests_is_that_by_values(spark):
    files = [("a.ts", 'if (k === "done") f("open", "late");\n'), ("b.tsx", 'const t = "done";\nenum E { A = "open" }\n'), (None, 'x = "done"; y = "é 🙂";'), ("c.ts", None), ("d.json", '{"manifest_version": "late"}'), ("b.tsx", 'const u = "open";'), ("e.ts", 'localStorage.setItem("é 🙂", "v");\n')]
    df = spark.createDataFrame(files, "file string, text string")
    df = df.withColumn("format", F.when(F.col("file").isNull(), "script"))
    old, new = inventory.with_dual_use(inventory.sites(df)), inventory.sites_with_dual_use(df, ["/manifest_version"])
    row = ("file", "path", "value", "start", "dual_use")
    assert sorted(map(str, new.select(*row).collect())) == sorted(map(str, old.select(*row).collect()))
    assert new.filter("dual_use").count() > 2
    assert {r.file for r in new.filter("size(held) > 0").collect()} == {"d.json"}


def test_verdicts_shuffle_no_values(spark):
    """Values are met by digests, and what no branch holds isn't shuffled with its text."""
    plan = catalog.queries()["inventory_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(value" not in plan and plan.count("Exchange hashpartitioning(file") <= 1
