"""The rule catalog over sites: one generated CASE, in order of precedence, so that no shuffle is needed.

A site's facts are file, path (a JSON pointer, or the reader's own path), and where known element and attr. The first
hard rule wins, else the first rule. Rules that ask for another pointer in the same file take the files that hold it by
a join. Defined cases: null facts match nothing; a site without a rule has null columns; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rule_data import RULES, VENDORED
from ..functions.rx import glob_filter
from ..functions.vocab import first_match
from ..sources import inventory
from . import classify

FIELDS = ("rule", "matcher", "files", "pattern", "surface", "verdict", "reason", "hard")
OUT = ("rule", "rule_surface", "rule_verdict", "rule_reason", "rule_hard")


def catalog(text: str = RULES) -> list[dict[str, str]]:
    """The rows of a rule table; those that are hard come first."""
    rows = [dict(zip(FIELDS, (x.strip() for x in re.split(r"(?<!\S)\|(?!\S)", line)), strict=True)) for line in text.splitlines()]
    return sorted(rows, key=lambda r: r["hard"] != "hard")


def pointer_pattern(pointer: str) -> str:
    """A JSON pointer with * for one segment and ** for any number of them, as a regular expression."""
    parts = ("(?:/.*)?" if x == "**" else "/[^/]+" if x == "*" else "/" + re.escape(x) for x in pointer.split("/")[1:])
    return f"^{''.join(parts)}$"


def _needs(rule: dict[str, str]) -> str | None:
    words = rule["pattern"].split()
    return words[1] if words[:1] == ["needs"] else None


def needs(rules: list[dict[str, str]]) -> list[str]:
    """The pointers that rules ask of a file."""
    return sorted({p for r in rules if (p := _needs(r))})


def _holds(rule: dict[str, str], fact: dict[str, Column], needed: dict[str, Column]) -> Column:
    files = [g for x in rule["files"].split() for g in (VENDORED.split() if x == "~" else [x])]
    met, words = glob_filter(fact["file"], files), rule["pattern"].split()
    match rule["matcher"]:
        case "pointer":
            if need := _needs(rule):
                met, words = met & needed[need], words[2:]
            return met & reduce(lambda a, b: a | b, (fact["path"].rlike(pointer_pattern(p)) for p in words))
        case "path":
            return met & fact["path"].rlike(rule["pattern"])
        case "key":
            return met & F.substring_index(fact["path"], "/", -1).rlike(rule["pattern"])
        case "attr":
            return met & fact["element"].rlike(words[0]) & fact["attr"].rlike(words[1])
    return met


def match_rules(sites: DataFrame, rules: list[dict[str, str]] | None = None) -> DataFrame:
    """``sites`` with rule, rule_surface, rule_verdict, rule_reason and rule_hard (see ``classify.FACTS``). held, if it is
    there, are the pointers that a site's file holds, and is dropped; else they are found by a join."""
    rules = rules if rules is not None else catalog()
    out, needed = sites.drop(*OUT), {}
    for i, pointer in enumerate(needs(rules)):
        if "held" in sites.columns:
            needed[pointer] = F.coalesce(F.array_contains("held", pointer), F.lit(False))
            continue
        holders = sites.filter(F.col("path") == pointer).select("file").distinct().withColumn(f"_needs{i}", F.lit(True))
        out = out.join(holders, "file", "left")
        needed[pointer] = F.coalesce(F.col(f"_needs{i}"), F.lit(False))
    present = {*sites.columns}
    fact = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in present else F.lit("") for n in ("file", "path", "element", "attr")}

    def says(r: dict[str, str]) -> Column:
        lit = lambda x: F.lit(x or None).cast("string")
        return F.struct(lit(r["rule"]).alias("rule"), lit(r["surface"]).alias("surface"), lit(r["verdict"]).alias("verdict"), lit(r["reason"]).alias("reason"), F.lit(r["hard"] == "hard").alias("hard"))

    none = F.lit(None).cast("struct<rule:string,surface:string,verdict:string,reason:string,hard:boolean>")
    hit = first_match([(_holds(r, fact, needed), says(r)) for r in rules], none)
    out = out.withColumn("_hit", hit)
    kept = [c for c in sites.columns if c not in (*OUT, "held")]
    return out.select(*kept, *(F.col(f"_hit.{n.removeprefix('rule_')}").alias(n) for n in OUT))


def verdicts(files: DataFrame, source: str, target: str, rules: list[dict[str, str]] | None = None) -> DataFrame:
    """Files to verdicts in one plan: readers, container facts, dual use, rules, language, cascade and harmonised branches."""
    rules = rules if rules is not None else catalog()
    found = inventory.sites_with_dual_use(files, needs(rules)).withColumn("branch_group", F.nullif("branch_group", F.lit("")))
    return classify.harmonise(classify.classify(match_rules(found, rules), source, target))
