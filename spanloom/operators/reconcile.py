"""Reconciling two snapshots of sites: the same, moved, renumbered, added, removed."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinal_distance(a: str, b: str) -> float:
    """The largest difference of numbers in two keys of one shape, else infinity."""
    if re.sub(r"\d+", "#", a) != re.sub(r"\d+", "#", b):
        return float("inf")
    return max((abs(int(x) - int(y)) for x, y in zip(re.findall(r"\d+", a), re.findall(r"\d+", b), strict=True)), default=0)


def _renumber(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy, one to one, in key order: a current site takes the first previous one within three."""
    before, taken, out = sorted(pdf.loc[pdf.side == "p", "site_key"]), set(), []
    by_shape = defaultdict(list)
    for k in before:
        by_shape[re.sub(r"\d+", "#", k)].append(k)
    for cur in sorted(pdf.loc[pdf.side == "c", "site_key"]):
        hit = next((p for p in by_shape[re.sub(r"\d+", "#", cur)] if p not in taken and ordinal_distance(p, cur) <= 3), None)
        if hit is not None:
            taken.add(hit)
            out.append((hit, cur))
    return pd.DataFrame(out, columns=["previous", "current"])


def reconcile(previous: DataFrame, current: DataFrame) -> DataFrame:
    """tier, previous, current (site keys) of two snapshots with site_key, file, surface, content_hash, dup_key."""
    same = current.join(previous.select("site_key"), "site_key", "left_semi").select(F.lit("same").alias("tier"), F.col("site_key").alias("previous"), F.col("site_key").alias("current"))
    p = previous.join(current.select("site_key"), "site_key", "left_anti")
    c = current.join(previous.select("site_key"), "site_key", "left_anti")
    key = ["file", "surface", "content_hash"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("site_key"))
    pn, cn = (x.withColumn("k", nth) for x in (p, c))
    moved = cn.select(*key, "k", F.col("site_key").alias("current")).join(pn.select(*key, "k", F.col("site_key").alias("previous")), [*key, "k"]).select(F.lit("moved").alias("tier"), "previous", "current")
    p = p.join(moved.select(F.col("previous").alias("site_key")), "site_key", "left_anti")
    c = c.join(moved.select(F.col("current").alias("site_key")), "site_key", "left_anti")
    key = ["file", "surface", "dup_key"]
    sides = p.select(*key, "site_key", F.lit("p").alias("side")).union(c.select(*key, "site_key", F.lit("c").alias("side")))
    near = sides.groupBy(*key).applyInPandas(_renumber, "previous string, current string").select(F.lit("renumbered").alias("tier"), "previous", "current")
    none = F.lit(None).cast("string")
    added = c.join(near.select(F.col("current").alias("site_key")), "site_key", "left_anti").select(F.lit("added").alias("tier"), none.alias("previous"), F.col("site_key").alias("current"))
    removed = p.join(near.select(F.col("previous").alias("site_key")), "site_key", "left_anti").select(F.lit("removed").alias("tier"), F.col("site_key").alias("previous"), none.alias("current"))
    return same.union(moved).union(near).union(added).union(removed)
