"""G6: what sites say must hold together: locale marks, duplicates, links to headings, holes of templates, plural families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import finding

# Reasons under which a text counts as one of a set that is to agree.
AGREEING = ("already-target-language", "source-locale-bundle", "other-locale-bundle")


def slug(heading: Column) -> Column:
    """The anchor that a heading makes: lower case, without marks, a hyphen for each space."""
    return F.replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))


def unique_paths(sites: DataFrame) -> DataFrame:
    """``sites`` (file, path, kind, start, ...) with paths that tell all sites of a file apart, and ``renamed``.

    Of sites of one path the first keeps it, values before keys, then by place; the others get a number behind it. A key
    and its own value share a path by nature, so that is no surprise (``renamed`` is false). Numbers skip what is a path
    of its own: numbered paths are looked up by an equality join.
    """
    of_path = Window.partitionBy("file", "path")
    order = of_path.orderBy((F.col("kind") == "key").cast("int"), "start", "kind")
    ranked = sites.withColumns({"_n": F.row_number().over(order), "_all": F.count("*").over(of_path), "_keys": F.sum((F.col("kind") == "key").cast("int")).over(of_path)})
    # paths that look like a numbered one of another path that repeats
    taken = sites.select("file", F.regexp_extract("path", r"^(.*)~(\d+)$", 1).alias("_of"), F.regexp_extract("path", r"^(.*)~(\d+)$", 2).cast("int").alias("_t")).filter("_of <> '' and _t >= 2").distinct()
    taken = taken.groupBy("file", F.col("_of").alias("path")).agg(F.array_sort(F.collect_list("_t")).alias("_taken"))
    met = ranked.join(taken, ["file", "path"], "left")
    # the number of a site counts those taken below it
    n = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda acc, t: F.when(t <= acc, acc + 1).otherwise(acc))
    path = F.when(F.col("_n") == 1, F.col("path")).otherwise(F.concat("path", F.lit("~"), n.cast("string")))
    out = met.withColumns({"_path": path, "renamed": (F.col("_n") > 1) & ~((F.col("_all") == 2) & (F.col("_keys") == 1))})
    return out.select(*(F.col("_path").alias("path") if c == "path" else F.col(c) for c in sites.columns), "renamed")


def g6_coherence(sites: DataFrame, families: DataFrame, target: str) -> DataFrame:
    """Findings of five kinds. ``sites``: file, site_key, path, extractor, value, raw, verdict, reason, dup_key, detected, holes
    (numbers of holes that must stay); ``families``: file, site_key, missing, extra (arrays of categories).

    Every kind is a join or an aggregation by equality: groups of duplicates are combined before they are shuffled, and
    links meet headings by their anchor. Null values find nothing.
    """
    base = F.lower(F.element_at(F.split("value", "[-_]"), 1))
    drift = finding(sites.filter((F.col("verdict") == "locale-marker") & (base != "") & (base != target)), "G6", "locale-drift", F.concat(F.lit("declares "), "value"))

    agree = sites.filter((F.col("verdict") == "translate") | F.col("reason").isin(*AGREEING)).groupBy("dup_key").agg(F.array_sort(F.collect_set("detected")).alias("langs"), F.min(F.struct("file", "site_key")).alias("first"))
    agree = agree.filter(F.size("langs") > 1).select(F.col("first.file").alias("file"), F.col("first.site_key").alias("site_key"), "langs")
    diverging = finding(agree, "G6", "duplicate-divergence", F.concat(F.lit("the same text is in "), F.array_join("langs", " and ")))

    prose = sites.filter("extractor = 'markdown'")
    slugs = prose.filter(F.col("path").rlike(r"^h\d")).select(slug(F.col("value")).alias("anchor")).distinct()
    links = prose.select("file", "site_key", F.explode(F.regexp_extract_all("raw", F.lit(r"\]\(#([^)]+)\)"), F.lit(1))).alias("anchor")).withColumn("anchor", F.lower("anchor"))
    some = slugs.limit(1).select(F.lit(True).alias("some"))
    dangling = links.join(slugs, "anchor", "left_anti").join(F.broadcast(some))  # one row, if there are headings at all
    broken = finding(dangling, "G6", "anchor-drift", F.concat(F.lit("links to #"), "anchor"))

    lost = sites.select("file", "site_key", "value", F.explode("holes").alias("hole")).filter(~F.contains("value", F.concat(F.lit("{"), F.col("hole").cast("string"), F.lit("}"))))
    holes = finding(lost, "G6", "hole-loss", F.concat(F.lit("placeholder {"), F.col("hole").cast("string"), F.lit("} is missing")))

    said = F.concat_ws(", and ", F.when(F.size("missing") > 0, F.concat(F.lit("no "), F.array_join("missing", " or "))), F.when(F.size("extra") > 0, F.concat(F.lit("more "), F.array_join("extra", " and "))))
    plural = finding(families.filter((F.size("missing") > 0) | (F.size("extra") > 0)), "G6", "plural-incomplete", said)
    return drift.union(diverging).union(broken).union(holes).union(plural)
