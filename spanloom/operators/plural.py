"""Plural families: how keys and values spell categories, what a locale lacks, which dialect claims a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cldr
from ..functions.vocab import PLURAL_ORDER

_CATEGORY = "|".join(PLURAL_ORDER)
KEY_SUFFIX = rf"^(.*)[_.]({_CATEGORY}|singular|plural)$"
KEY_CHILD = rf"^(.+)/({_CATEGORY})$"
COUNTS = r"\d|\{[^}]*\}|%[sd@]|%\{|#"
MARKERS = r"(?:^|/)(msgid_plural|msgstr\[\d+\]|numerusform(?:\[\d+\])?|NSStringPluralRuleType|NSStringFormatValueTypeKey)(?:$|/)|/variations/plural/"


def split_key(path: Column) -> tuple[Column, Column]:
    """(base, category) of a key that spells one, as child or as suffix; nulls otherwise."""
    child, suffix = path.rlike(KEY_CHILD), path.rlike(KEY_SUFFIX)
    word = F.regexp_extract(path, KEY_SUFFIX, 2)
    base = F.when(child, F.regexp_extract(path, KEY_CHILD, 1)).when(suffix, F.regexp_extract(path, KEY_SUFFIX, 1))
    category = F.when(child, F.regexp_extract(path, KEY_CHILD, 2)).when(suffix, F.when(word == "singular", "one").when(word == "plural", "other").otherwise(word))
    return base, category


def families(sites: DataFrame) -> DataFrame:
    """file, locale, base, categories (in order), n of sites (file, locale, path, value) that belong to a family."""
    base, category = split_key(F.col("path"))
    forms = sites.select("file", "locale", base.alias("base"), category.alias("category")).filter("base is not null")
    return forms.groupBy("file", "locale", "base").agg(cldr.in_order(F.collect_set("category")).alias("categories"), F.count("*").alias("n"))


def completeness(found: DataFrame, required: DataFrame) -> DataFrame:
    """Families with what their locale requires and they lack, and what they have in excess."""
    met = found.withColumn("lang", cldr.base_language(F.col("locale"))).join(F.broadcast(required), "lang", "left")  # one row a language
    return met.select(*found.columns, F.array_except("required", "categories").alias("missing"), F.array_except("categories", "required").alias("extra"))


def value_split(value: Column) -> Column:
    """Categories with their texts of ``a | b | c`` or ``a |||| b``, null where the value doesn't count."""
    mark = F.when(F.contains(value, F.lit("||||")), r"\|\|\|\|").otherwise(r"\|")
    parts = F.transform(F.split(value, mark), lambda x: F.trim(x))
    n = F.size(parts)
    worded = F.forall(parts, lambda x: x.rlike(r"\p{L}{2,}"))
    ok = value.rlike(COUNTS) & F.contains(value, F.lit("|")) & (n >= 2) & (n <= 3) & worded
    return F.when(ok, F.transform(parts, lambda x, i: F.struct(F.coalesce(cldr.positional(i, n), F.lit("other")).alias("category"), x.alias("text"))))


def claims(candidates: DataFrame) -> DataFrame:
    """Dialects claim sites by precedence: (dialect, precedence, family, site) to the families that stand.

    A site goes to the first dialect that names it, and a family stands only if every site of it does.
    """
    first = candidates.groupBy("site").agg(F.min(F.struct("precedence", "dialect")).alias("winner"))
    met = candidates.join(first, "site").withColumn("won", (F.col("winner.precedence") == F.col("precedence")) & (F.col("winner.dialect") == F.col("dialect")))
    return met.groupBy("dialect", "precedence", "family").agg(F.count("*").alias("sites"), F.min(F.col("won").cast("int")).alias("stands")).filter("stands = 1").drop("stands")


def suspicions(sites: DataFrame) -> DataFrame:
    """site_key, signals of sites (site_key, file, parent, path, value) that look plural."""
    leaf, v = F.element_at(F.split("path", "/"), -1), F.col("value")
    signals = F.array(
        F.when(F.col("path").rlike(MARKERS), "structural-marker"),
        F.when(leaf.rlike(rf"(?:^|[_.\-/\[])({_CATEGORY}|singular|plural)\]?$"), "category-key"),
        F.when(value_split(v).isNotNull(), "delimited-counting"),
    )
    own = sites.select("site_key", F.filter(signals, lambda s: s.isNotNull()).alias("signals"))
    pairs = suffix_pairs(sites).withColumn("signals", F.array(F.lit("sibling-suffix-pair")))
    both = own.union(pairs.select("longer", "signals")).union(pairs.select("shorter", "signals"))
    return both.select("site_key", F.explode("signals").alias("s")).groupBy("site_key").agg(F.array_sort(F.collect_set("s")).alias("signals"))


def suffix_pairs(sites: DataFrame) -> DataFrame:
    """(shorter, longer) siblings where one text is the other with one to three letters more.

    An equality join: each text is offered under itself and under itself less one, two and three letters.
    """
    rows = sites.select("site_key", "file", "parent", "value", F.col("value").rlike(COUNTS).alias("counts"))
    cut = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    stems = rows.select("site_key", "file", "parent", "value", "counts", cut).filter(F.length("value") - F.col("k") >= 3)
    tail = F.expr("right(value, k)")
    stems = stems.filter(tail.rlike(r"^\p{L}+$")).select(F.col("site_key").alias("longer"), "file", "parent", F.expr("left(value, length(value) - k)").alias("stem"), F.col("counts").alias("c2"))
    met = stems.join(rows.withColumnRenamed("value", "stem"), ["file", "parent", "stem"])
    return met.filter("counts or c2").select(F.col("site_key").alias("shorter"), "longer")


def next_site(pragmas: DataFrame, sites: DataFrame) -> DataFrame:
    """Each pragma (file, start, note) with the next site (file, start, site_key) behind it in its file."""
    rows = pragmas.select("file", "start", "note", F.lit(None).cast("string").alias("site_key")).unionByName(sites.select("file", "start", F.lit(None).cast("string").alias("note"), "site_key"))
    ahead = Window.partitionBy("file").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("site", F.first("site_key", ignorenulls=True).over(ahead)).filter("note is not null").select("file", "start", "note", "site")


def verify_claims(claims: DataFrame, handed_out: DataFrame, forms: DataFrame) -> DataFrame:
    """(family, claims, ok, why) of every family that was handed out or is claimed.

    ``claims``: family; ``handed_out``: family, file, targets (array of categories); ``forms``: family, file, category of
    the families that are there now. A claim holds if its family has all its targets or, where the family is gone, if some
    family of the same file has them: a join that asks for containment of sets, by counting the targets that are met, so
    families of a file are never paired without a category in common. Repeated forms count once; no targets are met by
    any family of the file.
    """
    claimed = claims.groupBy("family").agg(F.count("*").alias("claims"))
    asked = handed_out.dropDuplicates(["family"]).select("family", "file", F.array_distinct(F.coalesce("targets", F.array().cast("array<string>"))).alias("targets"))
    have = forms.select(F.col("family").alias("other"), "file", "category").distinct()
    wanted = asked.select("family", "file", F.size("targets").alias("n"), F.explode("targets").alias("category"))
    met = wanted.join(have, ["file", "category"]).groupBy("family", "n", "other").agg(F.count("*").alias("met"))
    full = met.filter("met = n").groupBy("family").agg(F.max(F.col("other") == F.col("family")).alias("own"))
    there = forms.select("family").distinct().withColumn("there", F.lit(True))
    files = forms.select("file").distinct().withColumn("any", F.lit(True))
    rows = asked.join(full, "family", "left").join(there, "family", "left").join(files, "file", "left")
    none = (F.size("targets") == 0) & F.coalesce("any", F.lit(False))
    found = F.when(F.col("there"), F.coalesce("own", F.lit(False)) | (F.size("targets") == 0)).otherwise(F.col("own").isNotNull() | none)
    rows = rows.select("family", F.lit(True).alias("asked"), F.coalesce("there", F.lit(False)).alias("there"), found.alias("found"))
    both = rows.join(claimed, "family", "full").withColumns({"claims": F.coalesce("claims", F.lit(0)), "asked": F.coalesce("asked", F.lit(False))})
    why = (
        F.when(~F.col("asked"), "not handed out")
        .when(F.col("claims") == 0, "unclaimed")
        .when(F.col("claims") > 1, "claimed twice")
        .when(F.col("found"), F.lit(None))
        .when(F.col("there"), "forms are missing")
        .otherwise("not seen again")
    )
    return both.withColumn("why", why).select("family", "claims", F.col("why").isNull().alias("ok"), "why")
