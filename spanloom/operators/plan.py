"""Translation planning: groups of equal text and role, hazards, mirrors, batches, glossary slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.vocab import CONFLICTING, first_match

BATCH = 8
GLOSSARY_TERMS = 25


def role_of(surface: Column, kind: Column, raw: Column, value: Column) -> Column:
    long = F.length(value) > 48
    return first_match(
        [
            (surface.isin("doc.markdown-prose", "doc.changelog"), F.when((kind == "prose-run") & raw.startswith("#"), "doc-heading").otherwise("doc-prose")),
            (surface.isin("ui.release-notes", "comment.line", "comment.block", "comment.docstring"), F.lit("doc-prose")),
            (surface.isin("meta.head", "meta.package.description", "meta.webmanifest", "meta.extension-manifest", "meta.oci-label", "meta.store-listing"), F.lit("paragraph")),
            (surface == "error.message", F.lit("error")),
            (surface == "log.message", F.lit("status")),
            (surface == "ui.issue-form", F.lit("label")),
            (surface == "ui.attribute-text", F.lit("aria-label")),
            (surface == "ui.jsx-text", F.when(long, "paragraph").otherwise("button")),
        ],
        F.when(long, "paragraph").otherwise("label"),
    )


def role_class(role: Column) -> Column:
    return F.when(role.isin("button", "link", "tab", "menu-item", "label", "heading"), "ui-short").when(role.isin("aria-label", "alt", "title-attr"), "a11y").when(role.isin("doc-prose", "doc-heading"), "doc").otherwise("ui-long")


def max_length(cls: Column, value: Column) -> Column:
    """Short texts of an interface get a budget of characters, others none."""
    return F.when(cls == "ui-short", (F.ceil(F.length(value) * 1.35) + 4).cast("long"))


def group_key(value: Column, cls: Column, holes: Column) -> Column:
    return F.sha2(F.concat(identity.collapsed(value), F.lit("\x00"), cls, F.lit("\x00"), F.when(holes, "holes").otherwise("plain")), 256)


def groups(sites: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """One row a group of sites to translate: id, text, role_class, status, max, sites, norm.

    ``sites``: site_key, value, role, verdict, reason, has_holes, grammar_hole. ``memory``: norm, role_class, text.
    A text that is an identifier elsewhere makes its group a hazard; the first site by key lends its wording.
    """
    norm, cls = identity.collapsed(F.col("value")), role_class(F.col("role"))
    rows = sites.withColumns({"norm": norm, "role_class": cls})
    rows = rows.withColumn("key", group_key(F.col("value"), F.col("role_class"), F.col("has_holes")))
    out = rows.filter("verdict = 'translate'").groupBy("key", "norm", "role_class").agg(F.min(F.struct("site_key", "value")).alias("first"), F.count("*").alias("sites"), F.max("grammar_hole").alias("grammar"))
    conflict = rows.filter((F.col("verdict") == "do-not-translate") & F.col("reason").isin(*CONFLICTING)).select("norm").distinct().withColumn("conflicts", F.lit(True))
    out = out.join(conflict, "norm", "left")
    if memory is not None:
        out = out.join(memory.select("norm", "role_class", F.col("text").alias("memo")), ["norm", "role_class"], "left")
    memo = F.col("memo") if memory is not None else F.lit(None).cast("string")
    status = F.when(F.col("grammar"), "structural").when(F.col("conflicts"), "hazard").when(memo.isNotNull(), "memo").otherwise("pending")
    value = F.col("first.value")
    return out.select(F.concat(F.lit("g_"), F.substring("key", 1, 12)).alias("id"), value.alias("text"), "role_class", status.alias("status"), max_length(F.col("role_class"), value).alias("max"), "sites", "norm")


def mirrors(sites: DataFrame, planned: DataFrame) -> DataFrame:
    """Test fixtures with the group whose text they assert."""
    tests = sites.filter("reason = 'test-fixture'").select("site_key", identity.collapsed(F.col("value")).alias("norm"))
    return tests.join(planned.groupBy("norm").agg(F.max("id").alias("group_id")), "norm").select("site_key", "group_id")


def unlinked(sites: DataFrame, planned: DataFrame) -> DataFrame:
    """Test fixtures that read like copy and match no group."""
    copy = F.col("value").rlike(r"\p{L}{2,}\s+\p{L}{2,}") | (F.length("value") >= 8)
    tests = sites.filter((F.col("reason") == "test-fixture") & copy).withColumn("norm", identity.collapsed(F.col("value")))
    return tests.join(planned.select("norm").distinct(), "norm", "left_anti").select("site_key", "value")


def ranked(rows: DataFrame, order: str, prefix: int = 3) -> DataFrame:
    """``rows`` with ``position`` from 0 in the order of a hexadecimal column, without one task that sorts all.

    Rows are counted by the leading digits of ``order``; only those counts, 16 to the ``prefix`` at most, meet in one
    place. Positions within a prefix are counted in its own partition.
    """
    cut = F.substring(order, 1, prefix + 2)
    with_cut = rows.withColumn("_cut", cut)
    counts = with_cut.groupBy("_cut").agg(F.count("*").alias("n"))
    before = counts.select(F.col("_cut").alias("_k"), F.coalesce(F.sum("n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cut").orderBy(order)) - 1
    return with_cut.withColumn("_in", inside).join(F.broadcast(before), F.col("_cut") == F.col("_k")).withColumn("position", F.col("_in") + F.col("_before")).drop("_cut", "_k", "_before", "_in")  # 4096 prefixes at most


def batches(planned: DataFrame, size: int = BATCH) -> DataFrame:
    """Pending groups in batches in the order of their ids: batch_id, digest, items."""
    items = ranked(planned.filter("status = 'pending'"), "id").withColumn("batch", F.floor(F.col("position") / size))
    out = items.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", "text", "max"))).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws("\x01", x["id"], x["text"], F.coalesce(x["max"].cast("string"), F.lit("")))), "\x02")
    return out.select(F.format_string("%03d", F.col("batch")).alias("batch_id"), F.substring(F.sha2(text, 256), 1, 16).alias("digest"), F.size("items").cast("long").alias("n_items"), F.transform("items", lambda x: x["id"]).alias("ids"))


def fold(planned: DataFrame, answers: DataFrame, violations: DataFrame) -> DataFrame:
    """id, outcome of answers (id, text, refuse) to groups: accepted, rejected, refused, unknown or missing."""
    bad = violations.filter("severity = 'reject'").select(F.col("id").alias("_b")).distinct()
    met = planned.select(F.col("id").alias("_g")).join(answers, F.col("_g") == F.col("id"), "full_outer").join(bad, F.col("id") == F.col("_b"), "left")
    outcome = F.when(F.col("_g").isNull(), "unknown").when(F.col("id").isNull(), "missing").when(F.col("refuse").isNotNull(), "refused").when(F.col("text").isNull() | F.col("_b").isNotNull(), "rejected").otherwise("accepted")
    return met.select(F.coalesce("id", "_g").alias("id"), outcome.alias("outcome"))


def glossary_slices(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(batch_id, term) of one-word terms that occur in a batch's texts, by a join on words, the first of them by term."""
    words = items.select("batch_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))).alias("word")).distinct()
    found = words.join(terms.select(F.lower("term").alias("word"), "term"), "word").select("batch_id", "term").distinct()
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy("term"))
    return found.withColumn("k", rank).filter(F.col("k") <= GLOSSARY_TERMS).drop("k")


def rulings(members: DataFrame, sites: DataFrame, ruled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rulings decide about groups of sites: (group, status, n, stale) and the members that stay (group, site_key).

    ``members``: group, site_key; ``sites``: site_key, content_hash; ``ruled``: site_key, content_hash, verdict (``exclude``
    or another). A group is decided only if every member has a ruling about the bytes that it has now (a division by the
    rulings that hold): ``all-excluded`` if each is excluded, else ``resolved``, and those excluded leave it. Otherwise it
    is ``open`` and all stay. ``stale``: rulings on other bytes. Of several rulings on a site one that excludes counts.
    Repeated members count once; a member that is no site keeps its group open.
    """
    own = members.select("group", "site_key").distinct()
    latest = ruled.groupBy("site_key", F.col("content_hash").alias("ruled_hash")).agg(F.max(F.col("verdict") == "exclude").alias("excluded"))
    by_site = latest.groupBy("site_key").agg(F.collect_list(F.struct("ruled_hash", "excluded")).alias("given"))
    held = F.filter("given", lambda g: g["ruled_hash"] == F.col("content_hash"))
    met = own.join(sites.select("site_key", "content_hash").distinct(), "site_key", "left").join(by_site, "site_key", "left")
    met = met.select("group", "site_key", F.get(held, F.lit(0))["excluded"].alias("excluded"), (F.coalesce(F.size("given"), F.lit(0)) > 0).alias("given"))
    met = met.withColumn("stale", F.col("given") & F.col("excluded").isNull())
    decided, out = F.count("excluded") == F.count("*"), F.sum(F.coalesce(F.col("excluded"), F.lit(False)).cast("int")) == F.count("*")
    groups = met.groupBy("group").agg(F.when(~decided, "open").when(out, "all-excluded").otherwise("resolved").alias("status"), F.count("*").alias("n"), F.sum(F.col("stale").cast("int")).cast("long").alias("stale"))
    stay = met.join(groups.select("group", "status"), "group").filter("status = 'open' or not excluded").select("group", "site_key")
    return groups, stay
