"""Where passages stand word for word in texts, and which texts name a string.

Passages are met by anchors: a run of up to ``words`` of a passage's inner words, which stand whole in any text that
holds the passage, wherever it begins. Texts offer all their runs of such lengths; a run that is an anchor makes a
candidate, and the passage is then looked for in the text itself. Only the few passages without an inner word, and
names, which may stand within words, are looked for by automata, a shard of them at a time.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words here; anchors only have to be found alike on both sides.
SPACE = r"[ \t\n\r\x0B\f]+"
#: Patterns of an automaton, and bytes of text that are searched as one group.
PER_SHARD, PER_GROUP = 50_000, 32 << 20


def _run(words: Column, at: Column, n: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at, n), " "), n)


def _run_at(n: int, at: Column) -> Column:
    return _run(F.col("w"), at, F.lit(n))


def find_passages(files: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """(file, item_id, start, end, n) of passages (item_id, text) that files (file, text) hold word for word: the bytes of
    the first place, and the number of places, counted from left to right without overlap.

    Defined cases: null and empty passages are nowhere, null texts hold nothing; equal passages and repeated files are
    each found; other columns are ignored. Files that hold one anchor without the passage cost a look each.
    """
    wanted = passages.select("item_id", F.col("text").alias("passage")).filter("passage <> ''").withColumn("w", F.split("passage", SPACE))
    inner = F.size("w") - 2
    n = F.least(inner, F.lit(words))
    anchors = wanted.filter(inner > 0).select("item_id", "passage", n.alias("n"), _run(F.col("w"), F.lit(2), n).alias("anchor"))
    sizes = sorted(r[0] for r in anchors.select("n").distinct().collect())  # at most ``words`` numbers
    texts = files.select("file", "text").filter("text <> ''")
    w = texts.select("file", F.split("text", SPACE).alias("w"))
    offers = [F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), partial(_run_at, k)) for k in sizes]
    runs = w.select("file", F.explode(F.array_distinct(F.flatten(F.array(*offers)))).alias("anchor")) if sizes else w.select("file", F.lit(0).cast("long").alias("anchor")).limit(0)
    met = runs.join(anchors.select("item_id", "anchor"), "anchor").select("file", "item_id").distinct()
    short = wanted.filter(inner <= 0).select("item_id", F.col("passage").alias("name"))
    met = met.union(naming(texts, short).select("file", "item_id"))
    both = met.join(wanted.select("item_id", "passage").distinct(), "item_id").join(texts.distinct(), "file")
    at = F.position(F.col("passage"), F.col("text"))
    found = both.withColumn("at", at).filter("at > 0")
    start = F.octet_length(F.expr("substring(text, 1, at - 1)")).cast("long")
    places = F.size(F.split("text", F.concat(F.lit("\\Q"), F.replace("passage", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)) - 1
    return found.select("file", "item_id", start.alias("start"), (start + F.octet_length("passage")).alias("end"), places.cast("long").alias("n"))


def naming(files: DataFrame, names: DataFrame) -> DataFrame:
    """(file, item_id) of ``names`` (item_id, name) that stand anywhere in ``files`` (file, text), once each.

    Names are dealt to shards of a bounded number, texts to slices of a bounded size; each slice meets each shard in one
    group, which builds an automaton of the shard and searches the slice. Empty names and null texts meet nothing.
    """
    names = names.select("item_id", "name").filter("name <> ''")
    texts = files.select("file", "text").filter("text <> ''")
    shards = 1 + names.count() // PER_SHARD
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = 1 + size // PER_GROUP
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(n) - 1).cast("long")))
    left = texts.withColumn("slice", F.pmod(F.xxhash64("file", "text"), F.lit(int(slices)))).withColumn("shard", every(shards))
    right = names.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(int(shards)))).withColumn("slice", every(slices))

    def search(texts: pa.Table, names: pa.Table) -> pa.Table:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        owners: dict[str, list] = {}
        for item, name in zip(names["item_id"].to_pylist(), names["name"].to_pylist(), strict=True):
            owners.setdefault(name, []).append(item)
        for name in owners:
            automaton.add_word(name, name)
        out = []
        if owners:
            automaton.make_automaton()
            for file, text in zip(texts["file"].to_pylist(), texts["text"].to_pylist(), strict=True):
                out += [(file, item) for name in {name for _, name in automaton.iter(text)} for item in owners[name]]
        kind = texts.schema.field("file").type, names.schema.field("item_id").type
        return pa.table([pa.array([r[k] for r in out], kind[k]) for k in (0, 1)], ["file", "item_id"])

    types = dict(files.dtypes) | dict(names.dtypes)
    met = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(search, f"file {types['file']}, item_id {types['item_id']}")
    return met.distinct()


def referrers(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, file, line) of every line of other files that names a target (target: a path) by its last segment.

    Files whose kind has no links are not looked at. Texts without a name are told by the automata and go no further.
    """
    names = targets.select("target").distinct().withColumn("name", F.element_at(F.split("target", "/"), -1)).filter("name <> ''")
    texts = files.filter(F.col("file").rlike(r"\.(md|mdx|html?|[cm]?[jt]sx?|json|ya?ml|css|txt)$")).select("file", "text")
    met = naming(texts, names.select(F.col("name").alias("item_id"), "name")).withColumnRenamed("item_id", "name")
    lines = met.join(texts.filter("text <> ''"), "file").select("file", "name", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    lines = lines.filter(F.contains("value", F.col("name"))).select("file", "name", (F.col("i") + 1).cast("long").alias("line"))
    return lines.join(names, "name").filter("file <> target").select("target", "file", "line")

