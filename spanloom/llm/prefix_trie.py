"""Prefix trie of conversations, its subtree totals by leaf-peeling message passing.

Every turn gets a digest; digests along a conversation, each tied to its depth, are combined into a digest of every
prefix, in two steps (within blocks of turns, then over blocks), so that a conversation of very many turns is spread
over tasks. A node is a distinct prefix.

Subtree totals pass upwards by peeling. So that rounds follow the branchings and not the depth, each node belongs to
the path of its longest member (ties: the least conversation), which is one branch down to a leaf; a path hangs on a
node of another. Each path holds a counter of the paths that still hang on its nodes. A round takes the paths whose
counters are zero, sends their totals to the nodes they hang on, combined by receiver before the shuffle, and takes
the arrivals off the receivers' counters; at last only the root's path finishes. Totals of the nodes along a path are
then sums from its leaf upwards of own and received figures, again in two steps.

Defined cases: null roles and texts count as empty; turns are ordered by turn (null first), role and text; a null
conversation is one conversation, sorted first, whose decimal is empty; conversations without turns are members of the
root; repeated rows are turns of their own; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns or nodes that are summed in one group.
BLOCK = 256
#: Stands for a null conversation inside.
NO_ID = -(1 << 63)
#: Ids of one piece of a list of members.
IDS_AT_ONCE = 2000

WORDS = "[^\\x20\\x09-\\x0D]+"


def _same(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)


def _running(rows: DataFrame, key: str, place: str, sums: dict[str, tuple[str, str]], up: bool = False) -> DataFrame:
    """``rows`` with running aggregates by ``key`` in the order of ``place`` (``up``: from the last to the first), the row
    itself included. sums: name to (aggregate ``sum`` or ``bit_xor``, column)."""
    of = {"sum": F.sum, "bit_xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    rows = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    order = (lambda c: F.col(c).desc()) if up else F.col
    inside = Window.partitionBy(key, "_block").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(*(of[f](c).alias(n) for n, (f, c) in sums.items()))
    blocks = blocks.select("_k", "_b", *(F.coalesce(of[f](n).over(before), F.lit(0)).alias(f"_{n}") for n, (f, _) in sums.items()))
    rows = rows.withColumns({n: of[f](c).over(inside) for n, (f, c) in sums.items()})
    met = rows.join(blocks, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    return met.withColumns({n: join[f](F.col(n), F.col(f"_{n}")) for n, (f, _) in sums.items()}).drop("_k", "_b", "_block", *(f"_{n}" for n in sums))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, place (from 1), a and b (digest of role and text, 120 bits), words (in the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        *(F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(n) for n, at in (("a", 1), ("b", 16))),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    counts = rows.groupBy(F.col("conv").alias("c"), F.col("block").alias("k")).agg(F.count("*").alias("n"))
    counts = counts.select("c", "k", F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    met = rows.join(counts, _same("conv", "c") & _same("block", "k"))
    return met.select("conv", (F.col("place") + F.col("before")).alias("place"), "a", "b", "words")


def rebuilt_turns(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns: conv, depth, a, b, words; conversations: conv, length) after each conversation's first h turns are
    replaced by those of the first conversation of its group, h being the crc32 of its decimal id modulo ``most``."""
    rows = written(numbered_turns(turns), "turns")
    convs = rows.groupBy("conv").agg(F.count("*").alias("own"))
    decimal = F.when(F.col("conv") == NO_ID, "").otherwise(F.col("conv").cast("string"))
    convs = convs.withColumns({"h": F.crc32(decimal.cast("binary")) % most, "base": F.when(F.col("conv") == NO_ID, F.col("conv")).otherwise(F.col("conv") - F.col("conv") % group)})
    there = convs.select(F.col("conv").alias("there"), F.col("own").alias("theirs"))
    convs = convs.join(there, _same("base", "there"), "left").select("conv", "own", "h", "base", F.least(F.col("h"), F.coalesce("theirs", F.lit(0))).alias("head"))
    convs = written(convs, "conversations")
    heads = rows.filter(F.col("place") < most).withColumnRenamed("conv", "there")
    heads = convs.filter("head > 0").join(heads, _same("base", "there") & (F.col("place") <= F.col("head"))).select("conv", F.col("place").alias("depth"), "a", "b", "words")
    shift = convs.select(F.col("conv").alias("c"), "h", "head")
    tails = rows.join(shift, _same("conv", "c")).filter("place > h").select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "a", "b", "words")
    length = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.union(tails), convs.select("conv", length.alias("length"))


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each conversation and depth, 0 included: conv, length, depth, x and y (digest of the prefix), px and py
    (of the prefix one turn shorter), words (in the last text)."""
    at = turns.withColumns({"mx": F.xxhash64("depth", "a", "b"), "my": F.xxhash64("b", "a", "depth")})
    at = _running(at, "conv", "depth", {"x": ("bit_xor", "mx"), "y": ("bit_xor", "my")})
    ends = convs.select(F.col("conv").alias("c"), "length")
    at = at.join(ends, _same("conv", "c")).select("conv", "length", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("mx")).alias("px"), F.col("y").bitwiseXOR(F.col("my")).alias("py"), "words")
    nil = F.lit(0).cast("long")
    root = convs.select("conv", "length", nil.alias("depth"), nil.alias("x"), nil.alias("y"), nil.alias("px"), nil.alias("py"), nil.alias("words"))
    return at.withColumn("depth", F.col("depth").cast("long")).union(root)


def trie_nodes(members: DataFrame) -> DataFrame:
    """One row a node: depth, x, y, conv (least member), n_convs, n_children, words, path (its longest member; ties: the
    least), parent_conv and parent_path (the root: null)."""
    nodes = members.groupBy("depth", "x", "y").agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        F.min(F.struct((-F.col("length")).alias("n"), "conv"))["conv"].alias("path"),
        F.first("px").alias("px"),
        F.first("py").alias("py"),
        F.first("words").alias("words"),
    )
    nodes = written(nodes, "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("d"), F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, _same("depth", "d") & _same("x", "cx") & _same("y", "cy"), "left").drop("d", "cx", "cy").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    above = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("d"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("conv").alias("parent_conv"), F.col("path").alias("parent_path"))
    return nodes.join(above, _same("depth", "d") & _same("px", "ux") & _same("py", "uy"), "left").drop("d", "ux", "uy", "px", "py")


def peel(nodes: DataFrame) -> DataFrame:
    """Messages between paths: path and depth of the node that receives, with the leaves and tokens that it is sent."""
    own = (F.col("n_convs") - 1) * F.col("words")
    top = F.min(F.struct("depth", "parent_path"))
    paths = nodes.groupBy("path").agg(top.alias("top"), F.sum(own).alias("tokens")).select("path", F.col("top.parent_path").alias("up"), (F.col("top.depth") - 1).alias("at"), F.lit(1).cast("long").alias("leaves"), "tokens")
    paths = written(paths, "paths")
    hanging = paths.filter("up is not null").groupBy(F.col("up").alias("p")).agg(F.count("*").alias("waits"))
    live = written(paths.join(hanging, _same("path", "p"), "left").drop("p").withColumn("waits", F.coalesce("waits", F.lit(0))), "live")
    sent = None
    while True:
        done = live.filter("waits = 0 and up is not null").groupBy("up", "at").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        done = written(done, "messages")
        if done.isEmpty():
            return done if sent is None else sent
        sent = done if sent is None else sent.union(done)
        got = done.groupBy(F.col("up").alias("p")).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"), F.sum("n").alias("n"))
        rest = live.filter("waits > 0").join(got, _same("path", "p"), "left")
        more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        live = written(rest.select("path", "up", "at", more("leaves", "l"), more("tokens", "t"), (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits")), "live")


def totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees."""
    sent = peel(nodes).groupBy(F.col("up").alias("p"), F.col("at").alias("d")).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"))
    met = nodes.join(sent, _same("path", "p") & _same("depth", "d"), "left").drop("p", "d")
    met = met.withColumns({"l": F.coalesce("l", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0), "t": F.coalesce("t", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")})
    return _running(met, "path", "depth", {"n_leaves": ("sum", "l"), "saved_tokens": ("sum", "t")}, up=True).drop("l", "t")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (depth, x, y, conv): joined decimals of up to IDS_AT_ONCE members of a node, with the first of them."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        text = ",".join("" if i == NO_ID else str(i) for i in ids)
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "x", "y"), key, strict=True)) | {"first": ids[0], "ids": text}])

    for batch in batches:
        for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (k != key or len(ids) == IDS_AT_ONCE):
                yield piece()
                ids = []
            key = k
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by node and first member: the digest of each node's pieces, one piece at a time."""
    key, digest, out = None, None, []
    for batch in batches:
        for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    out.append([*key, digest.hexdigest()])
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) > 5000:
            yield _rows(out)
            out = []
    if key is not None:
        out.append([*key, digest.hexdigest()])
    if out:
        yield _rows(out)


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("d", "ex", "ey", "ends"), r, strict=True)) for r in rows])


def end_digests(members: DataFrame) -> DataFrame:
    """d, ex, ey, ends: SHA-256 of the decimal ids, ascending, of the conversations that end at a node. The ids are dealt
    by ranges and joined into pieces, so that a node at which very many end sends its one digest's task few rows."""
    ends = members.filter("depth = length").select("depth", "x", "y", "conv")
    order = ["depth", "x", "y", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, x long, y long, first long, ids string")
    pieces = pieces.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first")
    return pieces.mapInArrow(_digests, "d long, ex long, ey long, ends string")


def prefix_trie(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the
    rebuilt conversations."""
    members = written(memberships(*rebuilt_turns(turns, group, most)), "members")
    nodes = totals(written(trie_nodes(members), "trie"))
    met = nodes.join(end_digests(members), _same("depth", "d") & _same("x", "ex") & _same("y", "ey"), "left")
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return met.select(
        own("conv").alias("conv_id"),
        "depth",
        own("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
