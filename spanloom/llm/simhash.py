"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So every distinct
fingerprint emits its whole ball of radius r, fingerprints that meet in a value are linked, and as all that meet in one
value are within 2r of each other, a chain through them (verified) stands for all their links.

A ball has 2081 values at r = 2, so values are shuffled by their leading ``k`` bits, not one by one: a fingerprint goes
once to every prefix that its ball reaches (37 of 256 at k = 8), and the task that holds a prefix spells out the values
there. A crowded prefix is split on further bits, within fixed memory.

Defined cases: a null text counts as empty and has fingerprint zero, like a text of white space alone, and is linked
like any other; a text of fewer words than a shingle is one shingle; rows are linked by their fingerprints alone, so
rows of one id, or of none, are separate rows; a component without any id has a null component_id; other columns are
ignored; an empty table gives no rows. All rows with one fingerprint are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written
from .components import components

#: Values of balls that a task spells out at a time.
AT_ONCE = 400_000


def _bits(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of each run of hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_texts(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: ASCII lower case, ASCII white space, XXH64 of word shingles."""
    from xxhash import xxh64_intdigest

    digest, out = partial(xxh64_intdigest, seed=seed), np.zeros(len(texts), np.uint64)
    parts, where, total = [], [], 0

    def flush() -> None:
        nonlocal total
        if parts:
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            out[where] = _bits(np.concatenate(parts), np.cumsum(counts) - counts, counts)
        parts.clear()
        where.clear()
        total = 0

    for i, text in enumerate(texts):
        w = (text or "").encode().lower().split()  # of bytes, both work on ASCII alone
        if not w:
            continue
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        parts.append(np.fromiter(map(digest, shingles), np.uint64, max(1, len(w) - words + 1)))
        where.append(i)
        total += len(parts[-1])
        if total > 100_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, words: int = 4, *more: Column) -> DataFrame:
    """doc_id with its fingerprint as a signed long, and ``more``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                prints = fingerprint_texts(part.column(1).to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(prints)], [*(f.name for f in kept), "fp"])

    return rows.mapInArrow(run, StructType([*kept, StructField("fp", LongType())]))


@lru_cache(maxsize=256)
def _masks(bits: int, most: int) -> np.ndarray:
    """All values of up to ``most`` ones among the low ``bits``."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] and b[i] in the forest of least labels."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _meet(fps: np.ndarray, own: np.ndarray, spare: np.ndarray, bits: int, label: np.ndarray) -> None:
    """Unites those of ``own`` whose balls share a value; ``spare``: flips that each has left for the low ``bits``."""
    if len(own) < 2:
        return
    sizes = np.array([sum(math.comb(bits, j) for j in range(n + 1)) for n in range(3)])
    if bits > 4 and sizes[spare].sum() > AT_ONCE:
        low = bits - 4
        nibble = (fps[own] >> np.uint64(low)) & np.uint64(15)
        for value in range(16):
            left = spare - np.bitwise_count(nibble ^ np.uint64(value)).astype(np.int64)
            _meet(fps, own[left >= 0], left[left >= 0], low, label)
        return
    tail = np.uint64((1 << bits) - 1)
    values, owners = [], []
    for n in range(3):
        if len(some := own[spare == n]):
            masks = _masks(bits, n)
            values.append((fps[some] & tail)[:, None] ^ masks[None, :])
            owners.append(np.repeat(some, len(masks)))
            values[-1] = values[-1].ravel()
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    same = np.flatnonzero(values[1:] == values[:-1])
    a, b = owners[same], owners[same + 1]
    apart = label[a] != label[b]
    pairs = np.unique(np.minimum(a, b)[apart] << 32 | np.maximum(a, b)[apart])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 4
    _merge(label, a[near], b[near])


def _in_prefix(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Edges of a spanning forest of the fingerprints whose balls meet within one prefix."""
    signed = np.sort(pdf["fp"].to_numpy())
    fps = signed.view(np.uint64)
    spare = 2 - np.bitwise_count((fps >> np.uint64(64 - k)) ^ np.uint64(pdf["prefix"].iloc[0])).astype(np.int64)
    label = np.arange(len(fps))
    _meet(fps, np.arange(len(fps)), spare, 64 - k, label)
    child = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": signed[child], "b": signed[label[child]]})


def _grouped(prints: DataFrame, per_prefix: int) -> DataFrame:
    """(fp, group: the least fingerprint that links reach) of the distinct fingerprints among ``prints``.

    The prefix length follows the number of distinct fingerprints, about ``per_prefix`` to a prefix.
    """
    nodes = written(prints.select("fp").distinct(), "nodes")
    k = min(24, max(4, math.ceil(math.log2(max(1, nodes.count()) / per_prefix))))
    flips = F.array(*(F.lit(int(m)).cast("long") for m in _masks(k, 2)))
    home = F.shiftrightunsigned("fp", 64 - k)
    balls = nodes.select("fp", F.explode(F.transform(flips, lambda m: home.bitwiseXOR(m))).alias("prefix"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return _in_prefix(pdf, k)

    edges = balls.groupBy("prefix").applyInPandas(link, "a long, b long")
    return nodes.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, words: int = 4, per_prefix: int = 1000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that chains of links of 4 bits or fewer reach."""
    prints = written(fingerprints(docs, words), "fingerprints")
    groups = written(_grouped(prints, per_prefix), "groups")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("id")).join(groups, "fp").groupBy("group").agg(F.min("id").alias("component_id"))
    return prints.join(groups.join(least, "group"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 4, per_prefix: int = 1000) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null last; ties: the least digest of the text).

    Rows are told apart by doc_id and text, so different texts under one doc_id, or under none, stay or go by their own
    component; of rows that repeat a doc_id and a text one stays at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.sha2(text, 256).alias("digest"), F.struct("*").alias("row"))
    prints = written(fingerprints(docs, words, F.sha2(text, 256).alias("digest")), "fingerprints").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "digest")
    of_print = written(prints.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    stay = of_print.join(_grouped(of_print, per_prefix), "fp").groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.id").alias("stays"), F.col("first.digest").alias("d"))
    met = keyed.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("digest") == F.col("d")), "left_semi")
    return met.dropDuplicates(["id", "digest"]).select("row.*")
