"""Exact deduplication over a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text's UTF-8 bytes, with their number. Every task keeps an index of the digests it has
met: a cuckoo filter of short fingerprints says "surely new" or "perhaps known", and a hit is verified against the
content kept for its bucket (the whole digest and length). Tasks first combine what their own rows repeat, so a text
that a third of all rows share reaches its shard as one row from each task; the shards' indexes combine those. A task
hands on what it combined whenever its index is full, and the number of shards follows the number of rows, so no index
grows with the input.

Defined cases: a null text counts as empty; empty texts are equal to each other; rows that repeat a doc_id and a text
count in the group and share its fate; the row with the largest doc_id stays (null ids are smallest); other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

WAYS, KICKS = 4, 64
LEAST = -(1 << 63)
#: Digests in an index: a task's own is emptied there, and there is a shard for each so many rows.
INDEX_ROWS = 400_000


class CuckooIndex:
    """Live digests with their content. ``insert`` and ``delete`` keep a count; the last deletion removes the digest."""

    def __init__(self, buckets: int = 256):
        self.live: dict[int, list[list]] = {}
        self._random = random.Random(0)
        self._fresh(buckets)

    def _fresh(self, buckets: int) -> None:
        self.buckets, self.mask, self.size = buckets, buckets - 1, 0
        self.filter = [0] * (buckets * WAYS)

    @staticmethod
    def _mark(digest: bytes) -> tuple[int, int]:
        """(fingerprint, 1 to 65535; hash) of a digest."""
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[2:10], "little")

    def _pair(self, mark: int, at: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def _put(self, mark: int, at: int) -> bool:
        for _ in range(KICKS):
            for at in (at, self._pair(mark, at)):  # noqa: B020
                row = range(at * WAYS, at * WAYS + WAYS)
                for i in row:
                    if not self.filter[i]:
                        self.filter[i] = mark
                        return True
            i = self._random.choice(row)
            mark, self.filter[i] = self.filter[i], mark
            at = self._pair(mark, at)
        return False

    def _grow(self) -> None:
        """Overflow: a filter of twice the size, built again from the stored keys."""
        entries = [x for xs in self.live.values() for x in xs]
        size = self.buckets * 2
        while True:
            self._fresh(size)
            self.live = {}
            for x in entries:
                self.live.setdefault(self._mark(x[0])[1] & self.mask, []).append(x)
            if all(self._put((m := self._mark(x[0]))[0], m[1] & self.mask) for x in entries):
                self.size = len(entries)
                return
            size *= 2

    def may_hold(self, digest: bytes) -> bool:
        mark, h = self._mark(digest)
        at = h & self.mask
        other = self._pair(mark, at)
        return mark in self.filter[at * WAYS : at * WAYS + WAYS] or mark in self.filter[other * WAYS : other * WAYS + WAYS]

    def find(self, digest: bytes, length: int) -> list | None:
        """The entry [digest, length, keep, count] after a verified hit, else None."""
        if not self.may_hold(digest):
            return None
        return next((x for x in self.live.get(self._mark(digest)[1] & self.mask, ()) if x[0] == digest and x[1] == length), None)

    def insert(self, digest: bytes, length: int, keep: int, count: int = 1) -> None:
        if entry := self.find(digest, length):
            entry[2], entry[3] = max(entry[2], keep), entry[3] + count
            return
        mark, h = self._mark(digest)
        self.live.setdefault(h & self.mask, []).append([digest, length, keep, count])
        self.size += 1
        if self.size > self.buckets * WAYS * 0.9 or not self._put(mark, h & self.mask):
            self._grow()

    def delete(self, digest: bytes, length: int, count: int = 1) -> bool:
        """Takes ``count`` off; False if the digest isn't live."""
        if (entry := self.find(digest, length)) is None:
            return False
        entry[3] -= count
        if entry[3] <= 0:
            mark, h = self._mark(digest)
            at = h & self.mask
            self.live[at].remove(entry)
            self.size -= 1
            for b in (at, self._pair(mark, at)):
                row = self.filter[b * WAYS : b * WAYS + WAYS]
                if mark in row:
                    self.filter[b * WAYS + row.index(mark)] = 0
                    break
        return True

    def entries(self) -> Iterator[list]:
        return (x for xs in self.live.values() for x in xs)


CLASSES = "digest binary, n_bytes long, keep_id long, n long"


def _combine(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (digest, n_bytes, keep_id, n); n is negative for what is to be deleted, after all insertions.

    With ``most``, digests are handed on whenever the index holds so many, and combined later.
    """
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, length, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keep = LEAST if keep is None else keep
            if n > 0:
                index.insert(digest, length, keep, n)
            else:
                gone.append((digest, length, keep, n))
        if most is not None and index.size + len(gone) >= most:
            yield from _rows([*map(tuple, index.entries()), *gone])
            index, gone = CuckooIndex(), []
    rest = [x for x in gone if not index.delete(x[0], x[1], -x[3])]
    yield from _rows([*map(tuple, index.entries()), *rest])


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        cols = [*zip(*rows[at : at + 10_000], strict=True)]
        keep = [None if k == LEAST else k for k in cols[2]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(keep, pa.int64()), pa.array(cols[3], pa.int64())], ["digest", "n_bytes", "keep_id", "n"])


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id with the digest of its whole text, computed in the JVM, and ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), *more)


def classes(keyed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(digest, n_bytes, keep_id, n) of every text that is live: inserted, and not deleted as often (``deleted``: doc_id)."""
    rows = keyed.select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    if deleted is not None:
        dead = deleted.select(F.col("doc_id").alias("keep_id")).distinct()
        live, off = rows.join(dead, "keep_id", "left_anti"), rows.join(dead, "keep_id", "left_semi")
        # a deleted row is inserted under the least id, so that it never stays, and taken off again
        off = off.select("digest", "n_bytes", F.lit(LEAST).alias("keep_id"), F.explode(F.expr("array(1L, -1L)")).alias("n"))
        rows = live.select(*off.columns).union(off)
    shards = max(shuffle_partitions(keyed.sparkSession), 1 + keyed.count() // INDEX_ROWS)
    partial = rows.mapInArrow(functools.partial(_combine, most=INDEX_ROWS), CLASSES)
    return partial.repartition(shards, "digest").mapInArrow(_combine, CLASSES)


def exact_dedup(docs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row (those deleted excepted)."""
    keyed = written(digests(docs), "digests")
    found = classes(keyed, deleted)
    if deleted is not None:
        keyed = keyed.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
    return keyed.join(found, ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, of the largest doc_id that has it.

    Different texts under one doc_id, or under none, all stay; of rows that repeat a doc_id and a text any one stays.
    """
    least = F.lit(LEAST)
    stay = classes(written(digests(docs), "digests")).select(F.coalesce("keep_id", least).alias("stays"), "digest", "n_bytes")
    rows = digests(docs, F.struct("*").alias("row")).withColumn("stays", F.coalesce("doc_id", least))
    keys = ["stays", "digest", "n_bytes"]
    return rows.dropDuplicates(keys).join(stay, keys, "left_semi").select("row.*")  # repeats go first, so one shuffle of texts serves both
