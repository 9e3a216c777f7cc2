"""Maximal runs of repeated words, by matching aligned blocks.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and three periods long, that
neither neighbour extends. Of a run of period q, the first length - q words hold an aligned block of B words, B the
power of two (8 at least) with B <= q < 2B, and the same words stand q further on. So for each B the aligned blocks of
a document, as keys of integers, go into an Aho-Corasick automaton that searches the whole document, and every
occurrence at a distance of B to 2B - 1 words (1 to 15 for the smallest blocks) seeds a comparison, word by word, to
both sides. What comes out long enough, and has no smaller period, is a run. A block can only recur within 2B words if
each of its words does, which spares most blocks of plain prose the automaton; a seed inside a known run whose period
divides its distance belongs to that run.

Defined cases: words are what ASCII white space separates; a null text has no words; documents are independent, rows
that repeat are treated alike, and ids may repeat or be null; very long texts take time about in proportion to their
words; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the smallest block. A run of 24 words and a period under 16 has such a block in its first length - q words.
SMALLEST = 8
#: Least length of a run in words, and in periods.
LEAST, PERIODS = 24, 3

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

Words = list[bytes]


def _gaps(ids: np.ndarray) -> np.ndarray:
    """Distance of each word to its next occurrence, or more than the document is long."""
    gaps = np.full(len(ids), len(ids) + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


class _Names:
    """Numbers for all stretches of 1, 2, 4, ... words of a document; equal stretches have equal numbers."""

    def __init__(self, ids: np.ndarray):
        self.length, self.of = 1, ids

    def grown(self, length: int) -> np.ndarray:
        """The numbers of the stretches of ``length`` words from each place on, made from those of half the length."""
        while self.length < length:
            pairs = self.of[: -self.length] * (int(self.of.max()) + 1) + self.of[self.length :]
            self.of = np.unique(pairs, return_inverse=True)[1]
            self.length *= 2
        return self.of


def _seeds(n: int, names: _Names, gaps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a block, distance of an occurrence) for blocks of ``size`` words, by place.

    A key has eight integers, each the number of an eighth of a block, so that an automaton is never deep; the document
    is searched once from each place within an eighth.
    """
    none = np.zeros(0, np.int64)
    blocks, step = n // size, size // SMALLEST
    near = gaps[: blocks * size].reshape(blocks, size).max(axis=1) < 2 * size
    if not near.any():
        return none, none
    eighths = names.grown(step)
    automaton, known = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
    content = np.full(blocks, -1, np.int64)  # number of each block's content
    for block in np.flatnonzero(near).tolist():
        key = tuple(eighths[block * size : (block + 1) * size : step].tolist())
        if key not in known:
            automaton.add_word(key, known.setdefault(key, len(known)))
        content[block] = known[key]
    automaton.make_automaton()
    rows = -(-len(eighths) // step)
    grid = np.full((rows + 1) * step, int(eighths.max()) + 1, np.int64)  # the last row parts one search from the next
    grid[: len(eighths)] = eighths
    found = np.array([*automaton.iter(tuple(grid.reshape(rows + 1, step).T.ravel().tolist()))], np.int64).reshape(-1, 2)
    last, number = found[:, 0], found[:, 1]
    at = (last % (rows + 1) - (SMALLEST - 1)) * step + last // (rows + 1)
    first = (at - (1 if size == SMALLEST else size)) // size  # the nearest block that is far enough before
    places, distances = [], []
    for block in (first, first - 1) if size == SMALLEST else (first,):
        hit = (block >= 0) & (content[np.maximum(block, 0)] == number) & (at - block * size < 2 * size)
        places.append(block[hit] * size)
        distances.append(at[hit] - block[hit] * size)
    place, distance = np.concatenate(places), np.concatenate(distances)
    order = np.argsort(place, kind="stable")
    return place[order], distance[order]


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the beginning of ``a`` and ``b`` are the same."""
    most, at, step = min(len(a), len(b)), 0, 64
    while at < most:
        differ = np.flatnonzero(a[at : at + step][: most - at] != b[at : at + step][: most - at])
        if len(differ):
            return at + int(differ[0])
        at, step = min(most, at + step), step * 2
    return most


def _held(at: np.ndarray, q: np.ndarray | int, size: int, inside: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Whether a seed lies in a run whose period divides its distance."""
    period = inside[at]
    return (period > 0) & (q % np.maximum(period, 1) == 0) & (at + q + size <= until[at])


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``ids``, by start and period. ``least``: 24 or more."""
    n, size, runs = len(ids), SMALLEST, []
    if n < least:
        return []
    gaps = _gaps(ids)
    backward, names = ids[::-1], _Names(ids)
    inside, until = np.zeros(n, np.int64), np.zeros(n, np.int64)  # least period of a run that holds a word, and its end
    while PERIODS * (1 if size == SMALLEST else size) <= n:
        places, distances = _seeds(n, names, gaps, size)
        fits = distances * PERIODS <= n
        fits &= ~_held(places, distances, size, inside, until)
        places, distances = places[fits], distances[fits]
        order = np.argsort(distances, kind="stable")
        each, low = np.unique(distances[order], return_index=True)
        for q, at in zip(each.tolist(), np.split(places[order], low[1:]), strict=False):
            if size == SMALLEST:  # only here can a run of the same scale have a period that divides another
                at = at[~_held(at, q, size, inside, until)]
            done = 0  # the stretch compared last ends here
            for a in at.tolist():
                if a < done:
                    continue
                end = a + size + _equal_ahead(ids[a + size : n - q], ids[a + size + q :])
                start = a - _equal_ahead(backward[n - a :], backward[n - a - q : n - q])
                done, length = end, end + q - start
                if length < max(least, PERIODS * q) or any(np.array_equal(ids[start : start + q], ids[start + q // p : start + q // p + q]) for p in _primes(q)):
                    continue
                runs.append((start, length, q))
                fresh = inside[start : start + length] == 0
                inside[start : start + length][fresh] = q
                until[start : start + length][fresh] = start + length
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, numbered from word 0) and collapsed (the text's words without
    those that a run holds after its first period, joined by spaces) of every document. ``prepare``: given an id and its
    words, the words to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                counts, found, texts = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    if prepare is not None:
                        words = prepare(doc_id, words)
                    numbers: dict[bytes, int] = {}
                    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                    runs = find_runs(ids, least) if len(numbers) < len(words) else []
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                    counts.append(len(ids))
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    texts.append(b" ".join(words).decode())
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def plant_periods(doc_id: int | None, words: Words) -> Words:
    """The words of a document of which, for a tenth of all ids, a tail is made periodic: h is the crc32 of the decimal
    id; if 10 divides it, each word i >= a becomes word a + (i - a) % p."""
    import zlib

    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(runs: DataFrame) -> DataFrame:
    """Number of runs, the one of greatest length / period, and digests of all runs and of the collapsed text."""
    ratio = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .when(x["period"] < y["period"], -1)
        .when(x["period"] > y["period"], 1)
        .otherwise(0),
    )
    best = F.get(ratio, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
