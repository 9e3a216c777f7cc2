"""Token ids as files of independently coded blocks: an adaptive context-mixing range coder.

A block holds whole documents. Its ids are dealt to lanes of consecutive ids, and all lanes advance together, one id a
step, over one model that starts afresh in every block and learns after every step:

* order 0: how often each id has come up so far;
* order 1 and order 2: the id last seen after the last one or two ids, with a confidence.

The three are mixed into one distribution; the weight of each prediction is the hit rate that its confidence has had
so far. A range coder of 64 bits, one for each lane, writes ids by it in 16-bit words. Integers and
correctly rounded doubles only, so that what was written by one machine is read by any.

A block: magic, counts, CRC-32 of the ids and of the body; document ids and lengths; words by lane; words.
Defined cases: a null text counts as empty, an empty text is the end id alone; null document ids come first; repeated
ids stay in one file, next to each other; other columns are ignored; an empty table writes an empty file set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path
from .tokens import encoder

#: A lane codes so many ids at least, so that its block's model has as many steps to learn in.
LANE_IDS = 512
BLOCK_IDS, LANES = 1 << 22, 8192
HEAD = struct.Struct("<4sIIIIII")  # magic, ids, documents, lanes, alphabet, CRC of ids, CRC of body
MAGIC = b"CMR1"
NO_ID = -(1 << 63)

_TOP, _LEAST = np.uint64(1 << 48), np.uint64(1 << 36)
_W = np.uint64(16)
_SHARE = 4096
#: The confidence after, by confidence and whether it hit.
_NEXT = np.array([min(k + 1, 15) if hit else k >> 1 for k in range(16) for hit in (False, True)], np.int64)


def _at(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[index], for an index that never leaves the array: faster, as nothing is checked."""
    return values.take(index, mode="clip")


class _Model:
    """Predictions for all lanes of a step. A context's slot holds the id expected after it, times 16, plus a confidence."""

    HASH_BITS, MOST, PLACE_BITS = 17, 1 << 22, 16

    def __init__(self, alphabet: int):
        self.count = np.ones(alphabet, np.int64)
        self.below = np.zeros(alphabet + 1, np.int64)
        self.slots = [np.zeros(alphabet, np.int64), np.zeros(1 << self.HASH_BITS, np.int64)]
        self.seen = np.zeros((16, 16, 2, 2), np.int64)  # how often by both confidences and whether they hit
        self.fresh: list[np.ndarray] = []
        self.step = 0
        self._sum()

    def _sum(self) -> None:
        """Brings order 0 and the weights up to date."""
        if self.fresh:
            self.count += 8 * np.bincount(np.concatenate(self.fresh), minlength=len(self.count))
            self.fresh = []
        np.cumsum(self.count, out=self.below[1:])
        if self.below[-1] > self.MOST:
            self.count = (self.count + 1) >> 1
            np.cumsum(self.count, out=self.below[1:])
        self.total, self.guess = int(self.below[-1]), None
        seen = np.array([self.seen.sum(axis=(1, 3)), self.seen.sum(axis=(0, 2))]) + [3, 1]  # by order: misses and hits at each confidence
        r1, r2 = np.minimum(seen[:, :, 1] * _SHARE // seen.sum(axis=2), _SHARE - 64)
        w2 = np.broadcast_to(r2[None, :], (16, 16))
        w1 = (_SHARE - w2) * r1[:, None] // _SHARE
        w0 = np.maximum(_SHARE - w2 - w1, 16)
        self.mass1, self.mass2 = (self.total * w1 // w0).ravel(), (self.total * w2 // w0).ravel()
        self.mass = self.total + self.mass1 + self.mass2
        self.inverse = (1 - 2.0**-50) / self.mass

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """Sets what the lanes expect after (before, last): ids p1 and p2 and their masses m1 and m2."""
        at = last * 0x9E3779B1
        at ^= before * 0x85EBCA77
        at >>= 7
        at &= (1 << self.HASH_BITS) - 1
        self.at = [last, at]
        x1, x2 = _at(self.slots[0], last), _at(self.slots[1], at)
        self.k1, self.k2 = x1 & 15, x2 & 15
        self.p1, self.p2 = x1 >> 4, x2 >> 4
        self.both = self.k1 << 4
        self.both |= self.k2
        self.m1, self.m2 = _at(self.mass1, self.both), _at(self.mass2, self.both)

    def units(self, size: np.ndarray) -> np.ndarray:
        """A little less than size / all mass, by IEEE doubles, so that units times mass never exceeds size."""
        unit = size.astype(np.float64)
        unit *= _at(self.inverse, self.both)
        return unit.astype(np.uint64)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mass below each id, mass of each id)."""
        self.hit1, self.hit2 = self.p1 == ids, self.p2 == ids
        low, mass = _at(self.below, ids), _at(self.count, ids)
        low += self.m1 * (self.p1 < ids)
        low += self.m2 * (self.p2 < ids)
        mass += self.m1 * self.hit1
        mass += self.m2 * self.hit2
        return low, mass

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the places lie: places within a prediction's own mass are moved to its start."""
        a, b = np.minimum(self.p1, self.p2), np.maximum(self.p1, self.p2)
        mb = self.m2 - self.m1
        mb *= self.p1 <= self.p2
        mb += self.m1
        ma = self.m1 + self.m2
        ma -= mb
        for first, mass in ((a, ma), (b, mb)):
            own = at - _at(self.below, first)
            np.minimum(np.maximum(own, 0, out=own), mass, out=own)
            at = at - own
        return self._place(at)

    def _place(self, at: np.ndarray) -> np.ndarray:
        """The last ids below which there is no more mass than ``at``: most are told by the stretch in which ``at`` lies."""
        if self.guess is None:
            self.shift = max(self.total.bit_length() - self.PLACE_BITS, 0)
            self.guess = np.zeros((self.total >> self.shift) + 2, np.int64)
            first = (self.below[:-1] + ((1 << self.shift) - 1)) >> self.shift
            last = np.flatnonzero(np.append(first[1:] != first[:-1], True))
            self.guess[first[last]] = last
            np.maximum.accumulate(self.guess, out=self.guess)
        out = _at(self.guess, at >> self.shift)
        rest = np.flatnonzero(_at(self.below, out + 1) <= at)
        if len(rest):
            out[rest] += 1
            rest = rest[self.below[out[rest] + 1] <= at[rest]]
            out[rest] = np.searchsorted(self.below, at[rest], side="right") - 1
        return out

    def learn(self, ids: np.ndarray) -> None:
        how = self.both << 1
        how += self.hit1
        how <<= 1
        how += self.hit2
        self.seen += np.bincount(how, minlength=self.seen.size).reshape(self.seen.shape)
        for slots, at, p, k, hit in zip(self.slots, self.at, (self.p1, self.p2), (self.k1, self.k2), (self.hit1, self.hit2), strict=True):
            x = p - ids  # an id in which there is confidence stays
            x *= k > 1
            x += ids
            x <<= 4
            k <<= 1
            k += hit
            x += _at(_NEXT, k)
            slots[at] = x
        self.fresh.append(ids)
        self.step += 1
        if self.step < 8 or self.step % 8 == 0:
            self._sum()


def _quotients(a: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """a // unit, by doubles, put right by at most one."""
    q = (a.astype(np.float64) / unit).astype(np.int64)
    back = q.view(np.uint64) * unit
    q -= back > a
    return q + (a - q.view(np.uint64) * unit >= unit)


def _settle(low: np.ndarray, size: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of the lanes ``some``, those that move on by a word; narrows ranges that are too small and straddle a word's end."""
    some = some[np.flatnonzero(_at(size, some) < _TOP)]  # a larger range never ends in the word in which it begins
    at, wide = _at(low, some), _at(size, some)
    small = wide < _LEAST
    move = (at ^ (at + wide)) < _TOP
    tight = small & ~move
    if tight.any():
        size[some[tight]] = (~at[tight] + np.uint64(1)) & (_LEAST - np.uint64(1))
    move |= small
    return some[np.flatnonzero(move)]


def encode_ids(ids: np.ndarray, alphabet: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all words by lane)."""
    steps = -(-len(ids) // lanes)
    padded = np.zeros(lanes * steps, np.int64)
    padded[: len(ids)] = ids
    by_step = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, low, size = _Model(alphabet), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    last = before = np.zeros(lanes, np.int64)
    everyone, words, of = np.arange(lanes), [], []  # words as they come, and their lanes
    for now in by_step:
        model.predict(last, before)
        start, mass = model.interval(now)
        unit = model.units(size)
        low += unit * start.view(np.uint64)
        size = np.multiply(unit, mass.view(np.uint64), out=unit)
        some = everyone
        while len(some := _settle(low, size, some)):
            at = _at(low, some)
            words.append((at >> np.uint64(48)).astype(np.uint16))
            of.append(some.astype(np.uint16))
            low[some] = at << _W
            size[some] = _at(size, some) << _W
        model.learn(now)
        last, before = now, last
    # the shortest end: one word where a whole multiple lies in the range, else two
    one = (low + (_TOP - np.uint64(1))) & ~(_TOP - np.uint64(1))
    short = (one - low) < size
    cut = np.uint64((1 << 32) - 1)
    end = np.where(short, one, (low + cut) & ~cut)
    words += [(end >> np.uint64(48)).astype(np.uint16), (end[~short] >> np.uint64(32)).astype(np.uint16)]
    of += [everyone.astype(np.uint16), everyone[~short].astype(np.uint16)]
    of = np.concatenate(of)
    return np.bincount(of, minlength=lanes), np.concatenate(words)[np.argsort(of, kind="stable")]


def decode_ids(n: int, alphabet: int, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes = len(counts)
    steps = -(-n // lanes)
    # a lane reads four words ahead and has one at least: three zeros follow each lane's words
    at = np.cumsum(counts + 3) - counts - 3
    held = np.zeros(len(words) + 3 * lanes, np.uint16)
    held[np.arange(len(words)) + np.repeat(3 * np.arange(lanes), counts)] = words
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _W) | held[at]
        at += 1
    model, low, size = _Model(alphabet), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    last = before = np.zeros(lanes, np.int64)
    everyone, out = np.arange(lanes), np.empty((steps, lanes), np.uint32)
    for t in range(steps):
        model.predict(last, before)
        unit = model.units(size)
        place = np.minimum(_quotients(code - low, unit), _at(model.mass, model.both) - 1)
        now = model.find(place)
        start, mass = model.interval(now)
        low += unit * start.view(np.uint64)
        size = np.multiply(unit, mass.view(np.uint64), out=unit)
        some = everyone
        while len(some := _settle(low, size, some)):
            next_word = _at(at, some)
            code[some] = (_at(code, some) << _W) | _at(held, next_word)
            at[some] = next_word + 1
            low[some] = _at(low, some) << _W
            size[some] = _at(size, some) << _W
        model.learn(now)
        out[t] = now
        last, before = now, last
    return np.ascontiguousarray(out.T).ravel()[:n]


def encode_block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One block of (document id, ids)."""
    ids = np.concatenate([np.asarray(x, np.uint32) for _, x in docs]) if docs else np.empty(0, np.uint32)
    keys = np.array([NO_ID if d is None else d for d, _ in docs], "<i8")
    sizes = np.array([len(x) for _, x in docs], "<u4")
    lanes = int(np.clip(len(ids) // LANE_IDS, 1, LANES))
    alphabet = int(ids.max(initial=0)) + 1
    counts, words = encode_ids(ids, alphabet, lanes)
    body = keys.tobytes() + sizes.tobytes() + counts.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return HEAD.pack(MAGIC, len(ids), len(docs), lanes, alphabet, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; a block that was damaged raises ValueError."""
    magic, n, documents, lanes, alphabet, of_ids, of_body = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != of_body:
        raise ValueError("not a whole block of token ids")
    keys = np.frombuffer(body, "<i8", documents)
    sizes = np.frombuffer(body, "<u4", documents, 8 * documents)
    counts = np.frombuffer(body, "<u4", lanes, 12 * documents).astype(np.int64)
    words = np.frombuffer(body, "<u2", offset=12 * documents + 4 * lanes)
    ids = decode_ids(n, alphabet, counts, words)
    if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
        raise ValueError("the ids of a block don't match their checksum")
    return [(None if k == NO_ID else k, x) for k, x in zip(keys.tolist(), np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]), strict=True)] if documents else []


FILE = "part int, block int, first_id long, before long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every text, appends ``end_id``, and writes blocks in ascending order of doc_id.

    Ranges of doc_id become parts; ``before`` counts the ids of a part's earlier blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held, size, before, number = [], 0, 0, 0

        def block() -> pa.RecordBatch:
            row = [part], [number], [held[0][0]], [before], [size], [encode_block(held)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "first_id", "before", "n_ids", "payload"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, ids, ends in enc.steps(batch.column(1).to_pylist()):
                for doc, a, b in zip(keys[lo:hi], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    held.append((doc, np.append(ids[a:b], np.uint32(end_id))))
                    size += b - a + 1
                    if size >= BLOCK_IDS:
                        yield block()
                        held, size, before, number = [], 0, before + size, number + 1
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, FILE).write.parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in ``files``, as written by ``write_tokens``."""
    return _read(files, lambda ids: pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), "ids array<long>")


def _read(files: DataFrame, column, kind: str) -> DataFrame:
    parts = files.groupBy("part").agg(F.min("first_id").alias("first"), F.sum("n_ids").alias("n"))  # a row for each part
    base = F.coalesce(F.sum("n").over(Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    name = kind.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = decode_block(payload)
                sizes = np.array([len(x) for _, x in docs], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array([d for d, _ in docs], pa.int64()), pa.array(before + np.cumsum(sizes) - sizes), pa.array(sizes), column([x for _, x in docs])],
                    ["part", "doc_id", "start", "n_tokens", name],
                )

    found = files.select("part", "before", "payload").mapInArrow(run, f"part int, doc_id long, start long, n_tokens long, {kind}")
    bases = parts.select("part", base.alias("base"))
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", name)  # as many rows as parts


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, read from ``files``."""
    return _read(files, lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` to the shared folder and reads the digests back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession.read.schema(FILE).parquet(path))
