"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task splits its texts by the pattern of the vocabulary and gathers the distinct words that its worker hasn't met yet.
Their bytes stand in one sequence, parted by a symbol that merges with nothing, and an inverted index maps each merge,
by rank, to the places of its pairs. The merges are applied in rank order to all words at once, a merge's places from
left to right; each touches its two neighbours only, whose new pairs go to the index under their own ranks. A word in
which a merge makes a pair of a lower rank than its own (no pair of a vocabulary trained in one go should) is replayed
on its own, lowest rank first. A word that is itself in the vocabulary has that id, as in the tiktoken library.

Encoded texts are then put together from the words' ids, and decoded by gathering the bytes of every id.

Defined cases: a null text counts as empty and has no ids; control strings of a tokenizer are ordinary text; very long
words and texts are encoded whole; repeated rows are encoded alike; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = -1
SCHEMA = "doc_id long, ids array<int>, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Ids of words by their UTF-8 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of the merge of two symbols, for all ways to cut a token into two tokens.
        cuts = [(a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        nothing: dict[int, int] = {}
        self.with_right, self.with_left = [nothing] * self.size, [nothing] * (self.size)
        for a, b, r in cuts:
            for table, own, other in ((self.with_right, a, b), (self.with_left, b, a)):
                if table[own] is nothing:
                    table[own] = {}
                table[own][other] = r
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), self.size) for b in range(256)] for a in range(256)], np.int64)

    def alone(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank merges first, the leftmost of equals."""
        parts = [int(self.single[b]) for b in word]
        while len(parts) > 1:
            rank, k = min((self.with_right[a].get(b, self.size), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.size:
                break
            parts[k : k + 2] = [rank]
        return parts

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        stop = self.size  # the symbol between words
        text = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends]  # a stop stands before and behind each word
        symbols = self.single[text]
        symbols[starts] = stop
        pair_rank = self.of_bytes[text[:-1], text[1:]]
        pair_rank[starts[:-1]] = pair_rank[ends - 1] = stop
        for w, word in enumerate(words):
            if (known := self.ranks.get(word)) is not None:  # stands as it is; no pair of it is in the index
                at = starts[w] + 1
                pair_rank[at : ends[w]], symbols[at : ends[w]], symbols[at] = stop, NONE, known

        index: list[list[int]] = [[] for _ in range(self.size)]
        places = np.flatnonzero(pair_rank < stop)
        places = places[np.argsort(pair_rank[places], kind="stable")]
        rank, low = np.unique(pair_rank[places], return_index=True)
        for r, at in zip(rank.tolist(), np.split(places, low[1:]), strict=False):
            index[r] = at.tolist()
        symbol, current = symbols.tolist(), [*pair_rank.tolist(), stop]
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        lower = []
        for r in range(self.size):
            if not (at := index[r]):
                continue
            at.sort()
            right, left = self.with_right[r].get, self.with_left[r].get
            for i in at:
                if current[i] != r:  # another merge took one of the two
                    continue
                j = after[i]
                k, h = after[j], before[i]
                symbol[i], symbol[j] = r, NONE
                after[i], before[k] = k, i
                current[j] = NONE
                current[i] = x = right(symbol[k], stop)
                current[h] = y = left(symbol[h], stop)
                if x != stop:
                    index[x].append(i)
                if y != stop:
                    index[y].append(h)
                if x < r or y < r:
                    lower.append(i)
            index[r] = []
        symbols = np.array(symbol, np.int64)
        live = (symbols != NONE) & (symbols != stop)
        counts = np.add.reduceat(np.r_[live, False], starts[:-1]) if len(words) else np.zeros(0, np.int64)
        if not lower:
            return symbols[live], counts
        parts = np.split(symbols[live], np.cumsum(counts)[:-1])
        for w in {*(np.searchsorted(starts, lower, side="right") - 1).tolist()}:
            parts[w] = np.array(self.alone(words[w]), np.int64)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


class ByteBPE:
    """Encodes and decodes texts; remembers words, ``most`` at a time."""

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        import regex

        ranks = read_ranks(path)
        self.replay, self.most, self.split = MergeReplay(ranks), most, regex.compile(pattern).findall
        self.lengths = np.zeros(self.replay.size, np.int64)
        for token, r in ranks.items():
            self.lengths[r] = len(token)
        self.ends = np.cumsum(self.lengths)
        joined = {r: token for token, r in ranks.items()}
        self.bytes = np.frombuffer(b"".join(joined.get(r, b"") for r in range(self.replay.size)), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self.known) > self.most:
            self._reset()
        met = [self.split(t) if t else [] for t in texts]
        known = self.known
        first = len(known)
        numbers = np.array([known.setdefault(w, len(known)) for words in met for w in words], np.int64)
        if len(known) > first:
            fresh = [w.encode() for w, _ in zip(reversed(known), range(len(known) - first), strict=False)][::-1]
            ids, counts = self.replay.encode(fresh)
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        lengths = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(np.r_[0, lengths])
        ids = self.flat[_places(self.starts[numbers], lengths)]
        upto = ends[np.cumsum(np.r_[0, np.fromiter(map(len, met), np.int64, len(met))])]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after the other, number of bytes of each)."""
        lengths = self.lengths[ids]
        ends = np.cumsum(np.r_[0, lengths])
        return self.bytes[_places(self.ends[ids] - lengths, lengths)], np.diff(ends[np.cumsum(np.r_[0, counts])])


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ranges one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """A worker's codec, with the words that it has met."""
    return ByteBPE(path, pattern)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, at_once: int = 1 << 21) -> DataFrame:
    """doc_id, ids of the whole text, and decoded: the bytes that the ids stand for. ``at_once``: characters that a task
    encodes together (or one text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            doc_ids, texts, lo = batch.column(0), batch.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= at_once):
                    chars += len(texts[hi] or "")
                    hi += 1
                ids, counts = bpe.encode(texts[lo:hi])
                raw, sizes = bpe.decode(ids, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, counts]), pa.int32()), pa.array(ids, pa.int32()))
                decoded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.cumsum(np.r_[0, sizes]).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), lists, decoded], ["doc_id", "ids", "decoded"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def id_digests(encoded: DataFrame) -> DataFrame:
    """Digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
