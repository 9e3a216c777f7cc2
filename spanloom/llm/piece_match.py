"""SentencePiece encoding and decoding by suffix-array matching.

The stretches of a batch (white space and what follows it; no piece reaches across) that are new to the worker are
joined into one text and indexed by a suffix array, as deep as the longest piece. All pieces are binary-searched in it
at once, one character deeper each time, which gives every piece's range of occurrences. The occurrences are the edges
of a graph over positions; sorted by position, they are relaxed from left to right.

The model is a BPE model, so an edge isn't admitted by a sum of scores but by the merges: a piece may follow the best
last piece of the text before it exactly if the two, side by side, would not have been merged in another way. Each
position then has one last piece, and the path back from the end is the encoding of the library, id by id. A run of
several spaces is cut from its word: the last space and the word are matched and relaxed like any stretch; the spaces
before it, whose pieces tie at the least score and so merge last and from the left, are merged by that rule in one
pass over the run (the one part that isn't matched in the suffix array).

Defined cases: a null text counts as empty and has no ids; characters outside the model are written as bytes;
very long stretches are relaxed like others, and runs of spaces take time in proportion to their length; texts of
spaces alone have ids; repeated rows are encoded alike; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
STRETCH = re.compile(" *[^ \n]+| +|\n")
NONE = -1


class PieceModel:
    """Pieces of a sentencepiece BPE model with byte fallback, their merge ranks and how each is merged."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if sp.is_byte(i)}
        plain = [i for i in range(len(self.text)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.text[i]: i for i in plain}
        self.score = {i: sp.get_score(i) for i in plain}
        long = sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: (-self.score[i], i))
        self.rank = {i: r for r, i in enumerate(long)}
        self.split: dict[int, tuple[int, int]] = {}
        for i in long:
            parts = self._merged(self.text[i], whole=False)
            if len(parts) == 2:
                self.split[i] = parts[0], parts[1]
        #: Pieces that merging can produce: single characters and those that their own characters merge into.
        self.usable = [i for i in plain if i not in self.rank or i in self.split]
        runs = {len(t): i for t, i in self.id_of.items() if not t.strip(SPACE)}
        others = [self.score[i] for i in plain if i not in {*runs.values()}]
        if any(SPACE * 2 in self.text[i] and self.text[i].strip(SPACE) for i in plain) or len({self.score[i] for k, i in runs.items() if k > 1}) > 1 or any(self.score[i] >= min(others) for k, i in runs.items() if k > 1):
            raise ValueError("runs of spaces must tie below all other pieces of the model")
        self.spaces = runs
        self.bytes_of = {i: bytes([b]) for b, i in self.byte.items()} | {i: self.text[i].replace(SPACE, " ").encode() for i in plain}
        self.ranks, self.halves = np.full(len(self.text), NONE, np.int64), np.full((len(self.text), 2), NONE, np.int64)
        for i, r in self.rank.items():
            self.ranks[i], self.halves[i] = r, self.split.get(i, (NONE, NONE))
        #: Every pair of pieces whose texts together are a piece, with the rank of that merge.
        pairs = sorted((self.id_of[t[:k]] << 32 | self.id_of[t[k:]], r) for i, r in self.rank.items() for t in [self.text[i]] for k in range(1, len(t)) if t[:k] in self.id_of and t[k:] in self.id_of)
        self.pairs, self.pair_rank = np.array(pairs, np.int64).reshape(-1, 2).T

    def _merged(self, text: str, whole: bool = True) -> list[int]:
        """BPE by rule: best score first, leftmost of equals. Not ``whole``: stops before the last merge into one."""
        parts: list[int | str] = [self.id_of.get(c, c) for c in text]
        shown = list(text)
        while len(parts) > 1:
            best = max(((s, -k) for k in range(len(parts) - 1) if (s := self.score.get(self.id_of.get(shown[k] + shown[k + 1], NONE))) is not None), default=None)
            if best is None or (len(parts) == 2 and not whole):
                break
            k = -best[1]
            shown[k : k + 2] = [shown[k] + shown[k + 1]]
            parts[k : k + 2] = [self.id_of[shown[k]]]
        return [len(self.text) + ord(p) if isinstance(p, str) else p for p in parts]

    def space_run(self, n: int) -> list[int]:
        """Ids of ``n`` spaces on their own: the leftmost pair that makes a piece merges first."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.spaces:
                done[-2:] = [done[-2] + done[-1]]
        return [self.spaces[k] for k in done]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``b`` after piece ``a``. Merges at their border are undone, latest first."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a < len(self.text)) & (b < len(self.text)))
        x, y, limit = a[live], b[live], np.full(len(live), len(self.rank), np.int64)
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            other = (self.pairs[at] == key) & (self.pair_rank[at] < limit)
            out[live[other]] = False
            rx, ry = self.ranks[x], self.ranks[y]
            more = ~other & ((rx != NONE) | (ry != NONE))
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            left = rx > ry
            limit = np.where(left, rx, ry + 1)
            x, y = np.where(left, self.halves[x, 1], x), np.where(left, y, self.halves[y, 0])
        return out


class Matcher:
    """Encodes and decodes whole texts; remembers stretches, ``most`` at a time."""

    PAIRS = 1 << 21

    def __init__(self, path: str, most: int = 800_000):
        self.model, self.most = PieceModel(path), most
        m = self.model
        self.depth = max(len(m.text[i]) for i in m.usable)
        self.pieces = np.array(m.usable, np.int64)
        self.lengths = np.array([len(m.text[i]) for i in m.usable], np.int64)
        self.chars = np.zeros((len(m.usable), self.depth), np.int64)
        for row, i in enumerate(m.usable):
            self.chars[row, : len(m.text[i])] = [*map(ord, m.text[i])]
        self.single = {c: i for c in map(chr, {*self.chars[:, 0].tolist()}) if (i := m.id_of.get(c)) is not None}
        self.pair_key, self.pair_ok = np.full(self.PAIRS, NONE, np.int64), np.zeros(self.PAIRS, bool)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.used = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    # suffix array and search

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Positions in the order of their next ``depth`` characters: ranks of several places are packed into one key."""
        distinct, rank = np.unique(codes, return_inverse=True)
        rank, top, width = rank.astype(np.int64) + 1, len(distinct) + 1, 1
        while True:
            bits = top.bit_length()
            key, ahead = rank, np.zeros(len(rank), np.int64)
            for k in range(1, 62 // bits):
                if (by := k * width) >= self.depth:
                    break
                ahead[:] = 0
                ahead[: max(0, len(rank) - by)] = rank[by:]
                key = key << bits | ahead
            order = np.argsort(key)
            width *= max(2, 62 // bits)
            if width >= self.depth:
                return order
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
            top = len(order) + 1

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row of ``pieces``) of every occurrence of every piece."""
        order = self.suffixes(codes)
        padded = np.concatenate([codes, np.zeros(self.depth, np.int64)])
        group = np.zeros(len(order), np.int64)
        todo, at = np.arange(len(self.pieces)), np.zeros(len(self.pieces), np.int64)
        where, which = [], []
        for d in range(self.depth):
            key = group << 21 | padded[order + d]
            want = at << 21 | self.chars[todo, d]
            low, high = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            some = high > low
            todo, low, high = todo[some], low[some], high[some]
            done = self.lengths[todo] == d + 1
            n = (high - low)[done]
            first = np.repeat(low[done] - (np.cumsum(n) - n), n)
            where.append(order[first + np.arange(len(first))])
            which.append(np.repeat(todo[done], n))
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            todo, at = todo[~done], group[low[~done]]
            if not len(todo):
                break
        return np.concatenate(where), np.concatenate(which)

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``PieceModel.follows`` for arrays, over a table of pairs met before."""
        key = a << 22 | b
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (self.PAIRS - 1)
        miss = self.pair_key[slot] != key
        if miss.any():
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = self.model.follows(fresh >> 22, fresh & 0x3FFFFF)
            out = np.empty(len(key), bool)
            out[~miss] = self.pair_ok[slot[~miss]]
            out[miss] = ok[back]
            place = (fresh * 0x9E3779B97F4A7C1 >> 20) & (self.PAIRS - 1)
            self.pair_key[place], self.pair_ok[place] = fresh, ok
            last = self.pair_key[place] == fresh  # of those that share a slot, the key that stands there counts
            self.pair_ok[place[last]] = ok[last]
            return out
        return self.pair_ok[slot]

    def relax(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches in a row, how many each has); a character outside the model is the number of pieces
        plus its code point."""
        text = "\x00".join(stretches) + "\x00"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        inner = np.ones(len(codes), bool)
        inner[begin + sizes] = False  # NULs that belong to a stretch stay
        where, which = self.occurrences(codes)
        span = self.lengths[which]
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        fits = inner[where] & (where + span <= (begin + sizes)[owner[where]])
        where, which, span = where[fits], which[fits], span[fits]
        held = np.zeros(len(codes), bool)
        held[where[span == 1]] = True
        odd = np.flatnonzero(inner & ~held)
        where = np.concatenate([where, odd])
        token = np.concatenate([self.pieces[which], len(self.model.text) + codes[odd]])
        span = np.concatenate([span, np.ones(len(odd), np.int64)])
        end = where + span - begin[owner[where]]  # from the stretch's start
        order = np.argsort(end.astype(np.uint16) if end.max(initial=0) < 1 << 16 else end, kind="stable")
        where, token, span, end = where[order], token[order], span[order], end[order]
        last = np.full(len(codes) + 1, NONE, np.int64)  # by position: the last piece of the text up to it
        width = np.zeros(len(codes) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(end, prepend=0))
        for lo, hi in zip(cuts, np.append(cuts, len(end))[1:], strict=True):
            w, t, s = where[lo:hi], token[lo:hi], span[lo:hi]
            first = w == begin[owner[w]]
            before = np.where(first, 0, last[w - 1])
            ok = first.copy()
            rest = np.flatnonzero(~first & (before != NONE))
            ok[rest] = self._follow(before[rest], t[rest])
            stop = (w + s - 1)[ok]
            last[stop], width[stop] = t[ok], s[ok]
        path, of, at, live = [], [], begin + sizes - 1, np.flatnonzero(sizes)
        while len(live):  # all paths back at once, a piece a step
            path.append(last[at[live]])
            of.append(live)
            at[live] -= width[at[live]]
            live = live[at[live] >= begin[live]]
        ids = np.concatenate(path[::-1]) if path else np.empty(0, np.int64)
        of = np.concatenate(of[::-1]) if of else np.empty(0, np.int64)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(sizes))

    # texts

    def _bytes(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes characters outside the model as the pieces of their bytes."""
        n = len(self.model.text)
        odd = np.flatnonzero(ids >= n)
        if not len(odd):
            return ids, lengths
        spelt = [[self.model.byte[b] for b in chr(int(i) - n).encode(errors="replace")] for i in ids[odd]]
        size = np.ones(len(ids), np.int64)
        size[odd] = [*map(len, spelt)]
        out = np.repeat(ids, size)
        begin = np.cumsum(size) - size
        for at, x in zip(begin[odd].tolist(), spelt, strict=True):
            out[at : at + len(x)] = x
        per = np.add.reduceat(np.append(size, 0), np.cumsum(lengths) - lengths) if len(lengths) else lengths
        return out, np.where(lengths > 0, per, 0)

    def _relaxed(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``relax``, but spaces before the last of several are merged by rule."""
        words = [*map(str.lstrip, fresh, repeat(SPACE))]
        spaces = [len(f) - len(w) for f, w in zip(fresh, words, strict=True)]
        ids, lengths = self.relax([SPACE * min(n, 1) + w if w else "" for n, w in zip(spaces, words, strict=True)])
        runs = [i for i, (n, w) in enumerate(zip(spaces, words, strict=True)) if n > 1 or not w]
        if not runs:
            return ids, lengths
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i in runs:
            alone = not len(parts[i]) or parts[i][0] == self.model.spaces[1]  # else the last space is part of the word's first piece
            before = self.model.space_run(spaces[i] if alone else spaces[i] - 1)
            parts[i] = np.concatenate([np.array(before, np.int64), parts[i][1:] if alone else parts[i]])
        return np.concatenate(parts), np.array([*map(len, parts)], np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids, lengths = self._bytes(*self._relaxed([s.replace(" ", SPACE) for s in fresh]))
        first, total = len(self.known), int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(fresh) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + total] = ids
        self.starts[first + 1 : first + 1 + len(fresh)] = self.used + np.cumsum(lengths)
        self.used += total
        self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets with one entry more than texts)."""
        words = [STRETCH.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > self.most:
            self._reset()
        known, fresh = self.known, set()
        for ws in words:
            fresh.update(ws)
        if fresh := [w for w in fresh if w not in known]:
            for at in range(0, len(fresh), 30_000):
                self._learn(fresh[at : at + 30_000])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        starts = self.starts[index]
        lengths = self.starts[index + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes are joined, the space that encoding put before the text is taken off."""
        raw = b"".join(map(self.model.bytes_of.__getitem__, ids))
        return raw.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=2)
def matcher(path: str) -> Matcher:
    """One matcher for each Python worker and file."""
    return Matcher(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    return _encoded(docs, model, False).select("doc_id", "ids")


def _encoded(docs: DataFrame, model: str, verify: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids, ends = m.encode(texts)
                cuts = ends.tolist()
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                flat = ids.tolist() if verify else []
                back = [hashlib.sha256(m.decode(flat[a:b]).encode()).hexdigest() if verify else None for a, b in zip(cuts, cuts[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(crcs, pa.int64()), pa.array(back, pa.string())], ["doc_id", "ids", "ids_crc32", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, decoded_sha256 string")


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, decoded_sha256 (of the text that the ids give back)."""
    out = _encoded(docs, model, True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "ids_crc32", "decoded_sha256")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
