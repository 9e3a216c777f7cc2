"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The lengths of all pieces form a histogram (at most ``capacity`` rows, whatever the corpus). Over it stands the
configuration linear program: a configuration is a multiset of lengths that fits a sequence, and as few
configurations as possible must cover every length as often as it occurs. Multiplicative weights solve it: lengths
that are covered less weigh more, and a knapsack dynamic program prices the most valuable configuration, in each round
over those lengths that weigh most and others spread over all sizes. Once it is done, the program prices all lengths
at once for a dual bound (``dual_bound``), by which the distance from the best packing is known. The
fractional solution is rounded down; what is left goes, longest first, into the sequence with the least room that
still fits. Pieces then take the slots of their length by a rank that is counted in two salted steps.

Defined cases: a null text counts as empty; an empty text is the end id alone; longer documents are cut every
``capacity`` tokens, the last piece may be shorter; repeated rows and equal ids are packed each for itself; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .tokens import encoder

#: Configurations that leave more than this part of the capacity unused aren't rounded: their pieces are left to the last
#: step, which fills sequences better than the program's last rounds do.
FULL = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, ids, ends in enc.steps(batch.column(1).to_pylist()):
                raw, rows = ids.astype("<u4"), []
                for doc, a, b in zip(keys[lo:hi], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.append(raw[a:b], np.uint32(end_id))
                    for k, s in enumerate(range(0, len(own), capacity)):
                        x = own[s : s + capacity]
                        rows.append((doc, k, s, len(x), zlib.crc32(x.tobytes())))
                cols = [*zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def knapsack(lengths: np.ndarray, values: np.ndarray, copies: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of total length within ``capacity``, with at most so many copies of each length."""
    best, steps = np.zeros(capacity + 1), []
    for i in range(len(lengths)):
        left, k = int(min(copies[i], capacity // lengths[i])), 1
        while left > 0:  # copies in powers of two
            k = min(k, left)
            size = k * int(lengths[i])
            offer = best[: capacity + 1 - size] + k * values[i]
            taken = offer > best[size:]
            steps.append((i, k, size, taken))
            best[size:][taken] = offer[taken]
            left, k = left - k, k * 2
    at, chosen = int(best.argmax()), defaultdict(int)
    for i, k, size, taken in reversed(steps):
        if at >= size and taken[at - size]:
            chosen[int(lengths[i])] += k
            at -= size
    return chosen


def configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = 3000, width: int = 48, rate: float = 10.0) -> list[tuple[float, dict[int, int]]]:
    """(amount, configuration) of a fractional cover, by multiplicative weights.

    Each round prices one configuration over the ``width`` lengths of most weight and takes it until its scarcest
    length is covered by a step more. A length's weight falls exponentially in its cover.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths], float)
    cover, out = np.zeros(len(lengths)), []
    steps = float(np.clip(rounds / max(1, len(lengths)), 2, 64))
    place = {int(x): i for i, x in enumerate(lengths)}
    for _ in range(rounds):
        open_ = np.flatnonzero(cover < 1 - 1e-9)
        if not len(open_):
            break
        weight = lengths[open_] * np.exp(-rate * cover[open_])
        # half by weight, so that long and scarce lengths come first; the rest spread over all sizes, to fill sequences up
        few = open_[np.argsort(-weight, kind="stable")[: width // 2]]
        few = np.union1d(few, open_[np.linspace(0, len(open_) - 1, width - width // 2).astype(int)])
        config = knapsack(lengths[few], lengths[few] * np.exp(-rate * cover[few]), np.maximum(1, need[few]), capacity)
        idx = np.array([place[x] for x in config])
        count = np.array([config[int(lengths[i])] for i in idx], float)
        amount = max(1e-9, min(((1 - cover[idx]) * need[idx] / count).min(), (need[idx] / count).min() / steps))
        cover[idx] += amount * count / need[idx]
        out.append((amount, dict(config)))
    return out


def dual_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the larger of two dual solutions of the program, each priced over all lengths.

    One values a piece by its length, the other counts only pieces over half the capacity; the knapsack tells by how much
    a solution must be scaled so that no configuration is worth more than one.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    best = 0.0
    for values in (lengths / capacity, (lengths * 2 > capacity).astype(float)):
        config = knapsack(lengths, values, np.maximum(1, need), capacity)
        worth = sum(values[np.searchsorted(lengths, x)] * c for x, c in config.items())
        best = max(best, float((need * values).sum()) / worth if worth else 0.0)
    return math.ceil(best - 1e-6)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, copies of each length in one) that hold every piece of the histogram once."""
    left = {int(k): int(v) for k, v in histogram.items()}
    groups: dict[int, list[list]] = defaultdict(list)  # by room: [sequences, {length: copies}]
    rooms: list[int] = []

    def put(room: int, n: int, config: dict[int, int]) -> None:
        if room not in groups or not groups[room]:
            bisect.insort(rooms, room)
        groups[room].append([n, config])

    merged: dict[tuple, float] = defaultdict(float)
    for amount, config in configuration_lp(left, capacity):
        if (capacity - sum(x * c for x, c in config.items())) * FULL > capacity:
            continue
        merged[tuple(sorted(config.items()))] += amount
    for items, amount in sorted(merged.items(), key=lambda x: (-x[1], x[0])):
        n = min([int(amount + 1e-6), *(left[x] // c for x, c in items)])
        if n > 0:
            for x, c in items:
                left[x] -= n * c
            put(capacity - sum(x * c for x, c in items), n, dict(items))
    for length in sorted(left, reverse=True):
        while (rest := left[length]) > 0:
            i = bisect.bisect_left(rooms, length)
            room = rooms[i] if i < len(rooms) else capacity
            n, config = groups[room].pop() if i < len(rooms) else (rest, {})
            if i < len(rooms) and not groups[room]:
                rooms.pop(i)
            each = min(room // length, rest)
            used = max(1, min(n, rest // each))
            if i < len(rooms) or config:
                if n > used:
                    put(room, n - used, config)
            put(room - each * length, used, config | {length: config.get(length, 0) + each})
            left[length] -= used * each
    return [(n, c) for room in rooms for n, c in groups[room]]


def slots(groups: list[tuple[int, dict[int, int]]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence base, copies, offset), by length and rank; their number follows the histogram."""
    rank, base, rows = defaultdict(int), 0, []
    for n, config in groups:
        offset = 0
        for length, c in sorted(config.items(), reverse=True):
            rows.append((length, rank[length], base, c, offset))
            rank[length] += n * c
            offset += length * c
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``capacity``)."""
    spark = pieces.sparkSession
    salts = max(8, shuffle_partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    table = slots(plan(histogram, capacity), capacity)
    names = pieces.columns
    shared = spark.sparkContext.broadcast(table)  # as long as the plan: a function of `capacity`, not of the corpus
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32") if "ids_crc32" in names else Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("base")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = t[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            seq, copy = np.divmod(rank - row[:, 1], row[:, 3])
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 2] + seq), pa.array(row[:, 4] + copy * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenises once, keeps the small table of pieces in the shared folder, and packs it."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
