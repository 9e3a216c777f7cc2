"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine at least c are within 2 - 2c of each other in squared distance. Rotated by a fixed orthogonal
matrix and split into blocks, two such vectors are within that budget's share (by dimensions) in one block at least. So
each block is a range join in few dimensions: its leading coordinates are cut into cells twice as wide as the radius,
and a vector goes to its own cell and to the next ones that it reaches upwards; two vectors within the radius then meet
in exactly one cell. A pair is taken up in the first block that admits it, and verified by its cosine in double
precision over the whole vectors, there and then: tasks hand on counts and spanning forests, never pairs.

How many coordinates are cut is told by the vectors themselves: cells are counted for each number of cuts, and the one
with the least work (rows handed over, pairs compared) is taken, so that more vectors get finer cells. No cut at all is
one of them: the whole vector is one block then, and all pairs are compared. Vectors that fill their space evenly give
cells nothing to tell apart, and each block's cells together hold more pairs than there are.

A tile compares pairs by their distance over leading coordinates in single precision, which is never more than that
over the block; the few that stay within the budget, with what single precision may err, go on to doubles.

Equal vectors are joined as one class with a count. Crowded cells are dealt to tiles of bounded size, pair of chunks by
pair of chunks; there are as many cells as geometry allows, not as the corpus asks for.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths don't link; rows that repeat an id count as vectors of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .simhash import _merge

BLOCK = 8
#: Components of the vectors of a chunk: a tile compares two chunks at most, whatever the dimensions.
CHUNK = 32768 * 64
#: Coordinates of a block that may be cut (0: no blocks), and how many compared pairs handing over one row is worth.
CUTS, ROW_WORK = range(6), 8000
#: Chunks of the whole where it isn't cut, and vectors of the smallest that are worth a tile.
SHARES, SHARE = 6, 2048
SLACK = 1e-9
#: Coordinates that are compared in single precision, and by how much half a squared distance may err there.
LEADING, SINGLE = 16, 1e-5
#: Rows and columns that are compared at a time, and pairs that are verified at a time.
ROWS, COLUMNS, PAIRS = 256, 1024, 20_000


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, cut: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)] if cut else [slice(0, dims)]


def _unit(raw: np.ndarray) -> np.ndarray:
    # by the largest component first, so that squares neither overflow nor vanish
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rotated(raw: np.ndarray) -> np.ndarray:
    return _unit(raw) @ rotation(raw.shape[1])


def _floats(raws: list[bytes], wide: bool) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(raws), np.float64 if wide else np.float32).reshape(len(raws), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, raw (the components, as wide as in ``vectors``; null where the vector can't link)."""
    wide = _wide(vectors)
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                x = None if not x.is_valid else np.array(x.as_py(), dtype=float)  # a null component is a NaN
                out.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else (x + 0.0).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>" if wide else "array<float>")).mapInArrow(run, "vec_id long, raw binary")


def _wide(vectors: DataFrame) -> bool:
    """Whether components need eight bytes; those of a column of floats are handed on in four."""
    return vectors.schema["embedding"].dataType.simpleString() != "array<float>"


def _cells(rot: np.ndarray, part: slice, radius: float, cut: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(own cells, by leading coordinate; masks of vectors that reach the next cell, by coordinate)."""
    side = 2 * radius
    scaled = rot[:, part][:, :cut] / side
    own = np.floor(scaled).astype(np.int64)
    return own, [(own[:, k] + 1 - scaled[:, k]) * side <= radius + SLACK for k in range(own.shape[1])]


def _spread(rot: np.ndarray, threshold: float, cut: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, rows, cell codes): where each vector goes."""
    parts = blocks(rot.shape[1], cut)
    for b, part in enumerate(parts):
        radius = math.sqrt((2 - 2 * threshold) * (part.stop - part.start) / rot.shape[1])
        own, up = _cells(rot, part, radius, cut)
        for step in product((0, 1), repeat=own.shape[1]):
            rows = np.flatnonzero(np.logical_and.reduce([np.ones(len(rot), bool), *(m for s, m in zip(step, up, strict=True) if s)]))
            yield b, rows, _code(own[rows] + np.array(step, np.int64))


def _code(cells: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        out = out * 4096 + cells[:, k] + 2048
    return out


def _by_length(raws: list[bytes], wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    sizes = np.array([len(r) for r in raws])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _floats([raws[i] for i in rows], wide)


def _near(x: np.ndarray, left: np.ndarray, right: np.ndarray, sweep: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``left`` and ``right`` (each pair once if they are the same) that may lie within the squared distance ``budget``.

    Along ``sweep``, a coordinate of ``x``, only what lies within the radius is compared.
    """
    if not len(left) or not len(right):
        return
    same = left is right
    left, right = (side[np.argsort(sweep[side], kind="stable")] for side in (left, right))
    ahead, reach = sweep[right], math.sqrt(budget) + SLACK
    head = x[:, :LEADING].astype(np.float32)
    half, one = (head * head).sum(axis=1) / 2, np.ones(len(head), np.float32)
    # products of the two sides are minus half the squared distance; rows of no vector come out far away
    rows = np.column_stack([head, -half, one])[left]
    width = min(COLUMNS, (len(right) + 7) & -8)
    columns = np.zeros((len(right) + width, rows.shape[1]), np.float32)
    columns[: len(right)] = np.column_stack([head, one, -half])[right]
    columns[len(right) :, -1] = -9
    least = np.float32(-budget / 2 - SINGLE)
    products, close = (np.empty((min(ROWS, len(left)), width), t) for t in (np.float32, bool))
    held, size = [], 0
    for at in range(0, len(left), ROWS):
        some = rows[at : at + ROWS]
        n = len(some)
        begin = at if same else 0
        begin = max(begin, int(np.searchsorted(ahead, sweep[left[at]] - reach)))
        end = int(np.searchsorted(ahead, sweep[left[at + n - 1]] + reach, side="right"))
        for k in range(begin, end, width):
            np.matmul(some, columns[k : k + width].T, out=products[:n])
            np.greater_equal(products[:n], least, out=close[:n])
            eights = np.flatnonzero(close[:n].view(np.uint64))  # most are empty
            if not len(eights):
                continue
            which, bit = np.nonzero(close[:n].reshape(-1, 8)[eights])
            a, b = np.divmod(eights[which] * 8 + bit, width)
            a, b = a + at, b + k
            if same:
                a, b = a[a < b], b[a < b]
            held.append((left[a], right[b]))
            size += len(a)
            if size >= PAIRS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _tile(pdf: pd.DataFrame, threshold: float, cut: int, wide: bool) -> pd.DataFrame:
    """(id, links, root) of the vectors of one tile that link with another."""
    pdf = pdf.sort_values(["own_chunk", "id"], kind="stable")
    block, code, i, j = (int(pdf[c].iloc[0]) for c in ("block", "cell", "i", "j"))
    raw = _floats([*pdf["raw"]], wide)
    ids, copies, chunk = (pdf[c].to_numpy() for c in ("id", "n", "own_chunk"))
    unit, rot = _unit(raw), _rotated(raw)
    parts = blocks(raw.shape[1], cut)
    radii = np.array([(2 - 2 * threshold) * (p.stop - p.start) / raw.shape[1] for p in parts]) + SLACK
    own, _ = _cells(rot, parts[block], math.sqrt(radii[block] - SLACK), cut)
    x = rot[:, parts[block]]
    first = int((chunk == i).sum())
    left = np.arange(first)
    right = left if i == j else np.arange(first, len(ids))
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, b in _near(x, left, right, x[:, min(cut, x.shape[1] - 1)], radii[block]):
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            if cut:
                here = _code(np.maximum(own[p], own[q])) == code  # the one cell in which the two are to meet
                p, q = p[here], q[here]
                d = rot[p] - rot[q]
                gaps = np.stack([(d[:, s] ** 2).sum(axis=1) for s in parts], axis=1) <= radii
                taken = gaps[:, block] & ~gaps[:, :block].any(axis=1)
                p, q = p[taken], q[taken]
            linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            p, q = p[linked], q[linked]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            _merge(label, p, q)
    out = np.flatnonzero(links)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return pd.DataFrame({"id": ids[out], "links": links[out], "root": least[label[out]]})


def least_work(counts: DataFrame) -> tuple[int, dict[tuple[int, int, int], int]]:
    """(number of cuts, chunks of each crowded cell) with the least work. counts: cut, dims, block, cell, n (vectors there)."""
    n, chunks = F.col("n").cast("double"), F.ceil(F.col("n") * F.col("dims") / CHUNK)
    chunks = F.when(F.col("cut") == 0, F.greatest(chunks, F.least(F.lit(SHARES), F.ceil(F.col("n") / SHARE)))).otherwise(chunks)
    works = counts.groupBy("cut").agg(F.sum(n * chunks * ROW_WORK + n * n / 2).alias("work"))
    best = works.orderBy("work", "cut").first()  # a row for each number of cuts
    cut = best.cut if best else CUTS[0]
    return cut, {(r.dims, r.block, r.cell): r.chunks for r in counts.withColumn("chunks", chunks).filter((F.col("cut") == cut) & (chunks > 1)).collect()}


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    wide = _wide(vectors)
    rows = written(usable(vectors).withColumn("key", F.sha2("raw", 256)), "vectors")
    classes = rows.filter("raw is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("raw").alias("raw"))
    classes = written(classes, "classes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in _by_length(batch.column(0).to_pylist(), wide):
                rot = _rotated(raw)
                for cut in CUTS:
                    for b, _, codes in _spread(rot, threshold, cut):
                        cells, n = np.unique(codes, return_counts=True)
                        cols = (np.full(len(cells), x, np.int32) for x in (cut, raw.shape[1], b))
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cells), pa.array(n)], ["cut", "dims", "block", "cell", "n"])

    # cells of a unit ball: their number depends on dimensions and radius alone, and only crowded ones are named
    counts = classes.select("raw").mapInArrow(count, "cut int, dims int, block int, cell long, n long")
    counts = written(counts.groupBy("cut", "dims", "block", "cell").agg(F.sum("n").alias("n")), "cells")
    cut, crowded = least_work(counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, raws = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for rows, raw in _by_length(raws.to_pylist(), wide):
                for b, hit, codes in _spread(_rotated(raw), threshold, cut):
                    own = np.array([hash((int(x), 7)) for x in ids[rows[hit]]], np.int64)
                    many = np.array([crowded.get((raw.shape[1], b, int(c)), 1) for c in codes], np.int64)
                    chunk = own % np.maximum(many, 1)
                    times = np.repeat(np.arange(len(hit)), many)
                    other = np.concatenate([np.arange(m) for m in many]) if len(many) else np.empty(0, np.int64)
                    at, c = rows[hit][times], chunk[times]
                    size = len(at)
                    cols = [pa.array(np.full(size, raw.shape[1], np.int32)), pa.array(np.full(size, b, np.int32)), pa.array(codes[times]), pa.array(np.minimum(c, other).astype(np.int32)), pa.array(np.maximum(c, other).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(ids[at]), pa.array(n[at]), raws.take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(cols, ["dims", "block", "cell", "i", "j", "own_chunk", "id", "n", "raw"])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile(pdf, threshold, cut, wide)

    tiles = classes.select("id", "n", "raw").mapInArrow(deal, "dims int, block int, cell long, i int, j int, own_chunk int, id long, n long, raw binary")
    found = written(tiles.groupBy("dims", "block", "cell", "i", "j").applyInPandas(tile, "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = classes.select("key", "id", "n").join(links, "id", "left").join(reach, F.col("id") == F.col("node"), "left")
    result = result.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return rows.join(result, F.col("key") == F.col("k"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.expr("vec_id <=> coalesce(component_id, vec_id)").alias("kept"),
    )
