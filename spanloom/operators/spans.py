"""Span algebra: union, complement, overlap and containment of half-open byte intervals, by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame) -> DataFrame:
    """(file, start, end) of the islands that touching or overlapping spans make."""
    order = Window.partitionBy("file").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.select("file", "start", "end", begins.alias("begins")).withColumn("island", island)
    return marked.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("file", "start", "end")


def complement(merged: DataFrame, files: DataFrame) -> DataFrame:
    """(file, start, end) of the gaps that merged spans leave in files (file, total); a file without spans is one gap."""
    ends = files.select("file", F.col("total").alias("start"), F.col("total").alias("end"))
    order = Window.partitionBy("file").orderBy("start", "end")
    walled = merged.select("file", "start", "end").unionByName(ends).withColumn("before", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return walled.filter("start > before").select("file", F.col("before").alias("start"), F.col("start").alias("end"))


def claim_ratio(merged: DataFrame, files: DataFrame) -> DataFrame:
    """file, claimed, total, ratio (three places, half up; 1 for an empty file)."""
    claimed = merged.groupBy("file").agg(F.sum(F.col("end") - F.col("start")).alias("claimed"))
    out = files.join(claimed, "file", "left").select("file", F.coalesce("claimed", F.lit(0)).cast("long").alias("claimed"), "total")
    ratio = F.floor(F.col("claimed") / F.col("total") * 1000 + 0.5) / 1000
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(ratio))


#: Positions of one bin: intervals are cut at bins and met there, so that a file with very many is spread.
BIN = 64


def binned(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """``intervals`` once for each bin that [start, end) reaches, with _bin, and _lo and _hi: the part within it. Empty ones reach none."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    out = intervals.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    base = F.col("_bin") * width
    return out.withColumns({"_lo": F.greatest(F.col(start), base), "_hi": F.least(F.col(end), base + width)})


def overlaps(left: DataFrame, right: DataFrame, width: int = 4096) -> DataFrame:
    """Rows of ``left`` (file, start, end, ...) that overlap a row of ``right`` in the same file.

    An equality join by file and bin. Within a bin the right side is merged to islands first, which are fewer than its
    positions, whatever the number of rows; equal left rows meet once and are counted.
    """
    cells = merge(binned(right.select("file", "start", "end"), "start", "end", width).select(F.struct("file", "_bin").alias("file"), F.col("_lo").alias("start"), F.col("_hi").alias("end")))
    cells = cells.select(F.col("file.file").alias("_f"), F.col("file._bin").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    names = left.columns
    counted = left.groupBy(*names).agg(F.count("*").alias("_n"))
    met = binned(counted, "start", "end", width).join(cells, (F.col("file") == F.col("_f")) & (F.col("_bin") == F.col("_b")) & (F.col("_lo") < F.col("_e")) & (F.col("_hi") > F.col("_s")), "left_semi")
    return met.select(*names, "_n").distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*names)


def covering(points: DataFrame, intervals: DataFrame, marks: list[str], width: int = BIN) -> DataFrame:
    """``points`` (file, line, ...) with the greatest of each of ``marks`` (of ``intervals``: file, line, end_line, both
    included) over the intervals of the file that hold the point's line; null where none does.

    Intervals are cut at bins of lines and combined by what is left of them, so that a bin has at most width * width / 2,
    and points are combined by line, so that a line with a million sites, or hits, is met once.
    """
    names, best = points.columns, [F.max(m).alias(m) for m in marks]
    parts = binned(intervals.withColumn("_end", F.col("end_line") + 1), "line", "_end", width)
    parts = parts.groupBy(F.col("file").alias("_f"), F.col("_bin").alias("_b"), "_lo", "_hi").agg(*best)
    lines = points.select("file", "line").distinct().withColumn("_bin", F.floor(F.col("line") / width))
    met = lines.join(parts, (F.col("file") == F.col("_f")) & (F.col("_bin") == F.col("_b")) & (F.col("line") >= F.col("_lo")) & (F.col("line") < F.col("_hi")))
    found = met.groupBy("file", "line").agg(*best)
    return points.drop(*marks).join(found, ["file", "line"], "left").select(*(n for n in names if n not in marks), *marks)


def uncovered_lines(lines: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows of ``lines`` (file, line, ...) on no line of ``covered`` (file, line, end_line)."""
    taken = covered.select("file", F.explode(F.sequence("line", "end_line")).alias("line")).distinct()
    return lines.join(taken, ["file", "line"], "left_anti")
