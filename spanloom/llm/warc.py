"""WARC archives of page captures, and their index in global order by an external merge.

Archives are plain WARC/1.1: Spark's text writer puts one record after another, and the record separator that the
standard asks for (two line ends) is the writer's line separator, so files are committed by Spark wherever they lie.
Payloads that occur more than once are stored once; other captures of them are revisit records.

Reading back, every archive gives a run of captures sorted by URL key and time. The runs are cut at common bounds (by
Spark's range partitioning of URL key, time and record, so a hot URL or host is cut as well), and each range merges its
pieces of all runs in a tree of losers, which yields the capture histories in global order. An archive holds a bounded
number of records, the runs are written once, and the number of ranges follows that of captures, so what a task holds
doesn't grow with the input. A record's offset is that in its archive's uncompressed bytes.

Defined cases: a null payload counts as empty, a null URL as an empty one; equal payloads are told by SHA-1 and length;
captures that repeat a page_id and a payload are responses alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_partitions, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "2020-01-01 00:00:00"  # captures without a time: page_id seconds after this one
#: Records of an archive, and captures (without payload) that a task merges.
ARCHIVE_RECORDS, RANGE_ROWS = 20_000, 200_000


def base32(hex_digest: Column) -> Column:
    """Base32 of 40 hex digits: each five digits are four letters."""

    def letters(k: Column) -> Column:
        v = F.conv(F.substring(hex_digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """One row a page: record_type, refers_to, and the record's text without its separator."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    first = rows.filter(F.col("n") >= min_payload).groupBy("sha", "n").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    rows = rows.join(first.filter("copies > 1").select("sha", "n", "first_id"), ["sha", "n"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    digest = base32(F.col("sha"))
    seconds = F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0)).cast("decimal(18,6)")
    date = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)  # UTC, whatever the session's time zone
    line = "\r\n"
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.col("record_type"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{line}WARC-Date: "), F.translate(date.cast("string"), " ", "T"), F.lit("Z"),
        F.lit(f"{line}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(f">{line}WARC-Payload-Length: "), F.col("n").cast("string"))).otherwise(F.lit("")),
        F.lit(f"{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string")),
        F.lit(line * 2),
    )
    return rows.select("page_id", "record_type", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, compression: str = "gzip") -> None:
    records(pages, min_payload).select("value").write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_records(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, header fields, payload) of each record in an archive's bytes."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at) + 4
        head = dict(_FIELD.findall(data, data.index(b"\r\n", at) + 2, end - 2))
        size = int(head[b"Content-Length"])
        yield at, head, data[end : end + size]
        at = end + size + 4


def url_key(url: str) -> str:
    """Host labels in reverse, then the path: captures of one host and page sort together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)([^#]*)", url, re.IGNORECASE)
    host = m[1].rpartition("@")[2].lower().partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def loser_tree(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs: each inner node keeps the loser of its match, the overall winner is taken and replayed."""
    heads = [iter(r) for r in runs]
    k = len(heads)
    if not k:
        return
    now = [next(h, None) for h in heads]
    tree = [-1] * k

    def beats(a: int, b: int) -> bool:
        if now[a] is None or now[b] is None:
            return now[b] is None and (now[a] is not None or a < b)
        return (now[a], a) < (now[b], b)

    def replay(i: int) -> int:
        node = (i + k) // 2
        while node:
            if tree[node] == -1:  # building: the first to come waits
                tree[node] = i
                return -1
            if beats(tree[node], i):
                tree[node], i = i, tree[node]
            node //= 2
        return i

    winner = -1
    for i in range(k):
        winner = max(winner, replay(i)) if k > 1 else 0
    while now[winner] is not None:
        yield now[winner]
        now[winner] = next(heads[winner], None)
        if k > 1:
            winner = replay(winner)


CAPTURES = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]


def _batch(rows: list[tuple], names: list[str] = _NAMES, types: list[pa.DataType] = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def capture_runs(archives: DataFrame) -> DataFrame:
    """The index of each archive (binaryFile rows), sorted by URL key, time and record: one run for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content
                name, rows = path.rpartition("/")[2], []
                for at, head, payload in parse_records(data):
                    page = head[b"WARC-Record-ID"][len("<urn:page:") : -1].decode()
                    kind = head[b"WARC-Type"].decode()
                    if kind == "revisit":
                        size, digest = int(head[b"WARC-Payload-Length"]), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                        refers = int(head[b"WARC-Refers-To"][len("<urn:page:") : -1])
                    else:
                        size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                    rows.append((url_key(head.get(b"WARC-Target-URI", b"").decode()), head[b"WARC-Date"].decode(), int(page) if page else None, size, digest, kind, refers, name, at))
                rows.sort(key=_order)
                for at in range(0, len(rows), 10_000):
                    yield _batch(rows[at : at + 10_000])

    return archives.select("path", "content").mapInArrow(run, CAPTURES)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[7], row[8]


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order: partition by partition, and in each row by row. ``runs`` is read three times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:  # sorted by archive, then in the run's own order
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(row[7], []).append((*_order(row), row))
        out = []
        for x in loser_tree([*pieces.values()]):
            out.append(x[-1])
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    keys = ["url_key", "captured", "archive", "record_offset"]
    ranges = 1 + runs.count() // RANGE_ROWS
    ranged = runs.repartitionByRange(max(ranges, shuffle_partitions(runs.sparkSession)), *keys).sortWithinPartitions("archive", *keys)
    return ranged.mapInArrow(merge, CAPTURES)


def read_archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def archive_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes archives to the shared folder and reads back their captures, merged in global order."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_payload)
    return merge_runs(written(capture_runs(read_archives(spark, path)), "capture-runs"))
