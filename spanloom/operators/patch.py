"""New texts into files: patches are checked against the file's bytes, told apart where they overlap, and spliced in order.

A file's patches come together as one list beside its text, so a file is rewritten in one pass over its bytes, however
many there are. What can't be done is reported site by site; it never spoils what can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import escapes
from ..sources import inventory

PATCH = "struct<site_key:string,start:bigint,end:bigint,raw:string,extractor:string,kind:string,text:string,holes:array<string>>"
FIELDS = tuple(f.split(":")[0] for f in PATCH[7:-1].split(","))
#: What is given of each file, and as what.
OUT = "file string, text string, report array<struct<site_key:string,status:string>>"
_OUT = {"file": pa.string(), "text": pa.string(), "report": pa.list_(pa.struct([("site_key", pa.string()), ("status", pa.string())]))}


def _holes(text: str, holes: list[str]) -> str:
    """Numbered holes of a template as it writes them; each must be there."""
    for i, expr in enumerate(holes):
        text = text.replace(f"{{{i}}}", f"${{{expr}}}")
    return text


def _placed(data: bytes, p: dict) -> tuple[int, int] | str:
    """Where a patch's bytes are: where they were, or the one place that they have moved to; else what is wrong."""
    raw = (p["raw"] or "").encode()
    start, end = p["start"], p["end"]
    if 0 <= start <= end <= len(data) and data[start:end] == raw:
        return start, end
    first = data.find(raw) if raw else -1
    if first < 0:
        return "drift: the text is gone"
    return "drift: the text is there more than once" if data.find(raw, first + 1) >= 0 else (first, first + len(raw))


def _written(data: bytes, p: dict, start: int, end: int, ascii_only: bool) -> bytes | str:
    """The bytes of a patch, or what is wrong. ``str``: a fault."""
    before = data[start - 1 : start].decode("latin-1")
    syntax = escapes.syntax_of(p["extractor"] or "", p["kind"] or "", before)
    if syntax is None:
        return "no syntax"
    line = data.rfind(b"\n", 0, start) + 1
    lead = data[line:start]
    indent = data[start:end].decode().split("\n")[0]
    indent = indent[: len(indent) - len(indent.lstrip(" "))]
    text = p["text"] or ""
    out = escapes.encode(syntax, text, ascii_only, indent, not lead.strip())
    if out is None or escapes.decode(syntax, out, indent) != text:
        return "the syntax cannot hold the text"
    return _holes(out, p["holes"] or []).encode()


def splice(data: bytes, patches: list[dict]) -> tuple[bytes, list[dict]]:
    """The patched bytes and what became of each patch. Patches that overlap another, by as much as a byte or by starting
    at one place, are all refused."""
    ascii_only = data.isascii() and b"\\u" in data
    placed, told = [], []
    for p in patches:
        at = _placed(data, p)
        if isinstance(at, str):
            told.append({"site_key": p["site_key"], "status": at})
        else:
            placed.append((*at, p))
    placed.sort(key=lambda x: (x[0], x[1], x[2]["site_key"] or ""))
    refused, reach, last = set(), -1, -1
    for i, (start, end, _) in enumerate(placed):
        if i and (start < reach or start == placed[last][0]):
            refused |= {i, last}
        if end >= reach:
            reach, last = end, i
    out, at = [], 0
    for i, (start, end, p) in enumerate(placed):
        new = "overlap" if i in refused else _written(data, p, start, end, ascii_only)
        if isinstance(new, bytes):
            out += [data[at:start], new]
            at = end
        told.append({"site_key": p["site_key"], "status": new if isinstance(new, str) else "applied" if start == p["start"] else "recovered"})
    return b"".join([*out, data[at:]]), told


def _patched(file: str | None, text: str | None, found: list[dict]) -> tuple:
    """The row of ``OUT`` of a file; equal patches count once."""
    once = {tuple(tuple(v) if isinstance(v := p[f], list) else v for f in FIELDS): p for p in found}
    data, told = splice((text or "").encode(), [*once.values()])
    return file, None if text is None and not found else data.decode(), sorted(told, key=lambda t: t["site_key"] or "")


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """(file, text, report: array of site_key, status) of ``files`` (file, once each; text) with ``patches`` (file, and the
    fields of ``PATCH``) applied. ``start`` and ``end`` are the bytes of the value, within its quotes, ``raw`` what stands
    there, ``text`` the new value; ``holes``: expressions of a template by number.

    Defined cases: a file without patches stays; a patch without a file is lost with it; a null text of a patch is empty;
    equal patches of one site count once; a site whose text was moved is found if it is there once; an empty table gives
    no rows.
    """
    lists = patches.groupBy("file").agg(F.collect_list(F.struct(*FIELDS)).alias("patches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return inventory.in_batches((_patched(file, text, found or []) for file, text, found in inventory.each_file(batches)), 1, _OUT)

    met = files.select("file", "text").join(lists, "file", "left").select("file", "text", "patches")
    return met.mapInArrow(run, OUT)


def rewrite(files: DataFrame, patches_of: Callable[[list[dict]], Iterable[dict]]) -> DataFrame:
    """``apply_patches`` where each file's patches are made of its own sites: ``patches_of`` is given the sites (fields of
    ``inventory.SITES``) of one file and gives its patches (fields of ``PATCH``).

    A file is read and spliced where it lies, so that no text is shuffled. Defined cases: those of ``apply_patches``; a null
    text has no sites, and so no patches.
    """
    names = [x.split()[0] for x in inventory.SITES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, how, text in inventory.each_file(batches):
            found = [dict(zip(names, row, strict=True)) for row in inventory.file_sites(file or "", how, text)] if text else []
            yield _patched(file, text, [*patches_of(found)])

    return inventory.routed(files).mapInArrow(lambda batches: inventory.in_batches(run(batches), 1, _OUT), OUT)
