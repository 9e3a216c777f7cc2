"""Files as Spark lists them: which are left out and why, and their bytes as text.

Ignore files follow git's rules: of the patterns that match a path the last counts, a pattern may be taken back by one
with an exclamation mark, those of deeper folders come later, and a folder that is left out takes all that is below it,
whatever is said of that. Patterns are met by a join of paths and folders on the folder that holds the ignore file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold nothing written for people, files that tools write, and endings of files that aren't text.
IGNORED_FOLDERS = tuple(".git .hg .svn node_modules bower_components dist build out coverage .next .nuxt .cache .venv venv __pycache__ target vendor .idea .vscode .turbo .parcel-cache".split())
LOCKFILES = tuple("package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json bun.lockb composer.lock Cargo.lock Gemfile.lock poetry.lock Pipfile.lock uv.lock go.sum flake.lock mix.lock pubspec.lock Podfile.lock".split())
BINARY = tuple("png jpg jpeg gif webp avif bmp ico tiff psd pdf zip gz tgz bz2 xz 7z rar jar war class so dylib dll exe bin o a wasm woff woff2 ttf otf eot mp3 mp4 m4a wav ogg webm mov avi mkv flac sqlite db parquet pyc".split())
#: Those of them that a person can read words in.
READABLE = tuple("png jpg jpeg gif webp avif bmp tiff psd pdf mp4 webm mov avi mkv".split())
#: Bytes of a file that is still read, and at the beginning of one that are searched for NUL.
SIZE_CAP, SNIFFED = 1 << 20, 8192


def pattern_regex(pattern: str) -> str:
    """A pattern, without its marks of negation and folder, as a regular expression over paths below its folder."""
    anchored = "/" in pattern.rstrip("/")
    out, i, pattern = "", 0, pattern.lstrip("/")
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(pattern, i)):
            inner = re.sub(r"([\[&~\\^])", r"\\\1", m[2])
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", m.end()
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$"


def parse_rules(text: str) -> Iterator[tuple[int, str, bool, bool]]:
    """(place, regular expression, negated, folders only) of the patterns of an ignore file."""
    for i, line in enumerate(text.splitlines()):
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders = line.endswith("/")
        if body := line.rstrip("/"):
            yield i, pattern_regex(body), negated, folders


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """(base, place, pattern, negated, folders) of ignore files (folder: "" at the top, else without a slash at its end; text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(folder, *r) for folder, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in parse_rules(text or "")]
            if rows:
                types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["base", "place", "pattern", "negated", "folders"])

    return ignore_files.select(F.col("folder").cast("string"), F.col("text").cast("string")).mapInArrow(run, "base string, place long, pattern string, negated boolean, folders boolean")


def _folders(path: Column) -> Column:
    """All folders above a path, outermost first, the top ("") included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, by) of the ``paths`` (path) that ``rules`` leave out, by themselves or with a folder above (by: which)."""
    paths = paths.select("path").filter("path <> ''").distinct()
    above = paths.select(F.explode(_folders(F.col("path"))).alias("entry")).filter("entry <> ''").distinct().withColumn("folder", F.lit(True))
    entries = paths.select(F.col("path").alias("entry"), F.lit(False).alias("folder")).union(above)
    met = entries.select("entry", "folder", F.explode(_folders(F.col("entry"))).alias("base")).join(rules, "base")
    below = F.when(F.col("base") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(base) + 2)"))
    met = met.filter(F.col("folder") | ~F.col("folders")).filter(F.regexp_like(below, F.col("pattern")))
    last = met.groupBy("entry", "folder").agg(F.max(F.struct(F.length("base"), "place", "negated"))["negated"].alias("negated")).filter("not negated")
    out = last.filter("folder").select(F.col("entry").alias("by"))
    pruned = paths.select("path", F.explode(_folders(F.col("path"))).alias("by")).join(out, "by").groupBy("path").agg(F.min(F.struct(F.length("by"), "by"))["by"].alias("by"))
    own = last.filter("not folder").select(F.col("entry").alias("path"), F.col("entry").alias("by"))
    return pruned.union(own.join(pruned, "path", "left_anti"))


def decode_bytes(data: bytes) -> dict:
    """What a file's bytes say: text, encoding, whether offsets in the text's UTF-8 are offsets in the file, where the text
    begins, and whether it is no text at all. An empty file is text; one with NUL bytes and no mark isn't."""
    told = {"text": "", "encoding": "utf8", "byte_addressable": True, "body_start": 0, "binary": False}
    for mark, encoding in ((b"\xff\xfe", "utf16le"), (b"\xfe\xff", "utf16be")):
        if data.startswith(mark):
            return told | {"text": data[2:].decode(encoding.replace("utf", "utf-"), "replace"), "encoding": encoding, "byte_addressable": False, "body_start": 2}
    if b"\0" in data[:SNIFFED]:
        return told | {"encoding": None, "binary": True, "byte_addressable": False}
    if data.startswith(b"\xef\xbb\xbf"):
        told |= {"encoding": "utf8-bom", "body_start": 3}
    try:
        return told | {"text": data[told["body_start"] :].decode()}
    except UnicodeDecodeError:
        return told | {"text": data.decode("latin-1"), "encoding": "latin1", "byte_addressable": False, "body_start": 0}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of the files below a folder of any store that Spark lists; unread columns aren't read.

    Spark's listing passes over empty files and those whose names begin with a dot or an underscore. Where they count,
    ignore files above all, a table of the same columns from elsewhere is to be added.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", f"^[a-z0-9]+:/*{re.escape(base)[re.escape(base).startswith('/') :]}/", "")
    return found.select(path.alias("path"), "length", "content")


def census(files: DataFrame) -> DataFrame:
    """(path, bucket, reason, readable, text, encoding, byte_addressable, body_start) of every file of ``files`` (path, length,
    content). Nothing is left out without a reason: ``ignored-folder``, ``gitignored``, ``lockfile``, ``binary-ext``,
    ``oversize``, ``binary``, ``empty``. Contents are read of files that no reason by name or size leaves out.
    """
    known = files.select("path", "length")
    name, end = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    # an ignore file says nothing if it is itself below a folder left out by name
    inside = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda x: x.isin(*IGNORED_FOLDERS))
    ignore = files.filter((name == ".gitignore") & ~inside & (F.col("length") <= SIZE_CAP)).select(F.regexp_replace("path", r"/?\.gitignore$", "").alias("folder"), F.decode("content", "utf-8").alias("text"))
    out = ignored(known, ignore_rules(ignore)).select("path", F.lit(True).alias("_out"))
    reason = F.when(inside, "ignored-folder").when(F.col("_out"), "gitignored").when(name.isin(*LOCKFILES), "lockfile").when(end.isin(*BINARY), "binary-ext").when(F.col("length") > SIZE_CAP, "oversize")
    listed = known.join(out, "path", "left").select("path", reason.alias("reason"), end.isin(*READABLE).alias("readable"))
    read = files.select("path", "content").join(listed.filter("reason is null").select("path"), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "text": pa.string(), "encoding": pa.string(), "byte_addressable": pa.bool_(), "body_start": pa.int64(), "binary": pa.bool_()}
        for batch in batches:
            rows = [{"path": p} | decode_bytes(data or b"") for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], [*kinds])

    texts = read.mapInArrow(run, "path string, text string, encoding string, byte_addressable boolean, body_start long, binary boolean")
    told = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("binary"), "binary").when(F.col("text") == "", "empty")
    met = listed.join(texts, "path", "left").withColumn("reason", told)
    return met.select("path", F.when(F.col("reason").isNull(), "read").otherwise("skipped").alias("bucket"), "reason", (F.col("readable") & F.col("reason").isNotNull()).alias("readable"), *(F.when(F.col("reason").isNull() | (F.col("reason") == "empty"), F.col(c)).alias(c) for c in ("text", "encoding", "byte_addressable", "body_start")))
