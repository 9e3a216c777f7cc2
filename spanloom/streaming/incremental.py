"""An inventory that follows a stream of file versions.

The sites of all files lie in buckets by file name. A batch takes the newest version of each of its files, reads those
files alone, and writes the buckets that they are in anew, as its own version; buckets that no file of the batch is in
stay where they are. A version counts from the moment its list of buckets is written, which is last, so a batch that
failed, or is run again, leaves what a single run would have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import inventory

DEFAULT_SHARED = "file:///tmp/checkpoints/spanloom"
#: With each site, the version of its file; a file without sites has one row without a site.
STATE = f"bucket int, version long, {inventory.SITES}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, in spark.checkpoint.dir; unset, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(found or DEFAULT_SHARED).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


class Store:
    """Versions of buckets in a folder: ``v=N/bucket=B`` has sites, ``lists/v=N`` the buckets that version N has written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        lists = self._path(f"{self.folder}/lists")
        names = [s.getPath() for s in self._fs.listStatus(lists)] if self._fs.exists(lists) else []
        return sorted(int(p.getName().removeprefix("v=")) for p in names if self._fs.exists(self._path(p, "_SUCCESS")))

    def _newest(self, before: int | None) -> dict[int, int]:
        """Bucket to the newest version that has written it; at most ``buckets`` of them."""
        versions = [v for v in self._versions() if before is None or v < before]
        if not versions:
            return {}
        lists = self.spark.read.schema("bucket int, v long").option("basePath", f"{self.folder}/lists").parquet(*(f"{self.folder}/lists/v={v}" for v in versions))
        return {r.bucket: r.v for r in lists.groupBy("bucket").agg(F.max("v").alias("v")).collect()}

    def rows(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """``STATE`` of the newest versions, of some buckets or all."""
        newest = self._newest(before)
        paths = [p for b, v in newest.items() if (only is None or b in only) and self._fs.exists(self._path(p := f"{self.folder}/v={v}/bucket={b}"))]
        if not paths:
            return self.spark.createDataFrame([], STATE)
        names = [x.split()[0] for x in STATE.split(", ")]
        return self.spark.read.schema(f"{STATE}, v long").option("basePath", self.folder).parquet(*paths).select(*names)

    def merge(self, files: DataFrame, batch: int) -> None:
        """Takes in ``files`` (file, version, text; a null text: the file is gone) as version ``batch``. Of several versions
        of a file the greatest counts, and one that isn't greater than the one known changes nothing."""
        latest = files.filter("file is not null").groupBy("file").agg(F.max(F.struct("version", "text")).alias("f")).select("file", "f.version", "f.text")
        latest = latest.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r.bucket for r in latest.select("bucket").distinct().collect()]
            if not touched:
                return
            before = self.rows(batch, touched)
            known = before.groupBy("file").agg(F.max("version").alias("known"))
            changed = latest.join(known, "file", "left").filter("known is null or version > known")
            sites = inventory.sites(changed.select("file", "text"))
            keep = before.join(changed.select("file"), "file", "left_anti")
            none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in inventory.SITES.split(", ")) if n != "file"]
            marks = changed.select("bucket", "version", "file", *none)  # what is known of a file, whether it has sites or not
            new = changed.select("bucket", "version", "file").join(sites, "file").select(*keep.columns).unionByName(marks)
            keep.unionByName(new).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={batch}")
            self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/v={batch}")
        finally:
            latest.unpersist()

    def sites(self) -> DataFrame:
        """All sites there are."""
        return self.rows().filter("path is not null").select(*(x.split()[0] for x in inventory.SITES.split(", ")))


def follow(stream: DataFrame, store: Store, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts taking a stream of (file, version, text) into a store, batch by batch, until what is there now is taken in."""

    def batch(files: DataFrame, number: int) -> None:
        store.merge(files, number)
        if then:
            then(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
