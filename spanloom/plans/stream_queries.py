"""Queries of streams: an inventory that follows versions of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import incremental
from .reader_queries import quoted
from .registry import query


@query("""
    WITH now AS (SELECT 'd/' || doc_id || '.json' AS file, CASE WHEN doc_id % 2 = 0 THEN text || ' again' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)
    SELECT file, '/t' AS path, 'key' AS kind, 't' AS value FROM now UNION ALL SELECT file, '/t', 'string', coalesce(text, '') FROM now""")
def incremental_inventory(spark, sf_dir):
    """Documents as files in three batches: all, then those that change, then those that go; what is left is as if read once."""
    folder = incremental.shared_folder(spark, "stream")
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    file = F.concat(F.lit("d/"), d.cast("string"), F.lit(".json")).alias("file")
    batches = (
        docs.select(file, F.lit(1).cast("long").alias("version"), F.concat(F.lit('{"t": '), quoted(F.col("text")), F.lit("}")).alias("text")),
        docs.filter(d % 2 == 0).select(file, F.lit(2).cast("long").alias("version"), F.concat(F.lit('{"t": '), quoted(F.concat("text", F.lit(" again"))), F.lit("}")).alias("text")),
        docs.filter(d % 5 == 0).select(file, F.lit(3).cast("long").alias("version"), F.lit(None).cast("string").alias("text")),
    )
    store = incremental.Store(spark, f"{folder}/store", 16)
    for rows in batches:
        rows.write.mode("append").parquet(f"{folder}/in")
        incremental.follow(spark.readStream.schema("file string, version long, text string").parquet(f"{folder}/in"), store, f"{folder}/progress").awaitTermination()
    return store.sites().select("file", "path", "kind", "value")
