"""What an independent reading of lines says about an inventory: each hit falls into one of seven buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans

# Buckets of hits that a site covers, by the verdicts of all sites that do, in order.
COVERED = (("translate", "claimed"), ("locale-marker", "claimed"), ("do-not-translate", "protected"), ("needs-judgment", "refused"))
#: Extractors whose files count as read whole by definition, not by measurement.
UNMEASURED = ("residual-sweep", "none", "")


def hit_buckets(hits: DataFrame, sites: DataFrame, census: DataFrame) -> DataFrame:
    """``hits`` (file, line, confidence, ...) with their bucket.

    ``sites``: file, line, end_line, verdict; ``census``: file (once each), bucket, claim_ratio, byte_addressable,
    extractor. A hit on a line of sites takes the strongest of their verdicts; a verdict of no other bucket is
    ``surfaced``. A hit that none covers is explained where the census skipped the file or has none, is a confirmed miss
    where the file's reader says it accounted for every byte, measured, and the hit is strong, else a candidate.
    Null lines are covered by nothing.
    """
    rank = F.lit(1)
    for i, (verdict, _) in enumerate(reversed(COVERED)):
        rank = F.when(F.col("verdict") == verdict, i + 2).otherwise(rank)
    found = spans.covering(hits, sites.withColumn("_rank", rank), ["_rank"])
    about = census.select("file", F.col("bucket").alias("_bucket"), ((F.col("claim_ratio") == 1) & F.coalesce("byte_addressable", F.lit(True)) & ~F.coalesce("extractor", F.lit("")).isin(*UNMEASURED)).alias("_asserted"))
    bucket = F.when(F.col("_rank") == 1, "surfaced")
    for i, (_, name) in enumerate(reversed(COVERED)):
        bucket = bucket.when(F.col("_rank") == i + 2, name)
    bucket = bucket.when(F.col("_bucket").isNull() | (F.col("_bucket") == "skipped"), "explained-skip").when(F.coalesce("_asserted", F.lit(False)) & (F.col("confidence") == "strong"), "confirmed-miss").otherwise("candidate")
    return found.join(about, "file", "left").select(*hits.columns, bucket.alias("bucket"))
