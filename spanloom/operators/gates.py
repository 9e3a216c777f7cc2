"""Integrity gates: each gives findings of one shape; all are evaluated, none stops another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.vocab import GATES

FINDING = ("gate", "kind", "file", "site_key", "message")
REASONS = ("proper-noun", "identifier", "legal", "test-fixture", "brand", "quotation", "other")


def finding(rows: DataFrame, gate: str, kind: str, message) -> DataFrame:
    key = F.col("site_key") if "site_key" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(gate).alias("gate"), F.lit(kind).alias("kind"), "file", key.alias("site_key"), message.alias("message"))


def census(tracked: DataFrame, walked: DataFrame, skipped: DataFrame, skipped_dirs: DataFrame) -> DataFrame:
    """file, bucket, reason for every tracked path. A skipped directory claims what begins with it: the directories of a
    path are spelt out and joined by equality; the outermost wins."""
    depth = F.sequence(F.lit(1), F.size(F.split("file", "/")))
    parents = tracked.select("file", F.explode(F.transform(depth, lambda i: F.array_join(F.slice(F.split("file", "/"), F.lit(1), i), "/"))).alias("dir"))
    by_dir = parents.join(skipped_dirs.select("dir", F.col("reason").alias("dir_reason")), "dir").groupBy("file").agg(F.min(F.struct(F.length("dir").alias("n"), "dir_reason")).alias("d"))
    met = tracked.select("file").distinct().join(walked.select("file", F.lit(True).alias("walked"), "has_text"), "file", "left").join(skipped.select("file", F.col("reason").alias("skip_reason")), "file", "left").join(by_dir, "file", "left")
    bucket = F.when(F.col("walked") & F.col("has_text"), "scanned").when(F.col("walked"), "scanned-zero").when(F.col("skip_reason").isNotNull() | F.col("d").isNotNull(), "skipped").otherwise("unaccounted")
    return met.select("file", bucket.alias("bucket"), F.coalesce("skip_reason", F.col("d.dir_reason")).alias("reason"))


def g1_census(entries: DataFrame) -> DataFrame:
    return finding(entries.filter("bucket = 'unaccounted'"), "G1", "unaccounted", F.concat(F.col("file"), F.lit(" is in no bucket")))


def g2_residual(sites: DataFrame) -> DataFrame:
    return finding(sites.filter("verdict = 'unclassified'"), "G2", "residual", F.lit("nothing has claimed this text"))


def g3_unadjudicated(sites: DataFrame) -> DataFrame:
    return finding(sites.filter("verdict = 'needs-judgment'"), "G3", "unadjudicated", F.coalesce(F.col("reason"), F.lit("no reason")))


def g4_source_language(sites: DataFrame, source: str, floor: float = 0.7) -> DataFrame:
    left = sites.filter((F.col("verdict") == "translate") & (F.col("detected") == source) & (F.col("confidence") >= floor))
    return finding(left, "G4", "source-language", F.lit(f"still in {source}"))


def g5_exceptions(exceptions: DataFrame, sites: DataFrame) -> DataFrame:
    """Exceptions (site_key, reason, justification, content_hash) that dangle, misname, say nothing, or outlived their text."""
    met = exceptions.join(sites.select("site_key", "file", F.col("content_hash").alias("now")), "site_key", "left")
    met = met.withColumn("file", F.coalesce("file", F.substring_index("site_key", "#", 1)))
    cases = [("dangling", F.col("now").isNull()), ("vocabulary", ~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))), ("justification", F.trim(F.coalesce("justification", F.lit(""))) == ""), ("changed", F.col("now").isNotNull() & F.col("content_hash").isNotNull() & (F.col("content_hash") != F.col("now")))]
    return reduce(DataFrame.union, (finding(met.filter(cond), "G5", kind, F.lit(f"exception {kind}")) for kind, cond in cases))


def g7_plurals(suspicions: DataFrame) -> DataFrame:
    return finding(suspicions, "G7", "unclaimed-plural", F.array_join("signals", ", "))


def excused(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Findings of G2, G3 and G7 that no exception excuses; others stay."""
    ex = exceptions.select(F.col("site_key").alias("_x")).distinct().withColumn("_e", F.lit(True))
    met = findings.join(ex, F.col("site_key") == F.col("_x"), "left")
    return met.filter(~(F.col("gate").isin("G2", "G3", "G7") & F.coalesce("_e", F.lit(False)))).select(*FINDING)


def fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", identity.fingerprint(*(F.col(c) for c in ("gate", "site_key", "file", "kind", "message"))))


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return fingerprints(findings).join(baseline.select("fingerprint"), "fingerprint", "left_anti").drop("fingerprint")


def summary(findings: DataFrame, spark: SparkSession) -> DataFrame:
    """Every gate with its number of findings; those without are ok."""
    names = spark.createDataFrame([*GATES.items()], "gate string, name string")
    counts = findings.groupBy("gate").agg(F.count("*").alias("n"))
    return names.join(counts, "gate", "left").select("gate", "name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("ok"))
