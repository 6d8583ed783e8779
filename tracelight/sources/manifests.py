"""Declared files against the files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_facts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, size and SHA-256 of the files below ``root``.

    Whole files are hashed inside tasks, so this is for artifacts and source partitions below 2 GiB;
    larger tables are compared by :func:`tracelight.operators.splitting.table_digest`.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    return files.select(
        relative.alias("relative_path"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def verify_manifest(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of every path on either side: verified, missing, unmanifested or a mismatch."""
    d = declared.select(
        "relative_path",
        F.col("size_bytes").alias("declared_size"),
        F.col("sha256").alias("declared_sha256"),
    )
    a = actual.select(
        "relative_path",
        F.col("size_bytes").alias("actual_size"),
        F.col("sha256").alias("actual_sha256"),
    )
    status = (
        F.when(F.col("actual_sha256").isNull(), F.lit("missing"))
        .when(F.col("declared_sha256").isNull(), F.lit("unmanifested"))
        .when(F.col("declared_size") != F.col("actual_size"), F.lit("size-mismatch"))
        .when(F.col("declared_sha256") != F.col("actual_sha256"), F.lit("digest-mismatch"))
        .otherwise(F.lit("verified"))
    )
    return d.join(a, "relative_path", "full").withColumn("status", status)


def manifest_errors(report: DataFrame) -> DataFrame:
    """Counts per status; a set is verified when only ``verified`` remains."""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("file_count"))
