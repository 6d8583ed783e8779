"""Write-once tables, content-addressed objects and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.operators.selection import equal_tables


class DifferentContent(RuntimeError):
    """A protected table already exists with other rows."""


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Writes a Parquet table once: ``written``, or ``unchanged`` for an identical retry."""
    try:
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        return "written"
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    stored = df.sparkSession.read.parquet(path)
    if sorted(stored.columns) != sorted(df.columns):
        raise DifferentContent(f"{path} exists with other columns")
    gap = equal_tables(df, stored, df.columns).first()
    if gap["only_left"] or gap["only_right"]:
        raise DifferentContent(f"{path} exists with other rows: {gap.asDict()}")
    return "unchanged"


def object_table(df: DataFrame, content: str) -> DataFrame:
    """Content-addressed rows: one per distinct content, keyed by its SHA-256.

    Grouping by digest and content keeps the hash aggregate: copies combine before the shuffle.
    """
    digest = F.sha2(F.col(content), 256)
    keyed = df.select(digest.alias("digest"), F.col(content).alias("content"))
    return (
        keyed.groupBy("digest", "content")
        .agg(F.count(F.lit(1)).alias("reference_count"))
        .withColumn("digest_prefix", F.substring("digest", 1, 2))
    )


def write_objects(objects: DataFrame, path: str) -> None:
    """Object table laid out by the first two digest digits; new digests are appended only."""
    spark = objects.sparkSession
    try:
        known = spark.read.parquet(path).select("digest")
        objects = objects.join(known, "digest", "left_anti")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    objects.repartition("digest_prefix").write.mode("append").partitionBy("digest_prefix").parquet(path)


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Report rows as CSV text in a fixed column order."""
    return df.select(F.to_csv(F.struct(*columns)).alias("value"))


def write_report(df: DataFrame, path: str, columns: Sequence[str], kind: str = "csv") -> None:
    """Report file(s): ``csv`` with a header, ``json`` lines or ``text`` (one string column)."""
    out = df.select(*columns).write.mode("errorifexists")
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "text":
        out.text(path)
    else:
        raise ValueError(f"unknown report kind: {kind}")


def markdown_table_line(cells: Sequence[Column | str]) -> Column:
    """One row of a Markdown table."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))
