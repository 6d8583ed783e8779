"""Lines of text files with their place: file, line number and byte offset.

Spark reads a file in byte ranges, so no task knows how many lines lie before its range. The index counts the
lines and bytes that begin in each range (partial sums leave the tasks, one row per range is shuffled), adds them up
along each file, and every line adds its own place inside its range. Lines are never shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("source_file", "line_number", "byte_offset")


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines as stored, each with the byte range it was read in; a carriage return stays at their end."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_file_bytes"),
    )


def line_index(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file and byte range: lines that begin in it, and lines and bytes before it.

    A file that holds three bytes more than its lines has a byte order mark, which the reader leaves out.
    """
    ranges = _lines(spark, paths).groupBy("source_file", "_start", "_file_bytes").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("_bytes")
    )
    file = Window.partitionBy("source_file")  # a file's ranges, never its lines
    before = file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("_file_bytes") - F.sum("_bytes").over(file) >= 2, 3).otherwise(0)
    return ranges.select(
        "source_file",
        "_start",
        "lines",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
        (F.coalesce(F.sum("_bytes").over(before), F.lit(0)) + mark).alias("bytes_before"),
    )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of every line within its byte range; a task reads its ranges one after the other."""
    current, line, offset = None, 0, 0
    for batch in batches:
        files, starts = batch.column(1), batch.column(2)
        sizes = pc.add(pc.cast(pc.binary_length(batch.column(0)), pa.int64()), 1)
        changed = [0]
        if len(batch) > 1:
            other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
            changed += [i + 1 for i in pc.indices_nonzero(other).to_pylist()]
        for first, stop in zip(changed, [*changed[1:], len(batch)]):
            part = batch.slice(first, stop - first)
            if not len(part):
                continue
            key = (files[first].as_py(), starts[first].as_py())
            if key != current:
                current, line, offset = key, 0, 0
            ends = pc.cumulative_sum(sizes[first:stop], start=offset)
            lines = pa.array(range(line, line + len(part)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, lines, pc.subtract(ends, sizes[first:stop])],
                ["value", "source_file", "_start", "_line", "_offset"],
            )
            line, offset = line + len(part), ends[-1].as_py()


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of the files: value, source_file, line_number (from 1) and byte_offset (of its first byte).

    Lines end with a line feed; a carriage return before it is taken off, but counts in the offsets. Empty lines
    are lines. In compressed files offsets are those of the content. The result does not depend on how
    the files are cut into ranges.
    """
    placed = _lines(spark, paths).drop("_file_bytes").mapInArrow(
        _places, "value string, source_file string, _start long, _line long, _offset long"
    )
    index = line_index(spark, paths).drop("lines")
    value = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return placed.join(index, ["source_file", "_start"]).select(
        value.alias("value"),
        "source_file",
        (F.col("_line") + F.col("lines_before") + 1).alias("line_number"),
        (F.col("_offset") + F.col("bytes_before")).alias("byte_offset"),
    )


def without_header(lines: DataFrame, header: str) -> DataFrame:
    """Lines behind the first of each file; a first line that is not ``header`` stops the job."""
    wrong = F.raise_error(F.concat(F.lit("wrong header in "), F.col("source_file"))).cast("boolean")
    body = F.when(F.col("line_number") > 1, F.lit(True)).when(F.col("value") == header, F.lit(False)).otherwise(wrong)
    return lines.where(body)


def first_bad_lines(rows: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Per group: records, bad lines, and the line number and reason of the first bad line (null if none)."""
    first = F.min(F.when(bad, F.struct("line_number", F.col("reject_reason").alias("reason"))))
    grouped = rows.groupBy(*keys).agg(
        F.count_if(~bad).alias("record_count"), F.count_if(bad).alias("bad_line_count"), first.alias("_first")
    )
    return grouped.select(
        *keys, "record_count", "bad_line_count",
        F.col("_first.line_number").alias("first_bad_line"), F.col("_first.reason").alias("first_bad_reason"),
    )
