"""Strict CSV, Parquet and JSON-lines scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import scalars as S
from tracelight.sources import positions

# Columns of a labelled connection file, in order.
CONNECTION_COLUMNS = (
    "community_id",
    "conn_state",
    "duration",
    "history",
    "src_ip_zeek",
    "src_port_zeek",
    "dest_ip_zeek",
    "dest_port_zeek",
    "local_orig",
    "local_resp",
    "missed_bytes",
    "orig_bytes",
    "orig_ip_bytes",
    "orig_pkts",
    "proto",
    "resp_bytes",
    "resp_ip_bytes",
    "resp_pkts",
    "service",
    "ts",
    "uid",
    "datetime",
    "label_tactic",
    "label_technique",
    "label_binary",
    "label_cve",
)
LABEL_COLUMNS = ("label_tactic", "label_technique", "label_binary", "label_cve")
IDENTITY_COLUMNS = tuple(c for c in CONNECTION_COLUMNS if c not in LABEL_COLUMNS)


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_strict_csv(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = CONNECTION_COLUMNS
) -> DataFrame:
    """CSV with exactly the given header; a wrong header or malformed record stops the job."""
    return (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(paths)
        .select(
            *[F.coalesce(c, F.lit("")).alias(c) for c in columns],
            F.col("_metadata.file_path").alias("source_file"),
        )
    )


def parse_csv_lines(lines: DataFrame, columns: Sequence[str], raw: str = "value") -> DataFrame:
    """Physical CSV lines to text columns, keeping the digest of the raw line.

    For evidence that must be traced to the exact line: blank lines are skipped, and a line without
    exactly one value per column stops the job.
    """
    width = len(columns)
    ddl = ", ".join(f"`{c}` string" for c in [*columns, "_corrupt"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.where(F.trim(raw) != "").withColumn("_row", F.from_csv(raw, ddl, options))
    checked = F.when(F.col("_row")["_corrupt"].isNull(), F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit(f"line does not hold {width} values: "), F.col(raw)))
    )
    kept = [c for c in lines.columns if c != raw]
    return parsed.select(
        *kept,
        F.sha2(raw, 256).alias("raw_line_sha256"),
        checked.alias("_row"),
    ).select(
        *kept,
        "raw_line_sha256",
        *[F.coalesce(F.col("_row")[c], F.lit("")).alias(c) for c in columns],
    )


def read_csv_records(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = CONNECTION_COLUMNS
) -> DataFrame:
    """CSV records by physical line, with source_file, line_number, byte_offset and the digest of the raw line.

    Equal lines stay records of their own. A wrong header, or a line without one value per column, stops the job.
    """
    lines = positions.without_header(positions.read_lines(spark, paths), ",".join(columns))
    return parse_csv_lines(lines, columns)


def read_json_records(
    spark: SparkSession, paths: str | Sequence[str], label_fields: Sequence[str] = ("label",)
) -> DataFrame:
    """JSON lines by physical line, good ones and rejects alike, with source_file, line_number and byte_offset."""
    return parse_json_lines(positions.read_lines(spark, paths), label_fields)


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text: no value and NaN give blanks, booleans lower case, times ISO in UTC."""
    def text(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            seconds = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            fraction = F.date_format(c, "SSSSSS")
            c = F.concat(
                seconds,
                F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
                F.lit("Z"),
            )
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
        else:
            c = c.cast("string")
        return F.coalesce(c, F.lit("")).alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])


def read_exact_parquet(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = CONNECTION_COLUMNS
) -> DataFrame:
    """Parquet whose columns are exactly the expected list, in order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    if df.columns != list(columns):
        raise ValueError(f"unexpected columns {df.columns}, expected {list(columns)}")
    return df


# Text fields a connection log line may carry.
JSON_FIELDS = (
    "ts",
    "uid",
    "capture_id",
    "pcap",
    "id.orig_h",
    "orig_h",
    "id.resp_h",
    "resp_h",
    "id.resp_p",
    "resp_p",
    "proto",
    "service",
    "conn_state",
    "duration",
    "orig_bytes",
    "resp_bytes",
    "orig_pkts",
    "resp_pkts",
    "observed_tactics",
    "observed_techniques",
    "source_identity_sha256",
    "_source_records",
)


def parse_json_lines(
    lines: DataFrame, label_fields: Sequence[str] = ("label",), raw: str = "value"
) -> DataFrame:
    """JSON lines to text fields with ``reject_reason`` (null for good lines).

    Nothing is dropped here: good lines go on by ``reject_reason IS NULL``, and the reasons can be
    counted from the same scan. Blank lines are no records.
    """
    fields = list(dict.fromkeys([*JSON_FIELDS, *label_fields]))
    ddl = ", ".join(f"`{f}` string" for f in [*fields, "_corrupt"])
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    row = lines.where(F.trim(raw) != "").withColumn("_row", F.from_json(raw, ddl, options))
    get = lambda name: F.col("_row")[name]
    stamp = S.finite_double(get("ts"), -1.0)
    has_stamp = F.array_contains(F.json_object_keys(F.col(raw)), "ts")
    records = get("_source_records")
    reason = (
        F.when(
            get("_corrupt").isNotNull(),
            F.when(F.try_parse_json(F.col(raw)).isNull(), F.lit("invalid_json")).otherwise(
                F.lit("missing_timestamp")
            ),
        )
        .when(get("ts").isNull() & ~F.coalesce(has_stamp, F.lit(False)), F.lit("missing_timestamp"))
        .when(stamp < 0, F.lit("invalid_timestamp"))
        .when(S.first_label(*[get(f) for f in label_fields]).isNull(), F.lit("missing_label"))
        .when(records.isNotNull() & ~records.startswith("["), F.lit("invalid_source_lineage"))
    )
    kept = [c for c in lines.columns if c != raw]
    return row.select(
        *kept,
        F.sha2(raw, 256).alias("raw_line_sha256"),
        reason.alias("reject_reason"),
        *[get(f).alias(f) for f in fields],
    )


def inspect_batches(rows: DataFrame, batch: str, epoch: str, bad: Column) -> DataFrame:
    """Records, first and last time per batch, and whether the batch may be acquired."""
    grouped = rows.groupBy(batch).agg(
        F.count_if(~bad).alias("record_count"),
        F.count_if(bad).alias("bad_line_count"),
        F.min(F.when(~bad, F.col(epoch))).alias("first_epoch"),
        F.max(F.when(~bad, F.col(epoch))).alias("last_epoch"),
    )
    return grouped.withColumn(
        "acceptable", (F.col("bad_line_count") == 0) & (F.col("record_count") > 0)
    )
