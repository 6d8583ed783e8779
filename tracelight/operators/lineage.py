"""Lineage from windows to events, source records and files; graphs and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S


def lineage_edges(
    admissions: DataFrame, snapshots: DataFrame, window_rows: DataFrame
) -> DataFrame:
    """Relations (relation, subject, object) from batches over snapshots to windows.

    ``admissions``: batch_id, decision_id, snapshot_id. ``snapshots``: snapshot_id.
    ``window_rows``: window_id, snapshot_id.
    """
    activity = F.concat(F.lit("activity-build-"), "snapshot_id")

    def relation(df: DataFrame, name: str, subject: Column, target: Column) -> DataFrame:
        return df.select(F.lit(name).alias("relation"), subject.alias("subject"), target.alias("object"))

    return (
        relation(admissions, "wasAdmittedBy", F.col("batch_id"), F.col("decision_id"))
        .unionByName(relation(admissions, "used", activity, F.col("batch_id")))
        .unionByName(relation(snapshots, "wasGeneratedBy", F.col("snapshot_id"), activity))
        .unionByName(relation(window_rows, "wasDerivedFrom", F.col("window_id"), F.col("snapshot_id")))
    )


def lineage_nodes(
    admissions: DataFrame, snapshots: DataFrame, window_rows: DataFrame
) -> DataFrame:
    """Entities and activities (id, type) of the same graph."""
    def node(df: DataFrame, kind: str, name: Column) -> DataFrame:
        return df.select(name.alias("id"), F.lit(kind).alias("type"))

    return (
        node(admissions, "batch_bundle", F.col("batch_id"))
        .unionByName(node(admissions, "admission_decision", F.col("decision_id")))
        .unionByName(node(snapshots, "dataset_snapshot", F.col("snapshot_id")))
        .unionByName(node(snapshots, "snapshot_construction", F.concat(F.lit("activity-build-"), "snapshot_id")))
        .unionByName(node(window_rows, "feature_window", F.col("window_id")))
        .distinct()
    )


def resolve_lineage(
    selected: DataFrame,
    window_events: DataFrame,
    event_sources: DataFrame,
    files: DataFrame,
    *,
    window: str = "window_id",
    event: str = "event_id",
    file: str = "source_file",
) -> DataFrame:
    """Selected windows down to source files; a gap stays as a row with the step it ends at.

    ``event_sources`` has one row per source record, ``files`` one per file with ``file_sha256``.
    Joins are left equi-joins, so a hot file or event is the engine's skew to split, and nothing is
    collected per window. Digests pass the joins packed.
    """
    digests = {c: df for df in (event_sources, files) for c in ("record_sha256", "file_sha256") if c in df.columns}
    packed = [df.withColumns({c: S.pack_digest(c) for c, own in digests.items() if own is df}) for df in (event_sources, files)]
    down = (
        selected.select(window)
        .join(window_events.select(window, event).distinct(), window, "left")
        .join(packed[0], event, "left")
        .join(packed[1], file, "left")
        .withColumns({c: S.unpack_digest(c) for c in digests})
    )
    gap = (
        F.when(F.col(event).isNull(), F.lit("no-event"))
        .when(F.col(file).isNull(), F.lit("no-source-record"))
        .when(F.col("file_sha256").isNull(), F.lit("no-source-file"))
        .otherwise(F.lit("resolved"))
    )
    return down.withColumn("resolution", gap)


def window_completeness(resolved: DataFrame, window: str = "window_id", event: str = "event_id") -> DataFrame:
    """Per window: events, source records and whether every path reached a file."""
    return resolved.groupBy(window).agg(
        F.count_distinct(event).alias("event_count"),
        F.count_if(F.col("resolution").isin("resolved", "no-source-file")).alias("source_record_count"),
        (F.count_if(F.col("resolution") != "resolved") == 0).alias("lineage_complete"),
    )


def completeness_counts(resolved: DataFrame, window: str = "window_id") -> DataFrame:
    """Complete and incomplete windows, and the violations behind them by kind."""
    per_window = resolved.groupBy(window).agg(
        *[
            F.count_if(F.col("resolution") == kind).alias(kind.replace("-", "_"))
            for kind in ("no-event", "no-source-record", "no-source-file")
        ]
    )
    violations = F.col("no_event") + F.col("no_source_record") + F.col("no_source_file")
    return per_window.agg(
        F.count_if(violations == 0).alias("complete_window_count"),
        F.count_if(violations > 0).alias("incomplete_window_count"),
        F.sum("no_event").alias("windows_without_event"),
        F.sum("no_source_record").alias("events_without_record"),
        F.sum("no_source_file").alias("records_without_file"),
        F.sum(violations).alias("invariant_violation_count"),
    )


def coverage(tables: dict[str, DataFrame], key: str, compared: Sequence[str]) -> DataFrame:
    """Whether every key occurs exactly once in every table, with equal values of the shared columns.

    One union and one grouped pass instead of a chain of full outer joins.
    """
    rows = None
    for name, df in tables.items():
        shared = [
            (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
            for c in compared
        ]
        part = df.select(key, F.lit(name).alias("_table"), *shared)
        rows = part if rows is None else rows.unionByName(part)
    grouped = rows.groupBy(key).agg(
        *[F.count_if(F.col("_table") == name).alias(f"_n_{name}") for name in tables],
        *[(F.count_distinct(c) > 1).alias(f"_d_{c}") for c in compared],
    )
    missing = [F.when(F.col(f"_n_{n}") == 0, F.lit(f"missing-{n}")) for n in tables]
    repeated = [F.when(F.col(f"_n_{n}") > 1, F.lit(f"repeated-{n}")) for n in tables]
    differing = [F.when(F.col(f"_d_{c}"), F.lit(f"different-{c}")) for c in compared]
    problems = F.array_compact(F.array(*missing, *repeated, *differing))
    return grouped.select(key, F.coalesce(F.nullif(F.array_join(problems, ","), F.lit("")), F.lit("covered")).alias("status"))


def row_digest(columns: Sequence[str], digits: int = 9) -> Column:
    """Digest of a row whose fractional columns are first fixed to ``digits`` decimals."""
    return S.canonical_digest(*[F.format_string(f"%.{digits}f", F.round(F.col(c), digits) + F.lit(0.0)) for c in columns])


def compare_rows(recomputed: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Stored rows against their reconstruction: equal, different or absent on one side."""
    left = recomputed.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_l"))
    right = stored.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_l").isNull(), F.lit("not-reconstructed"))
        .when(F.col("_r").isNull(), F.lit("not-stored"))
        .when(F.col("_a").eqNullSafe(F.col("_b")), F.lit("equal"))
        .otherwise(F.lit("different"))
    )
    return left.join(right, key, "full").select(key, status.alias("status"))
