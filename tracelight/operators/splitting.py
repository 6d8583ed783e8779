"""Leakage-safe splits, training-only sampling and their verifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators.ranking import hash_ranked

SPLITS = ("train", "validation", "test", "temporal_holdout")


def _check_percentages(percentages: Mapping[str, int]) -> None:
    if sum(percentages[name] for name in ("train", "validation", "test")) != 100:
        raise ValueError(f"shares of the splits sum to {sum(percentages.values())}, not to 100")


def hash_split(group: Column | str, seed: int, percentages: Mapping[str, int]) -> Column:
    """Split of a group from the hash of its id alone."""
    _check_percentages(percentages)
    bucket = S.hash_bucket(seed, group)
    return (
        F.when(bucket < percentages["train"], F.lit("train"))
        .when(bucket < percentages["train"] + percentages["validation"], F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def grouped_time_split(
    captures: DataFrame,
    *,
    holdout_epoch: int,
    percentages: Mapping[str, int],
    stratum: str = "stratum",
) -> DataFrame:
    """``capture_id`` with its split: a reserved last period, then chronological per stratum.

    Works on the capture table (one row per calendar day), never on the windows. A stratum needs three
    captures, so that each split gets one.
    """
    _check_percentages(percentages)
    development = F.col("start_epoch") < F.lit(holdout_epoch)
    lane = Window.partitionBy(development, F.col(stratum))
    ordered = lane.orderBy("start_epoch", "capture_id")
    n = F.count(F.lit(1)).over(lane)
    train = F.greatest(F.lit(1), F.floor(n * F.lit(percentages["train"]) / 100))
    validation = F.greatest(F.lit(1), F.floor(n * F.lit(percentages["validation"]) / 100))
    crowded = train + validation >= n
    train_end = F.when(crowded, n - 2).otherwise(train)
    validation_end = train_end + F.when(crowded, F.lit(1)).otherwise(validation)
    place = F.row_number().over(ordered) - 1
    too_few = F.raise_error(F.lit("a stratum before the holdout needs at least three captures"))
    split = (
        F.when(~development, F.lit("temporal_holdout"))
        .when(n < 3, too_few.cast("string"))
        .when(place < train_end, F.lit("train"))
        .when(place < validation_end, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return captures.withColumn("split", split)


def apply_split(windows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Windows with the split of their capture; the capture table decides its own join strategy."""
    return windows.join(assignment.select("capture_id", "split"), "capture_id")


def sample_training(
    windows: DataFrame,
    *,
    seed: int,
    majority_labels: Sequence[str],
    majority_fraction: float,
    minority_fraction: float = 1.0,
) -> DataFrame:
    """Keeps a hash-ranked share of every training class; other splits stay whole."""
    for fraction in (majority_fraction, minority_fraction):
        if not 0 < fraction <= 1:
            raise ValueError("sampling fractions must be in (0, 1]")
    if not majority_labels:
        raise ValueError("sampling needs at least one majority label")
    training = windows.where("split = 'train'")
    ranked = hash_ranked(
        training,
        groups=["label"],
        digest=S.seeded_digest(seed, "label", "window_id"),
        tie="window_id",
        total="_rows",
    )
    fraction = F.when(F.col("label").isin(*majority_labels), F.lit(majority_fraction)).otherwise(
        F.lit(minority_fraction)
    )
    keep = F.when(fraction >= 1, F.col("_rows")).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("_rows") * fraction))
    )
    kept = ranked.where(F.col("hash_rank") <= keep).drop("hash_rank", "_rows")
    return kept.unionByName(windows.where("split <> 'train'"))


def sampling_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts by split and label before and after; evaluation splits must not change."""
    keys = ["split", "label"]
    counts = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    kept = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"))
    joined = counts.join(kept, keys, "full").fillna(0, ["rows_before", "rows_after"])
    valid = F.when(
        F.col("split") == "train", F.col("rows_after").between(1, F.col("rows_before"))
    ).otherwise(F.col("rows_after") == F.col("rows_before"))
    return joined.withColumn("valid", valid)


def straddling_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one split; empty for a leakage-free table."""
    return (
        rows.groupBy(group)
        .agg(F.count_distinct(split).alias("split_count"))
        .where("split_count > 1")
    )


def table_digest(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of a table: row digests added up in four parts, then hashed.

    A digest over a sorted list would pull all rows into one place; sums combine map-side.
    """
    digest = S.canonical_digest(*columns)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        for i in range(4)
    ]
    summed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *[p.alias(f"_p{i}") for i, p in enumerate(parts)]
    )
    text = [F.coalesce(F.col(f"_p{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return summed.select(
        *keys,
        "row_count",
        F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *text), 256).alias("table_sha256"),
    )
