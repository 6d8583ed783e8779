"""Row selection and counterfactual rewriting of evaluation rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators.ranking import hash_ranked


def first_by_id(rows: DataFrame, count: int, identity: str = "window_id") -> DataFrame:
    """The first ``count`` rows in id order, whatever their labels or predictions."""
    return rows.orderBy(identity).limit(count)


def select_ids(rows: DataFrame, wanted: DataFrame, identity: str = "window_id") -> DataFrame:
    """Wanted ids with ``found``: an explicit selection must not miss any."""
    present = rows.select(identity).distinct().withColumn("found", F.lit(True))
    return (
        wanted.select(identity)
        .distinct()
        .join(present, identity, "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def unknown_labels(rows: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Labels of evaluation rows that training never saw."""
    return rows.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


def relabel(rows: DataFrame, source: str, target: str, label: str = "label") -> DataFrame:
    """Rows with one class renamed, and which rows changed."""
    if source == target:
        raise ValueError("source and target class must differ")
    hit = F.col(label) == source
    return rows.withColumn("relabelled", hit).withColumn(
        label, F.when(hit, F.lit(target)).otherwise(F.col(label))
    )


def perturb_fraction(
    rows: DataFrame,
    *,
    values: Mapping[str, float],
    target: str,
    fraction: float,
    seed: int,
    label: str = "label",
    identity: str = "window_id",
) -> DataFrame:
    """Sets feature values and the label of a hash-ranked share of the rows (at least one)."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    ranked = hash_ranked(
        rows, groups=[], digest=S.seeded_digest(seed, identity), tie=identity, total="_rows"
    )
    chosen = F.col("hash_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_rows") * fraction))
    marked = ranked.withColumn("perturbed", chosen).drop("hash_rank", "_rows")
    changes = {c: F.when(F.col("perturbed"), F.lit(float(v))).otherwise(F.col(c)) for c, v in values.items()}
    changes[label] = F.when(F.col("perturbed"), F.lit(target)).otherwise(F.col(label))
    return marked.withColumns(changes)


def triggered_set(
    rows: DataFrame, *, values: Mapping[str, float], target: str, label: str = "label"
) -> DataFrame:
    """Rows of other classes with the trigger features set; the first label is kept aside."""
    eligible = rows.where(F.col(label) != target).withColumn("original_label", F.col(label))
    changes = {c: F.lit(float(v)) for c, v in values.items()}
    return eligible.withColumns({**changes, label: F.lit(target)})


def top_by_hash(rows: DataFrame, count: int, seed: int, identity: str) -> DataFrame:
    """The ``count`` entities that come first in seeded hash order."""
    digest = S.seeded_digest(seed, identity)
    return (
        rows.select(identity).distinct().withColumn("rank_digest", digest)
        .orderBy("rank_digest", identity).limit(count)
    )


def equal_tables(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one side has, counting copies: both counts are zero for equal tables."""
    counted = (
        left.select(*columns).withColumn("_side", F.lit(1))
        .unionByName(right.select(*columns).withColumn("_side", F.lit(-1)))
        .groupBy(*columns)
        .agg(F.sum("_side").alias("_balance"))
    )
    return counted.agg(
        F.coalesce(F.sum(F.greatest("_balance", F.lit(0))), F.lit(0)).cast("bigint").alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_balance"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_right"),
    )
