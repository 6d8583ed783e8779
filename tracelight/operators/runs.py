"""Comparison of training runs: summaries, best checkpoints, attack effects, sensitivity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import scalars as S


def metric_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long table (keys, metric): count, mean, population deviation, minimum, maximum; nulls are left out."""
    long = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "_x"
    )
    spread = F.when(F.count("_x") > 1, F.stddev_pop("_x")).otherwise(F.lit(0.0))
    return long.groupBy(*keys, "metric").agg(
        F.count("_x").alias("value_count"),
        F.avg("_x").alias("mean"),
        spread.alias("population_stddev"),
        F.min("_x").alias("minimum"),
        F.max("_x").alias("maximum"),
    )


def run_summary(runs: DataFrame, variant: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over the repeated runs of a variant; one run deviates by zero."""
    columns = []
    for m in metrics:
        columns.append(F.avg(m).alias(f"{m}_mean"))
        columns.append(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sample_std"))
    return runs.groupBy(variant).agg(F.count(F.lit(1)).alias("run_count"), *columns)


def weighted_losses(
    rows: DataFrame, keys: Sequence[str], losses: Sequence[str], weight: str
) -> DataFrame:
    """Example-weighted means; a group without examples stops the job."""
    total = F.sum(weight)
    none = F.raise_error(F.lit("aggregation needs positive training support")).cast("double")
    means = [
        F.when(total > 0, F.sum(F.col(c) * F.col(weight)) / total).otherwise(none).alias(c)
        for c in losses
    ]
    return rows.groupBy(*keys).agg(total.alias("total_examples"), *means)


def best_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order; the limit also runs before the shuffle."""
    if not keys:
        return rows.orderBy(*order).limit(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def best_round(rows: DataFrame, keys: Sequence[str], metric: str, round_: str = "round") -> DataFrame:
    """Highest validation metric, the earliest round on ties."""
    return best_row(rows, keys, [F.desc(metric), F.asc(round_)])


def best_candidate(rows: DataFrame, keys: Sequence[str], metric: str, weight: str, *more: str) -> DataFrame:
    """Highest metric, then the smallest weight (and further columns)."""
    return best_row(rows, keys, [F.desc(metric), F.asc(weight), *[F.asc(m) for m in more]])


def best_variant(summary: DataFrame, metric: str, loss: str, name: str) -> DataFrame:
    """Highest mean metric, then lowest mean loss, then name."""
    return best_row(summary, [], [F.desc(metric), F.asc(loss), F.asc(name)])


def best_profile(rows: DataFrame, keys: Sequence[str], metric: str, name: str) -> DataFrame:
    """Highest metric; on ties the greatest profile id."""
    return best_row(rows, keys, [F.desc(metric), F.desc(name)])


def best_epoch(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest-loss epoch (earliest on ties), best-F1 epoch, and whether training went on to overfit.

    History columns: epoch, train_loss, validation_loss, validation_f1. One grouped pass.
    """
    chosen = history.groupBy(*keys).agg(
        F.min(F.struct("validation_loss", "epoch", "train_loss")).alias("_best"),
        F.min(F.struct((-F.col("validation_f1")).alias("score"), "epoch")).alias("_f1"),
        F.max(F.struct("epoch", "validation_loss", "train_loss")).alias("_last"),
    )
    worse = F.col("_last.validation_loss") > F.col("_best.validation_loss") * 1.05
    lower = F.col("_last.train_loss") < F.col("_best.train_loss")
    return chosen.select(
        *keys,
        F.col("_best.epoch").alias("best_loss_epoch"),
        F.col("_best.validation_loss").alias("best_validation_loss"),
        F.col("_f1.epoch").alias("best_f1_epoch"),
        F.col("_last.epoch").alias("final_epoch"),
        (worse & lower).alias("possible_overfit"),
    )


def communication(
    uploads: DataFrame, broadcasts: DataFrame, keys: Sequence[str], clients: Column | str
) -> DataFrame:
    """Bytes per round: model and prototype uploads, and both broadcasts to every client."""
    up = uploads.groupBy(*keys).agg(
        F.sum("model_bytes").alias("upload_model_bytes"),
        F.sum("prototype_bytes").alias("upload_prototype_bytes"),
        F.count(F.lit(1)).alias("_clients"),
    )
    count = F.col(clients) if isinstance(clients, str) else clients
    joined = up.join(broadcasts, list(keys))
    down = joined.withColumn("broadcast_model_bytes", F.col("model_bytes") * count).withColumn(
        "broadcast_prototype_bytes", F.col("prototype_bytes") * count
    )
    parts = ("upload_model_bytes", "upload_prototype_bytes", "broadcast_model_bytes", "broadcast_prototype_bytes")
    return down.select(*keys, *parts, sum((F.col(p) for p in parts[1:]), F.col(parts[0])).alias("total_bytes"))


def learning_curve(records: DataFrame, keys: Sequence[str], history: str = "history") -> DataFrame:
    """One row per local epoch from nested histories, with an epoch number running over the rounds."""
    flat = records.select(*keys, "round", "epochs", F.explode(history).alias("_e"))
    return flat.select(
        *keys,
        "round",
        ((F.col("round") - 1) * F.col("epochs") + F.col("_e.epoch")).alias("global_local_epoch"),
        "_e.*",
    )


def client_summary(curve: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """First and last value of each metric per client, and the change in between."""
    first = F.min(F.struct("global_local_epoch", *metrics))
    last = F.max(F.struct("global_local_epoch", *metrics))
    grouped = curve.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("epoch_count"), first.alias("_first"), last.alias("_last")
    )
    columns = []
    for m in metrics:
        columns.append(F.col("_first")[m].alias(f"first_{m}"))
        columns.append(F.col("_last")[m].alias(f"last_{m}"))
        columns.append((F.col("_last")[m] - F.col("_first")[m]).alias(f"{m}_change"))
    return grouped.select("client_id", "epoch_count", *columns)


def comparability(candidates: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Whether all candidates of a sweep agree on every setting: (keys, field, values, comparable)."""
    long = candidates.select(
        *keys, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    ).unpivot(list(keys), list(fields), "field", "_v")
    seen = long.groupBy(*keys, "field", "_v").agg(F.lit(1).alias("_one"))
    return seen.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("value_count")).withColumn(
        "comparable", F.col("value_count") == 1
    )


def deltas(
    candidate: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Candidate and baseline side by side with their differences, on equal keys."""
    base = baseline.select(*keys, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    joined = candidate.select(*keys, *metrics).join(base, list(keys)) if keys else (
        candidate.select(*metrics).withColumn("_b", base.select(F.struct("*")).scalar()).select(*metrics, "_b.*")
    )
    return joined.select(
        *keys,
        *metrics,
        *[(F.col(m) - F.col(f"baseline_{m}")).alias(f"{m}_delta") for m in metrics],
    )


def attack_effects(
    outcomes: DataFrame, keys: Sequence[str], metrics: Sequence[str], clean: str = "clean"
) -> DataFrame:
    """Each attacked condition minus the clean one per key: deltas of every metric."""
    base = outcomes.where(F.col("condition") == clean).select(
        *keys, *[F.col(m).alias(f"_c_{m}") for m in metrics]
    )
    attacked = outcomes.where(F.col("condition") != clean)
    return attacked.join(base, list(keys)).select(
        "condition",
        *keys,
        *[(F.col(m) - F.col(f"_c_{m}")).alias(f"{m}_delta") for m in metrics],
        *[F.col(m).alias(f"attacked_{m}") for m in metrics],
    )


def sweep_grid(
    f_values: DataFrame, scale_values: DataFrame, *, fixed_f: int, fixed_scale: float
) -> DataFrame:
    """One-factor-at-a-time cells: both factor lines, the shared cell once, with token and anchor."""
    line_f = f_values.select("f", F.lit(float(fixed_scale)).alias("scale"))
    line_s = scale_values.select(F.lit(fixed_f).alias("f"), F.col("scale").cast("double").alias("scale"))
    cells = line_f.select(F.col("f").cast("int").alias("f"), "scale").unionByName(line_s).distinct()
    return cells.select(
        F.format_string("f%d-scale-%s", "f", S.scale_token("scale")).alias("scenario_id"),
        "f",
        "scale",
        ((F.col("f") == fixed_f) & (F.col("scale") == float(fixed_scale))).alias("primary_anchor"),
    )


def sensitivity_extrema(rows: DataFrame, baseline: str, robust: str) -> DataFrame:
    """Worst baseline recall loss with its scenario, largest robust deviation, largest targeted rate."""
    of = lambda name: F.col("profile") == name
    loss = F.when(of(baseline), F.struct("recall_delta", "scenario_id", "attacked_recall"))
    return rows.agg(
        F.min(loss).alias("_worst"),
        F.max(F.when(of(robust), F.abs("recall_delta"))).alias("largest_robust_recall_change"),
        F.max("attacked_targeted_rate").alias("largest_targeted_rate"),
    ).select(
        F.col("_worst.scenario_id").alias("worst_scenario_id"),
        F.col("_worst.recall_delta").alias("worst_recall_delta"),
        F.col("_worst.attacked_recall").alias("worst_attacked_recall"),
        "largest_robust_recall_change",
        "largest_targeted_rate",
    )


def client_class_analysis(
    supports: DataFrame, candidate: DataFrame, head: DataFrame, baseline: DataFrame
) -> DataFrame:
    """Per client and class: support category and F1 of two classifiers against a baseline."""
    keys = ["client_id", "class"]
    f1 = lambda df, name: df.select(*keys, F.col("f1").alias(name))
    joined = (
        supports.select(*keys, F.col("support").alias("training_support"))
        .join(f1(candidate, "candidate_f1"), keys)
        .join(f1(head, "head_f1"), keys)
        .join(f1(baseline, "baseline_f1"), keys)
    )
    return joined.withColumns(
        {
            "support_category": S.support_category("training_support"),
            "candidate_delta": F.col("candidate_f1") - F.col("baseline_f1"),
            "head_delta": F.col("head_f1") - F.col("baseline_f1"),
        }
    )
