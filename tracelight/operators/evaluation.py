"""Evaluation of predictions: confusion matrices, metrics, losses, agreement, distributions.

Everything starts from one grouped count by (actual, predicted); later steps work on that small table.
Classes without rows stay in the matrix and in the macro averages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import scalars as S


def confusion_matrix(
    rows: DataFrame,
    classes: Sequence,
    keys: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """Dense counts (keys, actual, predicted, row_count) over the class vocabulary."""
    counts = rows.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    pair = F.struct("actual", "predicted")
    # At most one entry per pair of classes, so the cells of a run fit one row.
    cells = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(pair, "row_count"))).alias("_cells")
    )
    names = F.array(*[F.lit(c) for c in classes])
    grid = cells.withColumn("actual", F.explode(names)).withColumn("predicted", F.explode(names))
    found = F.coalesce(F.try_element_at("_cells", pair), F.lit(0).cast("bigint"))
    return grid.select(*keys, "actual", "predicted", found.alias("row_count"))


def class_metrics(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio is zero."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("row_count")).otherwise(zero)
    roles = F.array(
        F.struct(
            F.col("actual").alias("class"),
            F.col("row_count").alias("support"),
            hit.alias("correct"),
            zero.alias("predicted_count"),
        ),
        F.struct(
            F.col("predicted").alias("class"),
            zero.alias("support"),
            zero.alias("correct"),
            F.col("row_count").alias("predicted_count"),
        ),
    )
    sums = (
        matrix.select(*keys, F.inline(roles))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "correct", "predicted_count")])
    )
    precision = S.ratio("correct", "predicted_count")
    recall = S.ratio("correct", "support")
    # 2PR/(P+R) in counts, which needs no second division by zero case.
    f1 = S.ratio(2 * F.col("correct"), F.col("support") + F.col("predicted_count"))
    return sums.select(
        *keys,
        "class",
        "support",
        "correct",
        "predicted_count",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    )


def overall_metrics(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro averages over all classes, balanced accuracy over the observed ones."""
    observed = F.when(F.col("support") > 0, F.col("recall"))
    return per_class.groupBy(*keys).agg(
        F.sum("support").alias("row_count"),
        F.count_if(F.col("support") > 0).alias("observed_class_count"),
        S.ratio(F.sum("correct"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg(observed).alias("balanced_accuracy"),
    )


def evaluate(
    rows: DataFrame,
    classes: Sequence,
    keys: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    matrix = confusion_matrix(rows, classes, keys, actual, predicted)
    return overall_metrics(class_metrics(matrix, keys), keys)


def row_normalized(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of every prediction among the rows of its actual class."""
    whole = F.sum("row_count").over(Window.partitionBy(*keys, "actual"))
    return matrix.withColumn("share", S.ratio("row_count", whole))


def log_loss(
    rows: DataFrame,
    true_probability: Column | str,
    weight: Column | str | None = None,
    keys: Sequence[str] = (),
    floor: float = 2.0**-52,
) -> DataFrame:
    """Mean negative log probability of the true class, plain and weighted."""
    p = F.col(true_probability) if isinstance(true_probability, str) else true_probability
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    loss = -F.log(F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(loss).alias("log_loss"),
        (F.sum(loss * w) / F.sum(w)).alias("weighted_log_loss"),
    )


def false_alarms(matrix: DataFrame, benign, keys: Sequence[str] = ()) -> DataFrame:
    """Benign rows reported as anything else; the rate is null without benign rows."""
    is_benign = F.col("actual") == F.lit(benign)
    alarm = is_benign & (F.col("predicted") != F.lit(benign))
    counts = matrix.groupBy(*keys).agg(
        F.sum(F.when(is_benign, F.col("row_count")).otherwise(0)).alias("actual_benign_count"),
        F.sum(F.when(alarm, F.col("row_count")).otherwise(0)).alias("false_alarm_count"),
    )
    rate = S.ratio("false_alarm_count", "actual_benign_count", empty=None)
    return counts.withColumn("false_alarm_rate", rate)


def source_integrity(matrix: DataFrame, source, target, keys: Sequence[str] = ()) -> DataFrame:
    """What became of the rows of one class: right, sent to the target class, or elsewhere."""
    of_source = matrix.where(F.col("actual") == F.lit(source))
    counts = of_source.groupBy(*keys).agg(
        F.sum("row_count").alias("source_rows"),
        F.sum(F.when(F.col("predicted") == F.lit(source), F.col("row_count")).otherwise(0)).alias("correct_rows"),
        F.sum(F.when(F.col("predicted") == F.lit(target), F.col("row_count")).otherwise(0)).alias("targeted_rows"),
    )
    other = F.col("source_rows") - F.col("correct_rows") - F.col("targeted_rows")
    return counts.withColumn("other_rows", other).withColumns(
        {
            "source_recall": S.ratio("correct_rows", "source_rows"),
            "misclassification_rate": S.ratio(
                F.col("source_rows") - F.col("correct_rows"), "source_rows"
            ),
            "targeted_rate": S.ratio("targeted_rows", "source_rows"),
            "other_rate": S.ratio(other, "source_rows"),
        }
    )


def success_rate(rows: DataFrame, predicted: str, target, keys: Sequence[str] = ()) -> DataFrame:
    """Share of triggered rows that are predicted as the target class."""
    hit = F.count_if(F.col(predicted) == F.lit(target))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("triggered_rows"),
        hit.alias("success_count"),
        (hit / F.count(F.lit(1))).alias("success_rate"),
    )


def agreement(rows: DataFrame, first: str, second: str, classes: Sequence) -> DataFrame:
    """How often two classifiers agree, overall (class ``all``) and per class of the first one."""
    same = F.count_if(F.col(first) == F.col(second))
    groups = F.array(F.lit("all"), F.col(first).cast("string"))
    counts = rows.select(first, second, F.explode(groups).alias("class")).groupBy("class").agg(
        F.count(F.lit(1)).alias("row_count"), same.alias("agreement_count")
    )
    names = F.array(*[F.lit(n) for n in ["all", *map(str, classes)]])
    dense = (
        rows.sparkSession.range(1).select(F.explode(names).alias("class"))
        .join(counts, "class", "left").fillna(0, ["row_count", "agreement_count"])
    )
    return dense.withColumn("agreement_rate", S.ratio("agreement_count", "row_count", empty=None))


def distribution(value: str, prefix: str) -> list[Column]:
    """Count, mean, minimum and maximum of a measure, all null-safe for empty groups."""
    return [
        F.count(value).alias(f"{prefix}_count"),
        F.avg(value).alias(f"{prefix}_mean"),
        F.min(value).alias(f"{prefix}_minimum"),
        F.max(value).alias(f"{prefix}_maximum"),
    ]


def grouped_distributions(
    rows: DataFrame, measures: dict[str, str], groupings: dict[str, str | None]
) -> DataFrame:
    """Distributions of several measures for several groupings from one pass over the rows.

    ``groupings`` maps a grouping name to its column, or to None for all rows.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("grouping"),
                (F.lit("all") if column is None else F.col(column).cast("string")).alias("group"),
            )
            for name, column in groupings.items()
        ]
    )
    spread = rows.select(*measures.values(), F.inline(cells))
    columns = [c for prefix, value in measures.items() for c in distribution(value, prefix)]
    return spread.groupBy("grouping", "group").agg(F.count(F.lit(1)).alias("row_count"), *columns)


def check_metrics(reported: DataFrame, matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reported row counts and accuracies against the confusion matrix they come with."""
    derived = matrix.groupBy(*keys).agg(
        F.sum("row_count").alias("_rows"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("row_count")).otherwise(0)).alias("_hits"),
    )
    close = F.abs(F.col("accuracy") - S.ratio("_hits", "_rows")) <= 1e-12
    return reported.join(derived, list(keys)).select(
        *keys,
        (F.col("row_count") == F.col("_rows")).alias("rows_match"),
        close.alias("accuracy_matches"),
    )
