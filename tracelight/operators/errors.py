"""Error analysis: misclassified rows, rates, transitions, ambiguity, feature drift, margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import scalars as S


def is_error() -> Column:
    return F.col("actual") != F.col("predicted")


def misclassified(rows: DataFrame, probabilities: str, index_of: Column | None = None) -> DataFrame:
    """Wrong rows with both probabilities and the margin between them.

    ``probabilities`` holds one value per class; classes are the positions unless the rows carry
    columns ``actual_index`` and ``predicted_index``.
    """
    at = lambda name: F.get(probabilities, F.col(name).cast("int"))
    actual = "actual_index" if "actual_index" in rows.columns else "actual"
    predicted = "predicted_index" if "predicted_index" in rows.columns else "predicted"
    wrong = rows.where(is_error())
    return wrong.withColumns(
        {
            "predicted_probability": at(predicted),
            "true_label_probability": at(actual),
            "confidence_margin": at(predicted) - at(actual),
        }
    )


def error_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, errors and error rate per key."""
    errors = F.count_if(is_error())
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        errors.alias("error_count"),
        (errors / F.count(F.lit(1))).alias("error_rate"),
    )


def rates_by_range(rows: DataFrame, count: Column | str) -> DataFrame:
    """Error rate per event-count range; ranges without rows stay with rate zero."""
    names = F.array(*[F.lit(name) for name, _ in S.EVENT_COUNT_RANGES])
    ranges = rows.sparkSession.range(1).select(F.explode(names).alias("event_range"))
    counted = rows.withColumn("event_range", S.event_count_range(count))
    counts = counted.groupBy("event_range").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(is_error()).alias("error_count")
    )
    dense = ranges.join(counts, "event_range", "left").fillna(0, ["row_count", "error_count"])
    return dense.withColumn("error_rate", S.ratio("error_count", "row_count"))


def transitions(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of actual-to-predicted confusions."""
    return rows.where(is_error()).groupBy(*keys, "actual", "predicted").agg(
        F.count(F.lit(1)).alias("error_count")
    )


def bidirectional_pairs(moves: DataFrame) -> DataFrame:
    """Class pairs that are confused in both directions, with the errors of both."""
    pairs = moves.groupBy(
        F.least("actual", "predicted").alias("first_class"),
        F.greatest("actual", "predicted").alias("second_class"),
    ).agg(F.sum("error_count").alias("error_count"), F.count_distinct("actual").alias("_ways"))
    return pairs.where("_ways = 2").drop("_ways")


def ambiguous_groups(
    rows: DataFrame,
    features: Sequence[str],
    *,
    label: str = "actual",
    capture: str = "capture_id",
    identity: str = "window_id",
    digits: int = 10,
    examples: int = 5,
) -> DataFrame:
    """Equal (rounded) feature vectors that carry several labels.

    Rows combine per (vector, label, capture) before the shuffle. Example ids come from a top-n
    window, whose limit also runs before its shuffle.
    """
    signature = [F.round(c, digits).alias(f"_s{i}") for i, c in enumerate(features)]
    names = [f"_s{i}" for i in range(len(features))]
    marked = rows.select(
        identity, F.col(label).alias("_label"), F.col(capture).alias("_capture"), is_error().alias("_error"), *signature
    )
    small = marked.groupBy(*names, "_label", "_capture").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_error").alias("_errors"), F.min(identity).alias("_first")
    )
    labels = small.groupBy(*names, "_label").agg(
        F.sum("_n").alias("_n"),
        F.sum("_errors").alias("_errors"),
        F.count(F.lit(1)).alias("_captures"),
        F.min("_first").alias("_first"),
    )
    text = F.concat_ws("=", "_label", F.col("_n").cast("string"))
    groups = labels.groupBy(*names).agg(
        F.sum("_n").alias("row_count"),
        F.sum("_errors").alias("error_count"),
        F.count(F.lit(1)).alias("label_count"),
        F.array_join(F.array_sort(F.collect_list(text)), ",").alias("labels"),
        F.min("_first").alias("group_id"),
    ).where("label_count > 1")
    if not examples:
        return groups.drop(*names)
    place = F.row_number().over(Window.partitionBy(*names).orderBy(identity))
    few = marked.withColumn("_place", place).where(F.col("_place") <= examples)
    listed = few.groupBy(*names).agg(F.array_sort(F.collect_list(identity)).alias("example_ids"))
    return groups.join(listed, names).drop(*names)


def ambiguity_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("ambiguous_group_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("ambiguous_row_count"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_count_in_groups"),
    )


def _references(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per transition and feature: mean over its errors and over the correct rows of both classes.

    One grouped pass gives the means of errors and correct rows alike; the rest is a small table.
    """
    means = rows.groupBy("actual", "predicted").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in features]
    )
    long = means.unpivot(["actual", "predicted", "n"], list(features), "feature", "mean")
    errors = long.where(is_error()).select(
        "actual", "predicted", "feature", F.col("n").alias("error_count"), F.col("mean").alias("error_mean")
    )
    correct = long.where(~is_error())
    for side, key in (("true", "actual"), ("predicted", "predicted")):
        reference = correct.select(
            F.col("actual").alias(key),
            "feature",
            F.col("n").alias(f"correct_{side}_count"),
            F.col("mean").alias(f"{side}_mean"),
        )
        errors = errors.join(reference, [key, "feature"], "left")
    return errors


def drift_summary(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per transition: reference counts, status and distance of the error mean to both class means."""
    square = lambda side: (F.col("error_mean") - F.col(f"{side}_mean")) ** 2
    summed = _references(rows, features).groupBy("actual", "predicted").agg(
        F.max("error_count").alias("error_count"),
        F.coalesce(F.max("correct_true_count"), F.lit(0)).alias("correct_true_count"),
        F.coalesce(F.max("correct_predicted_count"), F.lit(0)).alias("correct_predicted_count"),
        F.sqrt(F.sum(square("true"))).alias("_true"),
        F.sqrt(F.sum(square("predicted"))).alias("_predicted"),
    )
    complete = (F.col("correct_true_count") > 0) & (F.col("correct_predicted_count") > 0)
    return summed.select(
        "actual",
        "predicted",
        "error_count",
        "correct_true_count",
        "correct_predicted_count",
        F.when(complete, "analyzed").otherwise("insufficient-correct-reference-rows").alias("status"),
        F.when(complete, F.col("_true")).alias("distance_to_true"),
        F.when(complete, F.col("_predicted")).alias("distance_to_predicted"),
    )


def feature_drift(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per transition and feature: error mean, both reference means, and which one it is closer to."""
    known = _references(rows, features).where(
        F.col("true_mean").isNotNull() & F.col("predicted_mean").isNotNull()
    )
    to_true = F.abs(F.col("error_mean") - F.col("true_mean"))
    to_predicted = F.abs(F.col("error_mean") - F.col("predicted_mean"))
    return known.select(
        "actual",
        "predicted",
        "feature",
        "error_mean",
        "true_mean",
        "predicted_mean",
        to_true.alias("error_to_true"),
        to_predicted.alias("error_to_predicted"),
        (to_true - to_predicted).alias("closeness_delta"),
    )


def margin_histogram(errors: DataFrame, margin: str, top: int = 3) -> DataFrame:
    """Histogram of the margins of the most frequent transitions, 4 to 12 bins by error count."""
    moves = errors.groupBy("actual", "predicted").agg(
        F.count(F.lit(1)).alias("_n"), F.min(margin).alias("_low"), F.max(margin).alias("_high")
    )
    busiest = moves.orderBy(F.desc("_n"), "actual", "predicted").limit(top)
    bins = F.greatest(F.lit(4), F.least(F.lit(12), F.col("_n"))).cast("int")
    joined = errors.join(busiest, ["actual", "predicted"]).withColumn("bin_count", bins)
    place = F.floor((F.col(margin) - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("bin_count"))
    inside = F.when(F.col("_high") > F.col("_low"), F.least(place, F.col("bin_count") - 1)).otherwise(
        F.floor(F.col("bin_count") / 2)
    )
    return joined.groupBy("actual", "predicted", "bin_count", inside.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("error_count")
    )


def check_error_records(
    records: DataFrame, rows: DataFrame, identity: str, compared: Sequence[str]
) -> DataFrame:
    """Error records against the rows they point to: absent, repeated or different in any field.

    Of repeated records the smallest value of each field is compared.
    """
    recorded = records.groupBy(identity).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.min(c).alias(f"_r_{c}") for c in compared]
    )
    stored = rows.select(identity, *[F.col(c).alias(f"_s_{c}") for c in compared], F.lit(True).alias("_there"))
    joined = recorded.join(stored, identity, "left")
    differs = [
        F.count_if(F.col("_there") & ~F.col(f"_r_{c}").eqNullSafe(F.col(f"_s_{c}"))).alias(f"{c}_mismatches")
        for c in compared
    ]
    return joined.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("_there").isNull()).alias("absent_count"),
        F.count_if(F.col("_copies") > 1).alias("repeated_count"),
        *differs,
    )
