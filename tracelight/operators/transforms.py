"""Training-only scalers, heavy-tail transforms and class weights.

Fitted parameters are one row. They enter later plans as scalar subqueries, so no join is planned and
nothing passes through user code on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.operators.ranking import exact_quantiles

# Features with heavy tails, which are log-scaled first.
HEAVY_TAILED = (
    "connection_count",
    "unique_destination_count",
    "unique_destination_port_count",
    "duration_mean",
    "duration_std",
    "duration_max",
    "originator_bytes_sum",
    "responder_bytes_sum",
    "originator_packets_sum",
    "responder_packets_sum",
)
MODES = ("standard", "log1p", "log1p-winsor")


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: ``training_rows`` and structs ``mean`` and ``scale`` (1 where a feature is constant)."""
    spread = [F.stddev_pop(c).alias(c) for c in features]
    fitted = train.agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.struct(*[F.avg(c).alias(c) for c in features]).alias("mean"),
        F.struct(*spread).alias("_spread"),
    )
    scale = [
        F.when(F.col("_spread")[c] > 0, F.col("_spread")[c]).otherwise(F.lit(1.0)).alias(c)
        for c in features
    ]
    constant = F.array_compact(
        F.array(*[F.when(F.col("_spread")[c] == 0, F.lit(c)) for c in features])
    )
    return fitted.select(
        "training_rows", "mean", F.struct(*scale).alias("scale"), constant.alias("zero_variance")
    )


def scaler_table(fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form of a fitted scaler: (feature, mean, scale, zero_variance)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col("mean")[c].alias("mean"),
                F.col("scale")[c].alias("scale"),
                F.array_contains("zero_variance", c).alias("zero_variance"),
            )
            for c in features
        ]
    )
    return fitted.select("training_rows", F.inline(rows))


def _parameters(fitted: DataFrame, *columns: str) -> Column:
    """Fitted values as one struct, so that a plan holds one subquery per fitted table."""
    return fitted.select(F.struct(*columns)).scalar()


def standardize(rows: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / scale for every feature, other columns unchanged."""
    fit = F.col("_fit")
    scaled = {c: (F.col(c) - fit["mean"][c]) / fit["scale"][c] for c in features}
    return rows.withColumn("_fit", _parameters(fitted, "mean", "scale")).withColumns(scaled).drop("_fit")


def _logged(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    heavy = [c for c in features if c in HEAVY_TAILED]
    if not heavy:
        raise ValueError("the schema has no heavy-tailed feature")
    negative = F.raise_error(F.lit("log-scaled features must not be negative")).cast("double")
    return rows.withColumns(
        {c: F.when(F.col(c) < 0, negative).otherwise(F.log1p(F.col(c))) for c in heavy}
    )


def _clipped(rows: DataFrame, bounds: DataFrame, heavy: Sequence[str]) -> DataFrame:
    fit = F.col("_fit")
    clip = {c: F.greatest(F.least(F.col(c), fit["high"][c]), fit["low"][c]) for c in heavy}
    return rows.withColumn("_fit", _parameters(bounds, "low", "high")).withColumns(clip).drop("_fit")


def quantile_bounds(
    rows: DataFrame, features: Sequence[str], lower: float, upper: float
) -> DataFrame:
    """Exact lower and upper quantile of every feature, long form (feature, low, high)."""
    long = rows.select(*features).unpivot([], list(features), "feature", "value")
    found = exact_quantiles(long, keys=["feature"], value="value", probabilities=[lower, upper])
    return found.groupBy("feature").agg(
        F.max(F.when(F.col("probability") == lower, F.col("quantile"))).alias("low"),
        F.max(F.when(F.col("probability") == upper, F.col("quantile"))).alias("high"),
    )


def fit_transform(
    train: DataFrame,
    features: Sequence[str],
    mode: str,
    lower: float = 0.001,
    upper: float = 0.999,
) -> tuple[DataFrame, DataFrame | None]:
    """(scaler, bounds) of one of the three modes, from training rows only."""
    if mode not in MODES:
        raise ValueError(f"no such transform: {mode}; known are {', '.join(MODES)}")
    if not 0 <= lower < upper <= 1:
        raise ValueError(f"bounds {lower} and {upper} are not rising shares of one")
    if mode == "standard":
        return fit_scaler(train, features), None
    heavy = [c for c in features if c in HEAVY_TAILED]
    logged = _logged(train, features)
    if mode == "log1p":
        return fit_scaler(logged, features), None
    table = quantile_bounds(logged, heavy, lower, upper)
    pick = lambda side: F.struct(
        *[F.max(F.when(F.col("feature") == c, F.col(side))).alias(c) for c in heavy]
    ).alias(side)
    bounds = table.agg(pick("low"), pick("high"))
    return fit_scaler(_clipped(logged, bounds, heavy), features), bounds


def apply_transform(
    rows: DataFrame,
    features: Sequence[str],
    mode: str,
    fitted: tuple[DataFrame, DataFrame | None],
) -> DataFrame:
    """Rows of any split in the fitted feature space."""
    scaler, bounds = fitted
    if mode != "standard":
        rows = _logged(rows, features)
    if bounds is not None:
        rows = _clipped(rows, bounds, [c for c in features if c in HEAVY_TAILED])
    return standardize(rows, scaler, features)


def class_weights(train: DataFrame, strategy: str, label: str = "label") -> DataFrame:
    """Weight per training label: ``balanced``, ``sqrt-balanced`` or ``none``."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("row_count"))
    whole = counts.agg(F.struct(F.sum("row_count").alias("rows"), F.count(F.lit(1)).alias("classes")))
    counts = counts.withColumn("_whole", whole.scalar())
    balanced = F.col("_whole.rows") / (F.col("_whole.classes") * F.col("row_count"))
    weight = {
        "balanced": balanced,
        "sqrt-balanced": F.sqrt(balanced),
        "none": F.lit(1.0),
    }.get(strategy)
    if weight is None:
        raise ValueError(f"unknown class-weight strategy: {strategy}")
    return counts.withColumn("weight", weight.cast("double")).drop("_whole")
