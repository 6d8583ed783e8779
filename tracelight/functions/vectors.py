"""Functions on ``array<double>`` columns and the long (id, pos, value) layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite_vector(vector: Column | str, width: int | None = None) -> Column:
    vector = _col(vector)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shape = F.size(vector) > 0 if width is None else F.size(vector) == width
    return F.coalesce(shape & finite, F.lit(False))


def checked_vector(vector: Column | str, width: int) -> Column:
    """The vector itself; a wrong width or a value that is not finite stops the job."""
    vector = _col(vector)
    return F.when(is_finite_vector(vector, width), vector).otherwise(
        F.raise_error(F.lit(f"vector is not finite or not {width} wide")).cast("array<double>")
    )


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def scale(vector: Column | str, factor: Column) -> Column:
    return F.transform(_col(vector), lambda x: x * factor)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(vector: Column | str) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda s, x: s + x * x)


def l2_norm(vector: Column | str) -> Column:
    return F.sqrt(squared_norm(vector))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return l2_norm(subtract(a, b))


def clip_factor(norm: Column | str, limit: Column) -> Column:
    """Factor that brings a vector down to ``limit``; short and zero vectors stay as they are."""
    norm = _col(norm)
    return F.when((norm <= limit) | (norm == 0), F.lit(1.0)).otherwise(limit / norm)


def flatten_tensors(tensors: Column | str) -> Column:
    """One vector from an array of already ravelled tensors."""
    return F.flatten(_col(tensors))


def restore_tensors(vector: Column | str, sizes: Sequence[int]) -> Column:
    """Inverse of :func:`flatten_tensors` for known tensor sizes."""
    vector = _col(vector)
    parts, start = [], 1
    for size in sizes:
        parts.append(F.slice(vector, start, size))
        start += size
    return F.array(*parts)


def softmax(logits: Column | str) -> Column:
    logits = _col(logits)
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def argmax(values: Column | str) -> Column:
    """Zero-based position of the largest value, the first one on ties."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_margin(values: Column | str) -> Column:
    """Largest minus second largest value; a single value is its own margin."""
    ordered = F.sort_array(_col(values), asc=False)
    return F.when(F.size(ordered) > 1, ordered[0] - F.get(ordered, F.lit(1))).otherwise(ordered[0])


def coordinates(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Long layout: one row (keys, pos, value) per coordinate."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))


def gather(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Inverse of :func:`coordinates`; a group holds one row per coordinate of one vector."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def mean_vector(
    df: DataFrame,
    keys: Sequence[str],
    vector: str,
    name: str,
    width: int,
    weight: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """(Weighted) mean vector per key; a vector that is not finite or not ``width`` wide stops the job.

    Means are taken in the long layout, where the shuffle key includes the coordinate and partial sums
    combine before the shuffle, so neither a hot key nor a wide vector ends in one task.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sound = checked_vector(F.col(vector).cast("array<double>"), width)
    long = df.select(*keys, w.alias("_w"), F.posexplode(sound).alias("pos", "value"))
    means = long.groupBy(*keys, "pos").agg(
        (F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("_mean"),
        F.count(F.lit(1)).alias("_count"),
    )
    out = gather(means, keys, "_mean", name)
    if not count:
        return out
    counts = means.where("pos = 0").select(*keys, F.col("_count").alias(count))
    return out.join(counts, list(keys)) if keys else out.withColumn(count, counts.select(count).scalar())
