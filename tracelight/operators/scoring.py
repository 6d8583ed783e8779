"""Batch scoring and attribution of small networks over feature rows.

A model is a handful of weight matrices. It travels to the tasks with the function; rows go through in
Arrow batches and one matrix product per layer. Labels never enter the functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import scalars as S
from tracelight.functions import vectors as V


@dataclass(frozen=True)
class Network:
    """Dense layers with rectifiers in between; one layer is a linear classifier."""

    classes: tuple
    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Logits, and which units of every hidden layer were active."""
        active = []
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            x = x @ w + b
            if i < len(self.weights) - 1:
                active.append(x > 0)
                x = x * active[-1]
        return x, active

    def embed(self, x: np.ndarray) -> np.ndarray:
        """Output of the last hidden layer."""
        for w, b in zip(self.weights[:-1], self.biases[:-1], strict=True):
            x = np.maximum(x @ w + b, 0.0)
        return x

    def input_gradient(self, x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Target logits and their gradients with respect to the input, row by row."""
        logits, active = self.forward(x)
        rows = np.arange(len(x))
        grad = self.weights[-1].T[target]
        for w, mask in zip(reversed(self.weights[:-1]), reversed(active), strict=True):
            grad = (grad * mask) @ w.T
        return logits[rows, target], grad


def prototype_network(prototypes: DataFrame, vector: str = "vector", key: str = "class") -> Network:
    """Linear classifier whose argmax is the nearest prototype: logit 2cx - |c|^2 per class.

    Collects one row per class.
    """
    rows = prototypes.orderBy(key).collect()
    centers = np.array([r[vector] for r in rows], dtype=np.float64)
    return Network(
        tuple(r[key] for r in rows), (2.0 * centers.T,), (-(centers**2).sum(axis=1),)
    )


def _matrix(pdf: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return pdf[list(features)].to_numpy(dtype=np.float64)


def score(rows: DataFrame, network: Network, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Logits per kept row; probabilities, class, confidence and margin follow in the JVM."""
    source = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = T.StructType([*kept, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logits, _ = network.forward(_matrix(pdf, features))
            yield pdf[[f.name for f in kept]].assign(logits=list(logits))

    classes = F.array(*[F.lit(c) for c in network.classes])
    scored = source.mapInPandas(run, schema).withColumn("probabilities", V.softmax("logits"))
    index = V.argmax("probabilities")
    return scored.withColumn("predicted_index", index).withColumns(
        {
            "predicted": F.get(classes, F.col("predicted_index")),
            "confidence": F.array_max("probabilities"),
            "probability_margin": V.top_margin("probabilities"),
        }
    )


def gradient_times_input(
    rows: DataFrame, network: Network, features: Sequence[str], minimum_rows: int = 10
) -> DataFrame:
    """Mean signed and absolute attribution per feature, overall and per predicted class.

    Every batch hands on one partial sum per class; no row's gradient leaves a task. Groups below
    ``minimum_rows`` keep their count but no values.
    """
    names = [str(c) for c in network.classes]
    schema = "class string, n bigint, signed array<double>, absolute array<double>"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf, features)
            if not len(x):
                continue
            logits, _ = network.forward(x)
            target = logits.argmax(axis=1)
            _, grad = network.input_gradient(x, target)
            share = grad * x
            out = [("all", len(x), share.sum(axis=0), np.abs(share).sum(axis=0))]
            for i in np.unique(target):
                mine = share[target == i]
                out.append((names[i], len(mine), mine.sum(axis=0), np.abs(mine).sum(axis=0)))
            yield pd.DataFrame(out, columns=["class", "n", "signed", "absolute"])

    partial = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, schema)
    sums = partial.groupBy("class").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("signed")[i]).alias(f"s{i}") for i in range(len(features))],
        *[F.sum(F.col("absolute")[i]).alias(f"a{i}") for i in range(len(features))],
    )
    listed = F.array(*[F.lit(n) for n in ["all", *names]])
    dense = rows.sparkSession.range(1).select(F.explode(listed).alias("class"))
    joined = dense.join(sums, "class", "left").fillna(0, ["n"])
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                (F.col(f"s{i}") / F.col("n")).alias("mean_signed"),
                (F.col(f"a{i}") / F.col("n")).alias("mean_absolute"),
            )
            for i, name in enumerate(features)
        ]
    )
    empty = F.array(
        F.struct(
            F.lit(None).cast("string").alias("feature"),
            F.lit(None).cast("double").alias("mean_signed"),
            F.lit(None).cast("double").alias("mean_absolute"),
        )
    )
    enough = (F.col("n") >= minimum_rows) | (F.col("class") == "all")
    long = joined.select(
        "class",
        F.col("n").alias("row_count"),
        F.when(enough, "reported").otherwise("suppressed_below_minimum_group_size").alias("status"),
        F.inline(F.when(enough, cells).otherwise(empty)),
    )
    order = Window.partitionBy("class").orderBy(F.desc("mean_absolute"), "feature")
    return long.withColumn("absolute_rank", F.row_number().over(order))


def path_segments(network: Network, start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions in [0, 1], ascending per row, between which the network is linear on the way from ``start`` to ``x``.

    The inputs of a layer are linear between the positions found for the layers before it, so each of its
    units changes sign at most once there. Rows with fewer positions repeat the last one.
    """
    t = np.tile([0.0, 1.0], (len(x), 1))
    for depth in range(1, len(network.weights)):
        front = Network((), network.weights[:depth], network.biases[:depth])
        ends = front.forward(start + t[:, :, None] * (x - start)[:, None, :])[0]
        before, after = ends[:, :-1], ends[:, 1:]
        crossed = (before < 0) & (after > 0) | (before > 0) & (after < 0)
        share = np.divide(before, before - after, out=np.ones_like(before), where=crossed)
        low, high = t[:, :-1, None], t[:, 1:, None]
        found = np.where(crossed, low + share * (high - low), 1.0).reshape(len(x), before[0].size if len(x) else 0)
        t = np.sort(np.concatenate([t, found], axis=1), axis=1)
        t = t[:, : (t < 1).sum(axis=1).max(initial=0) + 1]
    return t


def integrated_gradients(
    rows: DataFrame,
    network: Network,
    features: Sequence[str],
    baseline: Sequence[float],
    keep: Sequence[str],
    *,
    initial_steps: int = 256,
    maximum_steps: int = 4096,
    tolerance: float = 1e-3,
    slice_rows: int = 128,
    exact: bool = False,
) -> DataFrame:
    """Path-integrated attribution of the predicted logit for every row, with its completeness error.

    With ``exact`` the gradient, which is constant between the points where a rectifier switches, is summed
    over those stretches; ``steps`` then tells how many stretches the row's slice was cut into.

    The step count doubles for the rows that miss the tolerance, up to the maximum; ``complete`` tells
    which rows reached it. Work goes in slices of rows, one path position at a time, so memory stays at
    a few matrices of slice size.
    """
    start = np.asarray(baseline, dtype=np.float64)
    source = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = T.StructType(
        [
            *kept,
            T.StructField("target_index", T.IntegerType()),
            T.StructField("attributions", T.ArrayType(T.DoubleType())),
            T.StructField("steps", T.IntegerType()),
            T.StructField("logit_delta", T.DoubleType()),
            T.StructField("attribution_sum", T.DoubleType()),
            T.StructField("completeness_error", T.DoubleType()),
        ]
    )

    def integrate(x: np.ndarray, target: np.ndarray, steps: int) -> np.ndarray:
        total = np.zeros_like(x)
        for k in range(steps + 1):
            _, grad = network.input_gradient(start + (k / steps) * (x - start), target)
            total += grad * (0.5 if k in (0, steps) else 1.0)
        return (x - start) * total / steps

    def explain(x: np.ndarray) -> tuple[np.ndarray, ...]:
        target = network.forward(x)[0].argmax(axis=1)
        place = np.arange(len(x))
        origin = network.forward(np.broadcast_to(start, x.shape))[0][place, target]
        delta = network.forward(x)[0][place, target] - origin
        if exact:
            t = path_segments(network, start, x)
            result = np.zeros_like(x)
            for low, high in zip(t.T[:-1], t.T[1:]):
                middle = start + ((low + high) / 2)[:, None] * (x - start)
                result += (x - start) * network.input_gradient(middle, target)[1] * (high - low)[:, None]
            return target, result, np.full(len(x), t.shape[1] - 1, dtype=np.int32), delta
        result, used = np.zeros_like(x), np.zeros(len(x), dtype=np.int32)
        open_rows, steps = place, initial_steps
        while len(open_rows):
            result[open_rows] = integrate(x[open_rows], target[open_rows], steps)
            used[open_rows] = steps
            error = np.abs(delta - result.sum(axis=1))
            open_rows = np.flatnonzero(error > tolerance)
            if steps >= maximum_steps:
                break
            steps = min(2 * steps, maximum_steps)
        return target, result, used, delta

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), slice_rows):
                pdf = whole.iloc[at : at + slice_rows]
                target, result, used, delta = explain(_matrix(pdf, features))
                total = result.sum(axis=1)
                yield pdf[[f.name for f in kept]].assign(
                    target_index=target.astype(np.int32),
                    attributions=list(result),
                    steps=used,
                    logit_delta=delta,
                    attribution_sum=total,
                    completeness_error=np.abs(delta - total),
                )

    explained = source.mapInPandas(run, schema)
    return explained.withColumn("complete", F.col("completeness_error") <= tolerance)


def ranked_attributions(features: Sequence[str], attributions: Column | str) -> Column:
    """Array of (absolute_rank, feature, attribution, direction), strongest first, ties by position.

    One row's features are ranked inside the row, so there is nothing to shuffle.
    """
    values = F.col(attributions) if isinstance(attributions, str) else attributions
    names = F.array(*[F.lit(f) for f in features])
    cells = F.transform(
        values,
        lambda a, i: F.struct((-F.abs(a)).alias("k"), i.alias("i"), a.alias("a")),
    )
    return F.transform(
        F.array_sort(cells),
        lambda c, r: F.struct(
            (r + 1).alias("absolute_rank"),
            F.get(names, c["i"]).alias("feature"),
            c["a"].alias("attribution"),
            S.direction(c["a"]).alias("direction"),
        ),
    )
