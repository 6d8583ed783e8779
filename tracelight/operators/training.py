"""Central classifiers on scaled feature rows, trained by Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators.moments import co_moments, components, projection
from tracelight.operators.scoring import Network

# Hidden widths of the central network.
HIDDEN = (128, 64, 32)


def _assembled(rows: DataFrame, features: Sequence[str], classes: Sequence, label: str) -> DataFrame:
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    marked = rows.withColumn("_index", index.cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(marked)


def fit_logistic(
    train: DataFrame,
    features: Sequence[str],
    classes: Sequence,
    *,
    label: str = "label",
    weight: str | None = None,
    iterations: int = 50,
    penalty: float = 1e-4,
) -> Network:
    """Class-weighted multinomial logistic regression as a one-layer network."""
    options = {"weightCol": weight} if weight else {}
    model = LogisticRegression(
        featuresCol="_features",
        labelCol="_index",
        maxIter=iterations,
        regParam=penalty,
        family="multinomial",
        **options,
    ).fit(_assembled(train, features, classes, label))
    return Network(
        tuple(classes),
        (model.coefficientMatrix.toArray().T,),
        (model.interceptVector.toArray(),),
    )


def score_perceptron(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    classes: Sequence,
    *,
    label: str = "label",
    hidden: Sequence[int] = HIDDEN,
    iterations: int = 60,
    seed: int = 42,
) -> DataFrame:
    """Rows with ``predicted`` and ``probabilities`` of Spark's multilayer perceptron.

    Its hidden units are sigmoid and it takes no row weights; :func:`fit_network` has neither limit.
    """
    layers = [len(features), *hidden, len(classes)]
    model = MultilayerPerceptronClassifier(
        featuresCol="_features", labelCol="_index", layers=layers, maxIter=iterations, seed=seed
    ).fit(_assembled(train, features, classes, label))
    scored = model.transform(_assembled(rows, features, classes, label))
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).withColumn(
        "probabilities", vector_to_array("probability")
    ).select(*rows.columns, "predicted", "probabilities")


def _start(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        bound = np.sqrt(6.0 / (a + b))
        parts.extend([rng.uniform(-bound, bound, (a, b)), np.zeros(b)])
    return parts


def _gradients(network: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Weighted loss sum and its gradients for one batch."""
    inputs, z = [x], x
    for i, (m, b) in enumerate(zip(network.weights, network.biases, strict=True)):
        z = z @ m + b
        if i < len(network.weights) - 1:
            z = np.maximum(z, 0.0)
            inputs.append(z)
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(x))
    loss = float((-np.log(np.maximum(p[rows, y], 1e-300)) * w).sum())
    p[rows, y] -= 1.0
    delta = p * w[:, None]
    out: list[np.ndarray] = []
    for i in range(len(network.weights) - 1, -1, -1):
        out = [inputs[i].T @ delta, delta.sum(axis=0), *out]
        if i:
            delta = (delta @ network.weights[i].T) * (inputs[i] > 0)
    return loss, out


def fit_network(
    train: DataFrame,
    features: Sequence[str],
    classes: Sequence,
    *,
    label: str = "label",
    weight: str | None = None,
    hidden: Sequence[int] = HIDDEN,
    steps: int = 40,
    learning_rate: float = 0.01,
    seed: int = 42,
) -> tuple[Network, list[float]]:
    """Rectifier network by synchronous gradient steps (Adam), with the loss before each step.

    A step is one Spark job over the training rows: tasks sum the gradients of their batches, Spark
    adds the partial sums up per block of parameters, and only the summed gradient, which is as large as
    the model, comes back. ``train`` should be a stored or cached table, for it is read every step.
    """
    sizes = [len(features), *hidden, len(classes)]
    values = _start(sizes, seed)
    shapes = [v.shape for v in values]
    lengths = [v.size for v in values]
    names = list(features)
    rows = train.select(
        *[F.col(c).cast("double").alias(c) for c in names],
        S.one_of(label, classes).alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    )
    m = [np.zeros(s) for s in shapes]
    v = [np.zeros(s) for s in shapes]
    losses: list[float] = []
    block = 4096

    def as_network(parts: list[np.ndarray]) -> Network:
        return Network(tuple(classes), tuple(parts[0::2]), tuple(parts[1::2]))

    for step in range(1, steps + 1):
        current = as_network(values)

        def run(batches: Iterable[pd.DataFrame], net: Network = current) -> Iterator[pd.DataFrame]:
            total, loss, mass = None, 0.0, 0.0
            for pdf in batches:
                if pdf.empty:
                    continue
                w = pdf["_w"].to_numpy(dtype=np.float64)
                part, grads = _gradients(net, pdf[names].to_numpy(dtype=np.float64), pdf["_y"].to_numpy(), w)
                flat = np.concatenate([g.ravel() for g in grads])
                total = flat if total is None else total + flat
                loss, mass = loss + part, mass + float(w.sum())
            if total is not None:
                full = np.concatenate([[loss, mass], total])
                cuts = [full[i : i + block] for i in range(0, len(full), block)]
                yield pd.DataFrame({"part": range(len(cuts)), "sums": cuts})

        partial = rows.mapInPandas(run, "part int, sums array<double>")
        summed = (
            partial.select("part", F.posexplode("sums").alias("pos", "x"))
            .groupBy("part", "pos").agg(F.sum("x").alias("x"))
            .orderBy("part", "pos").select("x").toPandas()["x"].to_numpy()
        )
        if len(summed) < 2 or summed[1] <= 0:
            raise ValueError("training needs at least one weighted row")
        losses.append(float(summed[0] / summed[1]))
        grads = np.split(summed[2:] / summed[1], np.cumsum(lengths)[:-1])
        for i, g in enumerate(grads):
            g = g.reshape(shapes[i])
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            step_size = (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            values[i] = values[i] - learning_rate * step_size
    return as_network(values), losses


def pair_projection(
    rows: DataFrame, features: Sequence[str], pair: Sequence, label: str = "actual"
) -> tuple[DataFrame, list[float]]:
    """Two-component projection of the rows of a confused class pair, and the explained variance.

    The largest loading of a component is positive. Rows with a null feature have null scores.
    """
    chosen = rows.where(F.col(label).isin(*pair))
    found = co_moments(chosen, features)
    values, vectors = components(found, 2)
    scores = [projection(features, found, v).alias(f"component_{k}") for k, v in enumerate(vectors, 1)]
    total = float(np.trace(found.covariance))
    return chosen.select("*", *scores), [float(v) / total if total else 0.0 for v in values]
