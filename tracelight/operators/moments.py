"""Centred co-moments and principal components of many columns.

Moments are states that merge: a task adds up its rows in matrix products and passes on one state, and states
are merged in groups before the last few meet on the driver, each as large as the feature list squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "slot int, row_count long, means array<double>, products array<double>"
SLOTS = 256  # so many states reach the driver at most


@dataclass(frozen=True)
class Moments:
    """Number of rows, means, and sums of the products of centred values."""

    count: int
    means: np.ndarray
    products: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """Population covariances."""
        return self.products / self.count

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        means = x.mean(axis=0)
        return Moments(len(x), means, (x - means).T @ (x - means))

    def __add__(self, other: Moments) -> Moments:
        """The moments of both sets of rows; nothing large is subtracted from something large."""
        count = self.count + other.count
        apart = other.means - self.means
        between = np.outer(apart, apart) * (self.count * other.count / count)
        return Moments(count, self.means + apart * (other.count / count), self.products + other.products + between)


def _state(slot: int, m: Moments) -> pd.DataFrame:
    return pd.DataFrame(
        {"slot": [slot], "row_count": [m.count], "means": [m.means.tolist()], "products": [m.products.ravel().tolist()]}
    )


def _merged(states: pd.DataFrame) -> Moments:
    found = None
    for n, means, products in zip(states["row_count"], states["means"], states["products"]):
        own = Moments(int(n), np.asarray(means), np.asarray(products).reshape(len(means), -1))
        found = own if found is None else found + own
    return found


def co_moments(rows: DataFrame, features: Sequence[str]) -> Moments:
    """Moments of the rows that have all features; a table without such rows is refused."""
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
    slot = F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("_slot")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, place = None, 0
        for batch in batches:
            if len(batch):
                own, place = Moments.of(batch[list(features)].to_numpy()), int(batch["_slot"].iloc[0])
                found = own if found is None else found + own
        if found is not None:
            yield _state(place, found)

    def merge(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        return _state(int(key[0]), _merged(states))

    states = known.select("*", slot).mapInPandas(partial, STATE)
    found = _merged(states.groupBy("slot").applyInPandas(merge, STATE).toPandas().sort_values("slot"))
    if found is None:
        raise ValueError("moments need at least one row that has all features")
    return found


def components(moments: Moments, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues and their unit vectors as rows.

    The sign is fixed: the loading that is largest in size is positive, the first one of several.
    """
    values, vectors = np.linalg.eigh(moments.covariance)
    order = np.argsort(-values, kind="stable")[:count]
    chosen = vectors.T[order]
    largest = np.abs(chosen).round(9).argmax(axis=1)
    signs = np.where(chosen[np.arange(len(chosen)), largest] < 0, -1.0, 1.0)
    return np.maximum(values[order], 0.0), chosen * signs[:, None]


def projection(features: Sequence[str], moments: Moments, vector: np.ndarray) -> Column:
    """Score of a row on one component; null if a feature is null."""
    terms = [
        (F.col(c).cast("double") - float(m)) * float(w)
        for c, m, w in zip(features, moments.means, vector, strict=True)
    ]
    return sum(terms[1:], terms[0])
