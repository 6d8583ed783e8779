"""Whitening of embeddings on a covariance of distinct vectors with multiplicities.

Vectors are rounded down to multiples of 1/256, so that equal ones are exactly equal. Equal vectors become one row
with their count; sums and the centred product of the fit are taken over these rows, weighted by one or by
the count. Every distinct vector is whitened once, and the rows of the table get their values by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import stored

SCALE = 256
#: Vectors that make up more than one in so many rows are joined by broadcast: there are fewer than this.
FREQUENT = 512
BLOCK = 1 << 20
LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """Fit for vectors of one length: weight, sums, eigenvalues (falling), eigenvectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded quotients of integers


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows whose vector and entries are all there and finite; x = floor(scale * entry)."""
    entry = F.col(vec_col)
    usable = entry.isNotNull() & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    )
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(usable).select(F.col(id_col).alias("id"), x.alias("x"))


def blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of vectors of one length; a matrix has about ``BLOCK`` entries at most."""
    flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(edges)
    for dim in np.unique(lengths):
        rows, step = np.flatnonzero(lengths == dim), max(1, BLOCK // max(1, int(dim)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, flat[edges[part][:, None] + np.arange(dim)]


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted sums of whole-number columns, without overflow."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * int(weight.sum())
    if most >= LONG:
        x, weight = x.astype(object), weight.astype(object)
    return [int(s) for s in weight @ x] if x.shape[1] else []


def totals(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per vector length: weight and exact sums. One row per task and coordinate is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for at, x in blocks(batch.column(0)):
                mine = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                mine[0] += int(weights[at].sum())
                mine[1] = [a + b for a, b in zip(mine[1], exact_sums(x, weights[at]))]
        for dim, (n, sums) in found.items():
            columns = [[dim] * dim, range(dim), [Decimal(n)] * dim, [Decimal(s) for s in sums]]
            kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "pos", "n", "s"])

    parts = distinct.select("x", "weight").mapInArrow(run, "dim int, pos int, n decimal(38,0), s decimal(38,0)")
    rows = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(rows, key=lambda r: (r["dim"], r["pos"])):
        out.setdefault(row["dim"], (int(row["n"]), []))[1].append(int(row["s"]))
    return out


def covariances(distinct: DataFrame, column: str, means: dict[int, np.ndarray], tasks: int) -> dict[int, np.ndarray]:
    """Per vector length: weighted products of the centred vectors, divided by the weight.

    Each task adds up its product matrix, then the rows of the matrices meet and are added one at a time.
    Only the finished matrices reach the driver; their size is that of a vector squared.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        weight: dict[int, float] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for at, x in blocks(batch.column(0)):
                dim = x.shape[1]
                centred = x.astype(np.float64) - means.get(dim, np.zeros(dim))
                product = (centred * weights[at][:, None]).T @ centred
                found[dim] = found[dim] + product if dim in found else product
                weight[dim] = weight.get(dim, 0.0) + float(weights[at].sum())
        for dim, matrix in found.items():
            step = max(1, BLOCK // max(1, dim))
            for at in range(0, dim, step):
                some = matrix[at : at + step]
                columns = [[dim] * len(some), range(at, at + len(some)), [weight[dim]] * len(some), list(some)]
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "pos", "n", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = None, 0.0, None

        def out() -> pa.RecordBatch:
            cells = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([n]), pa.array([total])]
            return pa.RecordBatch.from_arrays(cells, ["dim", "pos", "n", "row"])

        for batch in batches:
            for i in range(len(batch)):
                mine, row = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(3)[i].values.to_numpy()
                if mine != key:
                    if key:
                        yield out()
                    key, n, total = mine, 0.0, np.zeros(len(row))
                n, total = n + batch.column(2)[i].as_py(), total + row
        if key:
            yield out()

    schema = "dim int, pos int, n double, row array<double>"
    parts = distinct.select(column, "weight").mapInArrow(products, schema)
    dealt = parts.repartition(tasks, "dim", "pos").sortWithinPartitions("dim", "pos")
    rows: dict[int, dict[int, np.ndarray]] = {}
    for row in dealt.mapInArrow(added, schema).collect():
        rows.setdefault(row["dim"], {})[row["pos"]] = np.array(row["row"]) / row["n"]
    found = {dim: np.stack([of[i] for i in range(dim)]) for dim, of in rows.items()}
    return {dim: (matrix + matrix.T) / 2 for dim, matrix in found.items()}


def fit(distinct: DataFrame, components: int, tasks: int) -> dict[int, Whitening]:
    """One fit per vector length, over a stored table of distinct vectors ``x`` with their ``weight``."""
    sums = totals(distinct)
    means = {dim: np.array([s / n for s in of]) for dim, (n, of) in sums.items()}
    models = {}
    for dim, matrix in covariances(distinct, "x", means, tasks).items():
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        models[dim] = Whitening(*sums[dim], values, vectors * np.sign(lead), float(np.trace(matrix)))
    return models


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sums over the dimensions of (n*x - S)^2, exact; null where a long cannot hold it."""
    most = model.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, model.sums))
    if most * most * x.shape[1] < LONG:
        return ((model.n * x - np.array(model.sums)) ** 2).sum(axis=1).tolist()
    away = model.n * x.astype(object) - np.array(model.sums, object)
    return [d if d < LONG else None for d in (away * away).sum(axis=1)]


def projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates; a component without variance has the value 0 everywhere."""
    live = model.values > model.trace * 1e-12
    scale = np.where(live, 1 / np.sqrt(np.where(live, model.values, 1.0)), 0.0)
    return ((x.astype(np.float64) - model.mean) @ model.vectors) * scale


def apply(distinct: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """(x, copies, weight, deviation, y) of every distinct vector; empty vectors have no components and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in blocks(batch.column(0)):
                if not x.shape[1]:
                    continue
                own, model = batch.take(pa.array(at)), models[x.shape[1]]
                more = [pa.array(deviations(model, x), pa.int64()), pa.array(list(projected(model, x)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(own.columns + more, ["x", "copies", "weight", "deviation", "y"])

    schema = "x array<long>, copies long, weight long, deviation long, y array<double>"
    return distinct.select("x", "copies", "weight").mapInArrow(run, schema)


def identity_errors(table: DataFrame, models: dict[int, Whitening], tasks: int) -> float:
    """Largest absolute entry of the whitened covariance minus the identity; components without variance are left out."""
    known = table.withColumn("dim", F.size("x"))
    spots = known.select("dim", "weight", F.posexplode("y").alias("pos", "v")).groupBy("dim", "pos")
    means: dict[int, dict[int, float]] = {}
    for row in spots.agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("mean")).collect():
        means.setdefault(row["dim"], {})[row["pos"]] = row["mean"]
    worst = 0.0
    for dim, of in means.items():
        centre = {len(of): np.array([of[i] for i in range(len(of))])}
        found = covariances(known.where(F.col("dim") == dim), "y", centre, tasks)[len(of)]
        live = models[dim].values > models[dim].trace * 1e-12
        worst = max(worst, float(np.abs(found - np.eye(len(of)))[np.ix_(live, live)].max(initial=0.0)))
    return worst


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    components: int = 4,
    weights: str = "one",
    scale: int = SCALE,
) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    ``weights`` is ``one`` (every distinct vector counts once in the fit) or ``count`` (as often as it occurs).
    Vectors that are null or hold null or non-finite entries take no part. Vectors of different lengths are fitted
    apart. A component without variance, as of a single distinct vector, has ``whitened`` 0 and takes no part in
    ``identity_error``; ``explained`` is 0 if nothing varies. Entries beyond the range of a long are held at its
    ends, deviations beyond it are null. Rows with null or repeated ids are kept as they are, ties of eigenvalues
    are in the order of the solver. Other columns are not read. An empty table gives no rows.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be 'one' or 'count', not {weights!r}")
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = quantised(vectors, id_col, vec_col, scale)
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.col("copies") if weights == "count" else F.lit(1).cast("long")
    distinct = stored(counted.withColumn("weight", weight), "whitening-distinct")
    models = fit(distinct, components, tasks)
    table = stored(apply(distinct, models), "whitening-values")
    error = identity_errors(table, models, tasks)
    parts = [
        (dim, i + 1, m.n, float(max(v, 0.0) / m.trace) if m.trace > 0 else 0.0, error)
        for dim, m in models.items()
        for i, v in enumerate(m.values)
    ]
    shares = spark.createDataFrame(parts, "dim int, component int, n long, explained double, identity_error double")
    joined = joined_back(rows, table.drop("weight"))
    each = joined.select("id", "deviation", F.size("x").alias("dim"), F.posexplode("y").alias("pos", "whitened"))
    each = each.withColumn("component", F.col("pos") + 1)
    return each.join(F.broadcast(shares), ["dim", "component"]).select(
        F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


def joined_back(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the values of their distinct vector.

    A vector that fills more than one ``FREQUENT``-th of the rows is joined by broadcast, so the shuffled join of the
    others has no large group.
    """
    total = table.agg(F.sum("copies")).first()[0] or 0
    often = F.broadcast(table.where(F.col("copies") * FREQUENT > total))
    rest = rows.join(often.select("x"), "x", "left_anti").join(table.where(F.col("copies") * FREQUENT <= total), "x")
    return rows.join(often, "x").unionByName(rest)
