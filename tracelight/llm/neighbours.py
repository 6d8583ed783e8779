"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector is centred, scaled to unit length and turned by a random rotation; its code keeps one sign
bit per turned coordinate, packed, next to three correction scalars: the length of the centred vector,
the inner product of its code with it, and its inner product with the centre. Codes estimate the cosine
with a query and bound the error. A vector is reranked with its original coordinates only if its upper
bound reaches the k-th best lower bound.

Queries are compared with all rows in blocks: packed blocks of rows meet packed tiles of queries, so a
task holds one of each, whatever the tables' size or skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import bounded_sample, stored

CODE_BITS = 256
ERROR_FACTOR = 3.0


def frame(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """Random orthonormal directions: ``dim`` rows in ``bits`` (at least ``dim``) dimensions."""
    width = max(bits, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, dim)))
    return (q * np.sign(np.diag(r))).T


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest entry first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def encode(units: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and, per row: length of the centred vector, code times it, centre times it."""
    rest = units - centre
    length = np.sqrt((rest**2).sum(axis=1))
    turned = (rest / np.maximum(length, 1e-12)[:, None]) @ turn
    agree = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([length, np.maximum(agree, 1e-6), rest @ centre], axis=1)


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Estimated cosines of unit queries (rows) with coded vectors (columns), and error bounds."""
    width = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
    rest = queries - centre
    far = np.sqrt((rest**2).sum(axis=1))
    length, agree, with_centre = scalars.T
    raw = ((rest @ turn).astype(np.float32) @ signs.T) / np.sqrt(width)
    cosine = raw * (length / agree) + with_centre + (queries @ centre)[:, None]
    spread = length * np.sqrt(np.maximum(0.0, 1 - agree**2)) / agree * ERROR_FACTOR / np.sqrt(width - 1)
    return cosine, far[:, None] * spread + 1e-6


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and no component null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each pair of equally numbered rows, in double precision; sums run in coordinate order."""
    dot, q, r = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    for a, b in zip(queries.T, rows.T):
        dot += a * b
        q += a * a
        r += b * b
    return dot / np.sqrt(q * r)


def block_search(queries: pd.DataFrame, rows: pd.DataFrame, k: int, centre: np.ndarray, turn: np.ndarray) -> pd.DataFrame:
    """The k best rows of one block for each query of one tile; equal scores go to the smaller id."""
    q, x = np.stack(queries["vector"].to_numpy()), np.stack(rows["vector"].to_numpy())
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(x), -1)
    scalars = rows[["length", "agree", "with_centre"]].to_numpy()
    q_ids, x_ids = queries["id"].to_numpy(), rows["id"].to_numpy()
    q_unit, found = unit(q), []
    for lo in range(0, len(q), 256):
        part = slice(lo, lo + 256)
        cosine, error = estimate(codes, scalars, q_unit[part], centre, turn)
        own = q_ids[part, None] == x_ids[None, :]
        floor = np.where(own, -np.inf, cosine - error)
        take = min(k, floor.shape[1])
        bar = np.partition(floor, floor.shape[1] - take, axis=1)[:, floor.shape[1] - take]
        i, j = np.nonzero((cosine + error >= bar[:, None]) & ~own)
        score = np.concatenate([cosines(q[lo + i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((x_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        found.append(pd.DataFrame({"query_id": q_ids[lo + i[best]], "vec_id": x_ids[j[best]], "score": score[best]}))
    return pd.concat(found)


def index(vectors: DataFrame, id_col: str, vector_col: str, k: int, sample_rows: int = 8192) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The coded table of all usable vectors, written to the shared folder, and the centre per dimension.

    Centres are means of at most ``sample_rows`` vectors (smallest hashes of the id). Rows that repeat id
    and vector are one row. Of equal vectors the k+1 smallest ids are kept: no query can return another of them.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    # Repeats would take places of other ids; they combine before the shuffle.
    own = stored(own.distinct(), "vector-rows")
    sample = bounded_sample(own, "id", sample_rows).toPandas()
    centres = {int(d): unit(np.stack(g["vector"].to_numpy())).mean(axis=0) for d, g in sample.groupby("dim")}
    order = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    first = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    shared = spark.sparkContext.broadcast(centres)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                centre = shared.value.get(dim, np.zeros(dim))
                bits, scalars = encode(unit(np.stack(some["vector"].to_numpy())), centre, frame(dim, CODE_BITS))
                yield some.assign(code=[b.tobytes() for b in bits], length=scalars[:, 0], agree=scalars[:, 1], with_centre=scalars[:, 2])

    schema = "id long, vector array<double>, dim int, code binary, length double, agree double, with_centre double"
    return stored(first.mapInPandas(code, schema), "vector-index"), centres


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    block_rows: int = 8192,
    tile_queries: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every query, by cosine.

    Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no
    part. Vectors of different dimensions are never compared. Ties go to the smaller id; rows that
    repeat both id and vector are one candidate; fewer than k candidates give fewer rows; empty
    tables an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    table, centres = index(vectors, id_col, vector_col, k)
    own = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct().withColumn("dim", F.size("vector"))
    own = stored(own, "vector-queries")
    blocks = max(1, -(-table.count() // block_rows))
    tiles = max(1, -(-own.count() // tile_queries))
    rows = table.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    asked = own.withColumn("tile", F.pmod(F.xxhash64("id", "vector"), F.lit(tiles)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shared, keys = spark.sparkContext.broadcast(centres), ["dim", "block", "tile"]

    def meet(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dim = int(key[0])
        return block_search(q, x, k, shared.value.get(dim, np.zeros(dim)), frame(dim, CODE_BITS))

    pairs = asked.groupBy(*keys).cogroup(rows.groupBy(*keys))
    best = pairs.applyInPandas(meet, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
