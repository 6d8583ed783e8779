"""Robust aggregation of client update vectors and anomaly indicators.

Updates are rows (client_id, vector). Statistics per coordinate run on the long layout. Up to ``SMALL_GROUP`` clients
(counted, or declared and checked) the values of a coordinate meet in a task; beyond that histograms of all
coordinates narrow the wanted ranks, so that they never do. Both ways give the same values.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import vectors as V
from tracelight.operators.ranking import medians, same_keys, slot_ranked, smallest, trimmed_means
from tracelight.session import stored

#: Values of one coordinate that may meet in one task. Larger groups are selected from by histograms.
SMALL_GROUP = 65_536

STRATEGIES = ("fedavg", "coordinate_median", "trimmed_mean", "multikrum", "bulyan")


class BoundError(ValueError):
    """Too few clients for the number of faulty ones an aggregator must survive."""


def check_bound(strategy: str, clients: int, f: int, keep: int | None = None) -> None:
    """Stops before any job when ``clients`` cannot tolerate ``f`` faulty ones."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown aggregation strategy: {strategy}")
    if f < 0 or f >= clients:
        raise BoundError("f must be at least zero and below the client count")
    needed = {"trimmed_mean": 2 * f + 1, "multikrum": 2 * f + 3, "bulyan": 4 * f + 3}
    if clients < needed.get(strategy, 1):
        raise BoundError(f"{strategy} needs {needed[strategy]} clients for f={f}, got {clients}")
    if strategy == "multikrum" and keep is not None and not 1 <= keep <= clients - f - 2:
        raise BoundError(f"multikrum keeps between 1 and {clients - f - 2} clients")


def grouped_medians(df: DataFrame, keys: list[str], value: str, name: str, most: int, small_group: int) -> DataFrame:
    """Exact medians per key of at most ``most`` values."""
    if most <= small_group:
        return df.groupBy(*keys).agg(F.median(value).alias(name))
    return medians(df, keys, value, name)


def expect_clients(updates: DataFrame, clients: int) -> DataFrame:
    """The updates; a different number of client rows stops the job."""
    seen = updates.agg(F.count(F.lit(1))).scalar()
    wrong = F.raise_error(F.concat(F.lit(f"expected {clients} clients, got "), seen.cast("string")))
    return updates.where(F.when(seen == clients, F.lit(True)).otherwise(wrong.cast("boolean")))


def clip_threshold(updates: DataFrame, vector: str, small_group: int = SMALL_GROUP) -> DataFrame:
    """One row: median norm, its MAD and the limit median + 3 MAD (the largest norm if that is zero)."""
    clients = updates.count()
    norms = updates.select(V.l2_norm(vector).alias("_norm"))
    median = stored(grouped_medians(norms, [], "_norm", "m", clients, small_group), "median-norm").scalar()
    off = norms.select(F.abs(F.col("_norm") - median).alias("_off"))
    spread = stored(grouped_medians(off, [], "_off", "m", clients, small_group), "norm-spread").scalar()
    found = norms.agg(F.max("_norm").alias("_top")).select(median.alias("median_l2"), spread.alias("mad_l2"), "_top")
    limit = F.col("median_l2") + 3 * F.col("mad_l2")
    fallback = F.greatest(F.col("_top"), F.lit(1e-12))
    return found.withColumn("max_norm", F.when(limit > 0, limit).otherwise(fallback)).select("median_l2", "mad_l2", "max_norm")


def clip_updates(updates: DataFrame, vector: str, limit: Column) -> DataFrame:
    """Updates with vectors scaled to at most ``limit`` and the factor used."""
    marked = updates.withColumn("_norm", V.l2_norm(vector)).withColumn("_limit", limit)
    factor = V.clip_factor("_norm", F.col("_limit"))
    scaled = marked.withColumn("clip_scale", factor)
    return scaled.withColumn(vector, V.scale(vector, F.col("clip_scale"))).drop("_norm", "_limit")


def _block_distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """Squared distances of two tiles of clients over one block of coordinates, a row per client and side."""
    first, second = pdf["_tile_a"].iloc[0], pdf["_tile_b"].iloc[0]
    pdf = pdf.sort_values("client_id")
    left, right = pdf[pdf["_tile"] == first], pdf[pdf["_tile"] == second]
    a = np.stack(left["_part"].to_numpy()).astype(np.float64) if len(left) else np.zeros((0, 1))
    b = np.stack(right["_part"].to_numpy()).astype(np.float64) if len(right) else np.zeros((0, 1))
    gaps = np.zeros((len(a), len(b)))
    for i, row in enumerate(a if len(b) else ()):
        gaps[i] = ((b - row) ** 2).sum(axis=1)
    sides = [(left["client_id"], second, gaps)]
    if first != second:
        sides.append((right["client_id"], first, gaps.T))
    out = [(name, int(other), row) for names, other, matrix in sides for name, row in zip(names, matrix) if len(row)]
    return pd.DataFrame(out, columns=["client_id", "_other", "_gaps"])


def krum_scores(
    updates: DataFrame,
    vector: str,
    *,
    f: int,
    clients: int,
    tile_rows: int = 256,
    block_width: int = 8192,
    least_blocks: int = 8,
) -> DataFrame:
    """Per client, the sum of its n-f-2 smallest squared distances to the others.

    Work is blocked three ways: two tiles of clients and one block of coordinates make a task's group, so no task
    holds a whole vector, and few clients with wide vectors use as many tasks as there are blocks. The partial
    distances of a client to a tile are added over the blocks; then the client keeps, per tile, a sum and its
    f+1 largest distances, and the score is everything but the f+1 largest of all. No pair of clients becomes a row.
    """
    check_bound("multikrum", clients, f)
    tiles = max(1, math.ceil(clients / tile_rows))
    width = updates.agg(F.max(F.size(vector))).first()[0] or 1
    block = max(1, min(block_width, math.ceil(width / least_blocks)))
    blocks = max(1, math.ceil(width / block))
    whole = F.when(F.size(vector) == width, F.col(vector)).otherwise(
        F.raise_error(F.lit(f"an update is not {width} wide")).cast("array<double>")
    )
    tile = F.pmod(F.xxhash64("client_id"), F.lit(tiles)).cast("int")
    rows = expect_clients(updates, clients).select(
        F.col("client_id").cast("string").alias("client_id"), whole.alias("_vector"), tile.alias("_tile")
    )
    parts = rows.select(
        "client_id", "_tile", "_vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    ).select("client_id", "_tile", "_block", F.slice("_vector", F.col("_block") * block + 1, block).alias("_part"))
    spread = parts.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "client_id", "_tile", "_block", "_part",
        F.least("_tile", "_with").alias("_tile_a"), F.greatest("_tile", "_with").alias("_tile_b"),
    )
    partial = spread.groupBy("_tile_a", "_tile_b", "_block").applyInPandas(
        _block_distances, "client_id string, _other int, _gaps array<double>"
    )
    # The members of a tile stand in one order in every block, so distances are added place by place.
    gaps = V.coordinates(partial, ["client_id", "_other"], "_gaps").groupBy("client_id", "_other", "pos").agg(
        F.sum("value").alias("_gap")
    )
    # A client is at distance zero from itself: one zero too many, which adds nothing to a sum of the smallest.
    per_tile = gaps.groupBy("client_id", "_other").agg(F.array_sort(F.collect_list("_gap")).alias("_all"))
    cut = F.greatest(F.size("_all") - (f + 1), F.lit(0))
    joined = per_tile.select(
        "client_id",
        F.aggregate(F.slice("_all", F.lit(1), cut), F.lit(0.0), lambda s, x: s + x).alias("_rest"),
        F.slice("_all", cut + 1, F.lit(f + 1)).alias("_far"),
    ).groupBy("client_id").agg(F.sum("_rest").alias("_rest"), F.flatten(F.collect_list("_far")).alias("_far"))
    near = F.slice(F.array_sort("_far"), F.lit(1), F.size("_far") - (f + 1))
    return joined.select(
        "client_id",
        (F.col("_rest") + F.aggregate(near, F.lit(0.0), lambda s, x: s + x)).alias("krum_score"),
    )


def krum_selected(scores: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` clients with the lowest scores, by client id on ties."""
    return scores.orderBy("krum_score", "client_id").limit(keep)


def aggregate_updates(
    updates: DataFrame,
    vector: str,
    strategy: str,
    *,
    clients: int,
    f: int = 0,
    weight: str | None = None,
    keep: int | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Aggregate in the long layout (pos, value) by one of the five strategies."""
    check_bound(strategy, clients, f, keep)
    if strategy == "fedavg":
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        bad = F.raise_error(F.lit("weights must be positive and finite")).cast("double")
        checked = F.when((w > 0) & (w < float("inf")), w).otherwise(bad)
        long = updates.select(checked.alias("_w"), F.posexplode(vector).alias("pos", "value"))
        return long.groupBy("pos").agg(
            (F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value")
        )
    if strategy == "coordinate_median":
        long = V.coordinates(expect_clients(updates, clients), [], vector)
        return grouped_medians(long, ["pos"], "value", "value", clients, small_group)
    if strategy == "trimmed_mean":
        long = V.coordinates(expect_clients(updates, clients), [], vector)
        if clients > small_group:
            return trimmed_means(long, ["pos"], "value", clients, f, "value")
        place = F.row_number().over(Window.partitionBy("pos").orderBy("value"))
        kept = long.withColumn("_place", place).where((F.col("_place") > f) & (F.col("_place") <= clients - f))
        return kept.groupBy("pos").agg(F.avg("value").alias("value"))
    scores = krum_scores(updates, vector, f=f, clients=clients)
    if strategy == "multikrum":
        chosen = krum_selected(scores, keep or clients - f - 2)
        long = V.coordinates(updates.join(chosen, "client_id"), [], vector)
        return long.groupBy("pos").agg(F.avg("value").alias("value"))
    # One Krum ranking keeps n-2f clients; the mean of the values nearest the median follows.
    candidates = clients - 2 * f
    if clients <= small_group:
        chosen = updates.join(krum_selected(scores, candidates), "client_id")
        long = V.coordinates(chosen, ["client_id", "krum_score"], vector)
        by_pos = Window.partitionBy("pos")
        off = long.withColumn("_off", F.abs(F.col("value") - F.median("value").over(by_pos)))
        nearest = F.row_number().over(by_pos.orderBy("_off", "krum_score", "client_id"))
        kept = off.withColumn("_place", nearest).where(F.col("_place") <= candidates - 2 * f)
        return kept.groupBy("pos").agg(F.avg("value").alias("value"))
    slot = F.floor(F.log1p("krum_score") * 64).cast("bigint")
    ranked = slot_ranked(scores, groups=[], slot=slot, order=["krum_score", "client_id"], rank="_place")
    chosen = updates.join(stored(ranked.where(F.col("_place") <= candidates), "krum-places"), "client_id")
    long = V.coordinates(chosen, ["_place"], vector)
    middle = stored(medians(long, ["pos"], "value", "_median"), "bulyan-medians")
    off = long.join(middle, "pos").withColumn("_off", F.abs(F.col("value") - F.col("_median")))
    kept = smallest(off, ["pos"], "_off", "_place", candidates - 2 * f)
    return kept.groupBy("pos").agg(F.avg("value").alias("value"))


def as_vector(long: DataFrame, name: str = "vector") -> DataFrame:
    """Single row with the aggregate as an array."""
    return V.gather(long, [], "value", name)


def deviation_scores(
    rows: DataFrame, keys: list[str], member: str, vector: str, groups: list[str], small_group: int = SMALL_GROUP
) -> DataFrame:
    """Distance, cosine and median absolute deviation score of each member vector of its group."""
    lane, who = [*groups, "pos"], [*groups, member, *keys]
    long = V.coordinates(rows, who, vector)
    most = rows.agg(F.greatest(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0)))).first()[0]
    if most <= small_group:
        over = Window.partitionBy(*lane)
        off = long.withColumn("_median", F.median("value").over(over))
        off = off.withColumn("_off", F.abs(F.col("value") - F.col("_median")))
        off = off.withColumn("_mad", F.median("_off").over(over))
        return _deviations(off, who, F.median(F.col("_off") / F.greatest(F.col("_mad"), F.lit(1e-12))))
    middle = stored(medians(long, lane, "value", "_median"), "deviation-medians")
    off = same_keys(long, middle, lane).withColumn("_off", F.abs(F.col("value") - F.col("_median")))
    spread = stored(medians(off, lane, "_off", "_mad"), "deviation-spreads")
    standard = F.col("_off") / F.greatest(F.col("_mad"), F.lit(1e-12))
    scored = same_keys(off, spread, lane).withColumn("_standard", standard)
    middles = medians(scored.select(*who, "_standard"), who, "_standard", "mad_score")
    return stored(same_keys(_deviations(off, who), middles, who), "deviation-scores")


def _deviations(off: DataFrame, who: list[str], score: Column | None = None) -> DataFrame:
    product = F.sum(F.col("value") * F.col("_median"))
    median_norm = F.sqrt(F.sum(F.col("_median") * F.col("_median")))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")))
    return off.groupBy(*who).agg(
        norm.alias("l2"),
        F.when(norm * median_norm == 0, F.lit(0.0)).otherwise(product / (norm * median_norm)).alias("cosine_to_median"),
        F.sqrt(F.sum(F.col("_off") * F.col("_off"))).alias("median_distance"),
        *([score.alias("mad_score")] if score is not None else []),
    )


def update_indicators(updates: DataFrame, vector: str, small_group: int = SMALL_GROUP) -> DataFrame:
    """Server-visible anomaly indicators of every client update."""
    scores = deviation_scores(updates, [], "client_id", vector, [], small_group)
    middle = grouped_medians(scores, [], "l2", "m", updates.count(), small_group).scalar()
    marked = scores.withColumn("_middle", middle)
    relative = F.when(F.col("_middle") > 0, F.col("l2") / F.col("_middle")).otherwise(F.lit(0.0))
    return marked.select(
        "client_id",
        F.col("l2").alias("delta_l2"),
        relative.alias("relative_norm"),
        "cosine_to_median",
        F.col("median_distance").alias("coordinate_median_distance"),
        "mad_score",
    )


def duplicate_updates(updates: DataFrame, vector: str) -> DataFrame:
    """Each client with the digest of its update and how many clients sent the very same one.

    Peers are not listed per client, which would square the size of a large group: clients with the
    same digest are the peers. Adding zero makes the two zeros one.
    """
    text = F.transform(F.col(vector), lambda x: (x + F.lit(0.0)).cast("string"))
    marked = updates.select("client_id", F.sha2(F.array_join(text, ","), 256).alias("update_sha256"))
    sizes = marked.groupBy("update_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    return marked.join(sizes, "update_sha256")


def duplicate_summary(duplicates: DataFrame) -> DataFrame:
    groups = duplicates.groupBy("update_sha256").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.count(F.lit(1)).alias("unique_update_count"),
        F.count_if(F.col("_n") > 1).alias("exact_duplicate_group_count"),
        F.coalesce(F.max(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("largest_group_size"),
    )
