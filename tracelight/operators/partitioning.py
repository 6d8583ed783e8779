"""Client partitions: stratified round-robin, label-Dirichlet allocation and their verifier."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators.ranking import hash_ranked, same_keys

# Columns that must never reach a shared table.
FORBIDDEN_COLUMNS = ("source_records", "_source_records", "raw", "source_event_ids")


def client_name(index: Column) -> Column:
    return F.concat(F.lit("client"), F.lpad((index + 1).cast("string"), 2, "0"))


def round_robin(
    rows: DataFrame, *, clients: int, seed: int, label: str = "label", identity: str = "window_id"
) -> DataFrame:
    """Deals every label over the clients in hash order; the next label starts where the last stopped."""
    ranked = hash_ranked(
        rows, groups=[label], digest=S.seeded_digest(seed, identity), tie=identity
    )
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    dealt = same_keys(ranked, offsets, [label])
    index = F.pmod(F.col("_offset") + F.col("hash_rank") - 1, F.lit(clients)).cast("int")
    return dealt.withColumn("client_index", index).withColumn(
        "client_id", client_name(F.col("client_index"))
    ).drop("_offset", "hash_rank")


def dirichlet_quotas(
    label_counts: dict[str, int], *, clients: int, alpha: float, minimum: int, seed: int
) -> dict[str, list[int]]:
    """Rows of every label per client, in Dirichlet shares.

    Each label draws gamma weights from a stream of its own, seeded by the label, so a further label does not
    change the others. Rounding the running sum of the shares keeps every label's total. A client short of
    ``minimum`` rows then takes rows of the label and client that hold most at that moment.
    """
    total = sum(label_counts.values())
    if not alpha > 0 or total < clients * minimum:
        raise ValueError(f"{total} rows with alpha {alpha} do not give {clients} clients {minimum} rows each")
    names = sorted(label_counts)
    table = np.zeros((len(names), clients), np.int64)
    for row, name in zip(table, names):
        weights = np.random.default_rng([seed, zlib.crc32(name.encode())]).gamma(alpha, size=clients) + 1e-12
        stops = np.rint(np.cumsum(weights) / weights.sum() * label_counts[name]).astype(np.int64)
        row[:] = np.diff(stops, prepend=0)
    while (short := minimum - table.sum(axis=0)).max() > 0:
        poor = int(short.argmax())
        spare = np.where(-short > 0, table, -1)  # only clients above the minimum give
        label, rich = np.unravel_index(int(spare.argmax()), spare.shape)
        moved = min(int(short[poor]), int(-short[rich]), int(table[label, rich]))
        table[label, rich] -= moved
        table[label, poor] += moved
    return {name: row.tolist() for name, row in zip(names, table)}


def dirichlet_partition(
    rows: DataFrame,
    *,
    clients: int,
    alpha: float,
    minimum: int,
    seed: int,
    label: str = "label",
    identity: str = "window_id",
) -> DataFrame:
    """Label-skewed client assignment; only the label counts visit the driver."""
    spark = rows.sparkSession
    counts = {
        r[label]: r["n"]
        for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    quotas = dirichlet_quotas(counts, clients=clients, alpha=alpha, minimum=minimum, seed=seed)
    bounds = spark.createDataFrame(
        [(name, np.cumsum(q).tolist()) for name, q in sorted(quotas.items())],
        f"{label} string, _stops array<bigint>",
    )
    ranked = hash_ranked(
        rows, groups=[label], digest=S.seeded_digest(seed, identity), tie=identity
    )
    placed = same_keys(ranked, bounds, [label])
    index = F.size(F.filter("_stops", lambda stop: stop < F.col("hash_rank"))).cast("int")
    return placed.withColumn("client_index", index).withColumn(
        "client_id", client_name(F.col("client_index"))
    ).drop("_stops", "hash_rank")


def verify_partition(
    expected: DataFrame,
    partition: DataFrame,
    *,
    identity: str = "window_id",
    width_ok: Column | None = None,
) -> DataFrame:
    """Overlaps, gaps, strangers and wrong-width rows of a partition, from one full join."""
    placed = partition.groupBy(identity).agg(
        F.count(F.lit(1)).alias("_copies"),
        (F.count_if(~width_ok) if width_ok is not None else F.lit(0)).alias("_bad"),
    )
    wanted = expected.select(identity).withColumn("_wanted", F.lit(True))
    both = wanted.join(placed, identity, "full")
    return both.agg(
        F.count_if(F.col("_wanted")).alias("expected_rows"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("placed_rows"),
        F.count_if(F.col("_copies") > 1).alias("overlapping_rows"),
        F.count_if(F.col("_copies").isNull()).alias("missing_rows"),
        F.count_if(F.col("_wanted").isNull()).alias("unexpected_rows"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("wrong_width_rows"),
    )


def forbid_columns(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN_COLUMNS) -> DataFrame:
    """The table itself, if no column (at any depth) carries a forbidden name."""
    def names(schema):
        for field in getattr(schema, "fields", ()):
            yield field.name
            kind = field.dataType
            while hasattr(kind, "elementType"):
                kind = kind.elementType
            yield from names(kind)

    leaked = sorted(set(forbidden) & set(names(df.schema)))
    if leaked:
        raise ValueError(f"shared table carries forbidden columns: {', '.join(leaked)}")
    return df


def shared_table(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """What leaves the evidence boundary: ids, label and scaled features, nothing else."""
    return forbid_columns(rows.select(*keep, *features))
