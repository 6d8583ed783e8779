"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight.session import shared_directory


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back: a lost executor costs a read."""
    spark = df.sparkSession
    path = shared_directory(spark, purpose)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id written as text leaves remainder 2 modulo 4; null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def below(distinct: int, n: int) -> int | None:
    """A bound on a hash that more than ``n`` of so many (about) distinct hashes keep to; None if all shall pass."""
    width = (2 * n + 100) / max(distinct, 1)
    return int(-(2**63) + width * (2**64 - 1)) if width < 1 else None


def bounded_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of the id.

    A bound on the hash, from the number of different ids, thins the table in the scan, so that few more
    than ``n`` rows are ordered, whatever the table's size. All rows come if there are no more than ``n``.
    Rows whose ids are null or repeated share a hash and are ordered by their other columns; where ids are
    few, nothing is thinned and every task passes on ``n`` rows at most.
    """
    place = F.xxhash64(id_col)
    rows, ids = df.agg(F.count(F.lit(1)), F.approx_count_distinct(place, 0.02)).first()
    bound = below(ids, n) if rows > n else None
    if bound is not None:
        df = df.where(place < F.lit(bound))
    return df.orderBy(place, *[c for c, kind in df.dtypes if "map" not in kind and "variant" not in kind]).limit(n)


def sample_per_key(df: DataFrame, key: str, columns: list[str], n: int) -> tuple[DataFrame, dict[str, int]]:
    """At most ``n`` different rows (key and ``columns``) of each key, those with the smallest hashes, and the
    number of all rows of each key.

    A rare key is sampled like a common one. Keys must be few and not null: their counts meet on the driver.
    Rows are thinned in the scan by a bound of each key, and copies are grouped away before rows are ranked.
    """
    place = F.xxhash64(*columns)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(place, 0.02).alias("kinds"))
    sizes = {r[key]: (r["rows"], r["kinds"]) for r in sizes.orderBy(key).collect()}
    bounds = {k: below(kinds, n) for k, (_, kinds) in sizes.items()}
    bounds = [F.lit(x) for k, b in bounds.items() if b is not None for x in (k, b)]
    thin = df.select(key, *columns)
    if bounds:
        limit = F.try_element_at(F.create_map(*bounds), F.col(key))
        thin = thin.where(limit.isNull() | (place < limit))
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(place, *columns))
    chosen = thin.distinct().withColumn("_rank", ranked).where(F.col("_rank") <= n).drop("_rank")
    return chosen, {k: rows for k, (rows, _) in sizes.items()}


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of few, narrow columns with a broadcast hint if it has at most ``rows`` rows.

    Beyond that the join is left to adaptive execution, which shuffles both sides.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_column(df: DataFrame, name: str, value: Column) -> tuple[DataFrame, str]:
    """``df`` with a further column under a name that is still free, and that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return df.withColumn(name, value), name
