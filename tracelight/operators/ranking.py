"""Exact ranks and quantiles that never put a whole group in one task.

A window over a hot group, or an exact percentile over a long column, ends in a single task. Both
operators here first cut a group into slots that follow the sort order, count the slots (a small,
map-side-combined table) and then order only inside a slot. Slots are computed from the row itself,
so a recomputed partition lands in the same slot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.session import stored


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null keys match, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def slot_ranked(
    df: DataFrame,
    *,
    groups: Sequence[str],
    slot: Column,
    order: Sequence[str],
    rank: str = "place",
    total: str | None = None,
) -> DataFrame:
    """1-based rank of every row of its group by ``order``, sorted slot by slot.

    ``slot`` must never fall while the order rises (a time range for times, leading digits for digests).
    Slots are counted first; a task then sorts one slot of a group, never the whole group.
    """
    keyed = df.withColumn("_slot", slot)
    slots = keyed.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_slot_rows"))
    by_group = Window.partitionBy(*groups)
    before = F.sum("_slot_rows").over(
        by_group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    slots = slots.select(
        *groups,
        "_slot",
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_slot_rows").over(by_group).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*groups, "_slot").orderBy(*order))
    ranked = same_keys(keyed.withColumn("_local", local), slots, [*groups, "_slot"])
    ranked = ranked.withColumn(rank, (F.col("_before") + F.col("_local")).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total").cast("bigint"))
    return ranked.drop("_slot", "_before", "_total", "_local")


def hash_ranked(
    df: DataFrame,
    *,
    groups: Sequence[str],
    digest: Column,
    tie: str,
    rank: str = "hash_rank",
    total: str | None = None,
    prefix: int = 3,
) -> DataFrame:
    """1-based rank of every row of its group by (``digest``, ``tie``), a hexadecimal text digest.

    Digests are uniform, so the first ``prefix`` hex digits make 16**prefix even slots per group.
    """
    keyed = df.withColumn("_digest", digest)
    ranked = slot_ranked(
        keyed,
        groups=groups,
        slot=F.substring("_digest", 1, prefix),
        order=["_digest", tie],
        rank=rank,
        total=total,
    )
    return ranked.drop("_digest")


def _slot_of(value: Column, low: Column, high: Column, slots: int) -> Column:
    """Slot of a value between the bounds; never falls as the value grows, so slots keep the order.

    Slots are even on a logarithmic scale, on which no outlier leaves the others in one slot. The
    logarithm never falls either (its rounding keeps the order).
    """
    value, low, high = (F.signum(x) * F.log1p(F.abs(x)) for x in (value, low, high))
    place = F.floor((value - low) / (high - low) * F.lit(float(slots)))
    return F.when(high > low, F.least(place, F.lit(slots - 1))).otherwise(F.lit(0)).cast("bigint")


def order_statistics(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    slots: int = 2048,
    levels: int = 2,
) -> DataFrame:
    """Exact values at 0-based ranks per key: ``keys``, rows, rank, value, and the rows ``below`` and ``equal`` to it.

    ``ranks`` makes the array of wanted ranks from the number of rows; it may read key columns. Nulls are left out.
    Equal values are counted once up front. Every level narrows each wanted rank to one of ``slots``
    ranges that are even on a logarithmic scale, for all keys in one pass, and only the values of the last,
    narrow ranges are sorted. A range row carries the ranks that lie in it, so each level adds one join of the
    counted values with a small table.
    """
    outer = list(keys)
    keys = outer or ["_all"]
    counts, ranges = _narrowed(df, keys, value, ranks, slots, levels)
    found = _covered(_inside(counts, ranges, keys), keys, "_v")
    return found.select(
        *outer,
        F.col("_rows").alias("rows"),
        F.explode("_ranks").alias("rank"),
        F.col("_v").alias("value"),
        F.col("_start").alias("below"),
        F.col("_n").alias("equal"),
    )


def _inside(counts: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return same_keys(counts, ranges, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))


def _covered(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with the wanted ranks that fall into them, counted on from the rows below the range."""
    running = Window.partitionBy(*keys, "_low", "_under").orderBy(order)
    counted = rows.withColumn("_stop", F.col("_under") + F.sum("_n").over(running)).withColumn(
        "_start", F.col("_stop") - F.col("_n")
    )
    mine = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_stop")))
    return counted.withColumn("_ranks", mine).where(F.size("_ranks") > 0)


def _narrowed(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column], slots: int, levels: int
) -> tuple[DataFrame, DataFrame]:
    """Counted values, and the narrow ranges in which the wanted ranks lie."""
    source = df.withColumn("_all", F.lit(0)) if list(keys) == ["_all"] else df
    counts = source.where(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("_v")
    ).agg(F.count(F.lit(1)).alias("_n"))
    # Range row: bounds, rows known to lie below, rows in all, and the wanted ranks inside.
    ranges = (
        counts.groupBy(*keys)
        .agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_rows"))
        .select(*keys, "_low", "_high", F.lit(0).cast("bigint").alias("_under"), "_rows", ranks(F.col("_rows")).alias("_ranks"))
    )
    for _ in range(levels):
        slot = _slot_of(F.col("_v"), F.col("_low"), F.col("_high"), slots)
        histogram = _inside(counts, ranges, keys).groupBy(
            *keys, "_low", "_under", "_rows", "_ranks", slot.alias("_slot")
        ).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        ranges = _covered(histogram, keys, "_slot").select(
            *keys,
            F.col("_from").alias("_low"),
            F.col("_to").alias("_high"),
            F.col("_start").alias("_under"),
            "_rows",
            "_ranks",
        )
    return counts, ranges


def exact_quantiles(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    slots: int = 2048,
    levels: int = 2,
) -> DataFrame:
    """Linear-interpolated quantiles per key: columns ``keys``, ``probability``, ``quantile``."""
    outer = list(keys)
    chosen = F.array(*[F.lit(float(p)) for p in probabilities])

    def place(rows: Column, p: Column) -> Column:
        return (rows - 1) * p

    def wanted(rows: Column) -> Column:
        both = F.transform(chosen, lambda p: F.array(F.floor(place(rows, p)), F.ceil(place(rows, p))))
        return F.array_distinct(F.flatten(both))

    found = order_statistics(df, keys=keys, value=value, ranks=wanted, slots=slots, levels=levels)
    # At most two ranks per probability: one small row per key.
    gathered = found.groupBy(*outer, "rows").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")
    )
    spread = gathered.withColumn("probability", F.explode(chosen)).withColumn(
        "_place", place(F.col("rows"), F.col("probability"))
    )
    low = F.element_at("_at", F.floor("_place"))
    high = F.element_at("_at", F.ceil("_place"))
    weight = F.col("_place") - F.floor("_place")
    return spread.select(*outer, "probability", (low + (high - low) * weight).alias("quantile"))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key (one row over all without keys); no task holds the values of a key."""
    found = exact_quantiles(df, keys=keys, value=value, probabilities=[0.5])
    return found.select(*keys, F.col("quantile").alias(name))


def trimmed_means(df: DataFrame, keys: Sequence[str], value: str, rows: int, trim: int, name: str) -> DataFrame:
    """Mean per key without the ``trim`` smallest and the ``trim`` largest of its ``rows`` values.

    The two values at the ends of the kept ranks are selected; kept values between them are summed in the tasks, and
    the copies of the end values are counted, so ties are exact and no group is sorted.
    """
    ends = order_statistics(
        df, keys=keys, value=value, ranks=lambda n: F.array_distinct(F.array(F.lit(trim), F.lit(rows - trim - 1)).cast("array<bigint>"))
    )
    first, last = F.struct("value", "below", "equal"), F.col("rank") == rows - trim - 1
    bounds = ends.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == trim, first)).alias("_a"), F.max(F.when(last, first)).alias("_b")
    )
    inside = same_keys(df.select(*keys, F.col(value).alias("_v")), bounds, keys).groupBy(*keys, "_a", "_b").agg(
        F.coalesce(F.sum(F.when((F.col("_v") > F.col("_a.value")) & (F.col("_v") < F.col("_b.value")), F.col("_v"))), F.lit(0.0)).alias("_sum")
    )
    copies_a = F.col("_a.below") + F.col("_a.equal") - trim
    copies_b = F.lit(rows - trim) - F.col("_b.below")
    total = F.col("_sum") + F.col("_a.value") * copies_a + F.col("_b.value") * copies_b
    flat = F.col("_a.value") == F.col("_b.value")
    return inside.select(*keys, F.when(flat, F.col("_a.value")).otherwise(total / (rows - 2 * trim)).alias(name))


def smallest(df: DataFrame, keys: Sequence[str], value: str, tie: str, count: int) -> DataFrame:
    """The ``count`` rows of each key with the smallest ``value``, the smallest ``tie`` (a number) on equal ones.

    The value at the last kept rank is selected, then, among the rows that have it, the last kept tie.
    """
    cut = order_statistics(df, keys=keys, value=value, ranks=lambda n: F.array(F.least(n, F.lit(count)) - 1))
    cut = cut.select(*keys, F.col("value").alias("_cut"), (F.least("rows", F.lit(count)) - F.col("below")).alias("_need"))
    marked = same_keys(df, cut, keys)
    ties = marked.where(F.col(value) == F.col("_cut"))
    last = order_statistics(ties, keys=[*keys, "_need"], value=tie, ranks=lambda n: F.array(F.col("_need") - 1))
    marked = same_keys(marked.drop("_need"), last.select(*keys, F.col("value").alias("_tie")), keys)
    return marked.where((F.col(value) < F.col("_cut")) | ((F.col(value) == F.col("_cut")) & (F.col(tie) <= F.col("_tie")))).drop("_cut", "_tie")


def range_ranked(df: DataFrame, order: Sequence[str], rank: str = "place") -> DataFrame:
    """1-based rank of every row in the total order by ``order``, whatever its distribution.

    Splitters sampled from the whole composite key cut the rows into ranges of about equal size; each task sorts one
    range, and counted offsets turn places in a range into ranks. The ranges are written first, so
    a lost task finds the same rows in the same place. Equal keys meet in one range: make ``order`` unique
    (end it with an id) if many rows could share a key.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranges"
    )
    parts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per task
    starts = parts.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = held.join(starts, "_part")
    return ranked.withColumn(rank, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_rows", "_first", "_before")
