"""Class prototypes: extraction, aggregation with quorum, indicators and nearest-class prediction."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tracelight.functions import vectors as V
from tracelight.operators import tiles as T
from tracelight.operators.ranking import same_keys, slot_ranked
from tracelight.operators.robust import SMALL_GROUP, deviation_scores, grouped_medians
from tracelight.session import stored

#: Prototypes that may be listed in one value.
LISTED = 1024
#: Rows, and members of tiles of the prototype index, that meet together at most.
BLOCK, PAGE = 1024, 2048
#: Packed rows on their way through the tiles.
BLOCK_ROW = "_needs array<int>, _block_no string, _block binary"
#: A packed vector; its width is -1 if it or one of its values is null.
PACKED = StructType([StructField("width", IntegerType()), StructField("values", BinaryType())])


def class_dimension(df: DataFrame, classes: Sequence, name: str = "class") -> DataFrame:
    """One row per class of a fixed vocabulary, so that empty classes stay visible."""
    values = F.array(*[F.lit(c) for c in classes])
    return df.sparkSession.range(1).select(F.explode(values).alias(name))


def local_prototypes(
    rows: DataFrame, vector: str, width: int, minimum_support: int, classes: Sequence
) -> tuple[DataFrame, DataFrame]:
    """(prototypes, supports): centroids of well-supported (client, class) pairs, support of all pairs."""
    if minimum_support <= 0:
        raise ValueError("minimum support must be positive")
    means = V.mean_vector(rows, ["client_id", "class"], vector, "vector", width, count="support")
    counts = rows.groupBy("client_id", "class").agg(F.count(F.lit(1)).alias("support"))
    grid = (
        rows.select("client_id").distinct()
        .withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    )
    supports = grid.join(counts, ["client_id", "class"], "left").fillna(0, ["support"])
    return means.where(F.col("support") >= minimum_support), supports


def aggregate_prototypes(
    prototypes: DataFrame,
    classes: Sequence,
    *,
    strategy: str,
    quorum: int,
    width: int,
    minimum_support: int = 1,
    skip_low_support: bool = False,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Per class: status, supporting clients, total support and the aggregate once quorum is met.

    A submitted prototype below ``minimum_support`` stops the job unless such rows are to be skipped.
    """
    if quorum <= 0 or minimum_support <= 0:
        raise ValueError("quorum and minimum support must be positive")
    enough = F.col("support") >= minimum_support
    if not skip_low_support:
        low = F.raise_error(F.lit("a submitted prototype is below the declared support"))
        enough = F.when(enough, F.lit(True)).otherwise(low.cast("boolean"))
    eligible = prototypes.where(enough)
    if strategy == "support_weighted_mean":
        values = V.mean_vector(eligible, ["class"], "vector", "aggregate", width, weight="support")
    elif strategy == "coordinate_median":
        long = V.coordinates(eligible, ["class"], "vector")
        long = grouped_medians(long, ["class", "pos"], "value", "value", prototypes.count(), small_group)
        values = V.gather(long, ["class"], "value", "aggregate")
    else:
        raise ValueError(f"unknown prototype aggregation: {strategy}")
    counts = eligible.groupBy("class").agg(
        F.count(F.lit(1)).alias("supporting_client_count"), F.sum("support").alias("total_support")
    )
    dense = (
        class_dimension(prototypes, classes)
        .join(counts, "class", "left")
        .fillna(0, ["supporting_client_count", "total_support"])
        .join(values, "class", "left")
    )
    met = F.col("supporting_client_count") >= quorum
    return dense.select(
        "class",
        F.when(met, "aggregated").otherwise("insufficient_quorum").alias("status"),
        "supporting_client_count",
        "total_support",
        F.when(met, F.col("aggregate")).alias("vector"),
    )


def carry_forward(aggregated: DataFrame, previous: DataFrame) -> DataFrame:
    """Fills classes below quorum from the previous round: status says where the vector comes from."""
    before = previous.select("class", F.col("vector").alias("_previous"))
    status = (
        F.when(F.col("status") == "aggregated", F.lit("aggregated"))
        .when(F.col("_previous").isNotNull(), F.lit("retained_previous"))
        .otherwise(F.lit("unavailable"))
    )
    return aggregated.join(before, "class", "left").select(
        "class",
        status.alias("status"),
        "supporting_client_count",
        "total_support",
        F.coalesce("vector", "_previous").alias("vector"),
    )


def prototype_indicators(prototypes: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """Distance of every client prototype to the coordinate median of its class."""
    scores = deviation_scores(prototypes, ["support"], "client_id", "vector", ["class"], small_group)
    middles = grouped_medians(scores, ["class"], "median_distance", "_middle", prototypes.count(), small_group)
    joined = same_keys(scores, middles, ["class"])
    return joined.select(
        "client_id",
        "class",
        "support",
        F.col("median_distance").alias("distance_to_coordinate_median"),
        (F.col("median_distance") / F.greatest("_middle", F.lit(1e-12))).alias("relative_distance"),
        "mad_score",
    )


def prototype_list(prototypes: DataFrame, key: str = "class", vector: str = "vector") -> Column:
    """Available prototypes as one scalar array, in class order; more than ``LISTED`` stop here.

    Larger class tables go through :func:`nearest_indexed`.
    """
    usable = prototypes.where(F.col(vector).isNotNull())
    if usable.limit(LISTED + 1).count() > LISTED:
        raise ValueError(f"more than {LISTED} prototypes: use nearest_indexed")
    pair = F.struct(F.col(key).alias("class"), F.col(vector).alias("vector"))
    return usable.agg(F.array_sort(F.collect_list(pair)).alias("_list")).scalar()


def _distances(vector: Column, listed: Column) -> Column:
    """(distance, class) of all prototypes, nearest first; class order breaks ties."""
    pairs = F.transform(
        listed,
        lambda p: F.struct(
            V.l2_distance(vector, p["vector"]).alias("distance"), p["class"].alias("class")
        ),
    )
    return F.array_sort(pairs)


def _with_best(rows: DataFrame, columns: Sequence[str], best: str, *more: Column | str) -> DataFrame:
    first, second = F.get(best, F.lit(0)), F.get(best, F.lit(1))
    return rows.select(
        *columns,
        first["class"].alias("nearest_class"),
        first["distance"].alias("nearest_distance"),
        second["class"].alias("second_class"),
        (second["distance"] - first["distance"]).alias("distance_margin"),
        *more,
    )


def nearest_prototypes(rows: DataFrame, prototypes: DataFrame, vector: str) -> DataFrame:
    """Rows with ``nearest_class``, ``nearest_distance``, ``distance_margin`` and all ``distances``.

    For class tables of up to ``LISTED`` prototypes: they are one scalar array, and rows are only projected.
    """
    marked = rows.withColumn("_list", prototype_list(prototypes))
    ranked = marked.withColumn("distances", _distances(F.col(vector), F.col("_list"))).drop("_list")
    return _with_best(ranked, rows.columns, "distances", "distances")


def prototype_index(prototypes: DataFrame, size: int = 256) -> tuple[DataFrame, list[float]]:
    """(tiles, pivot) of the available prototypes, for :func:`nearest_indexed`.

    Prototypes are ordered by norm and cut into ranges, each range is ordered by distance to a pivot and cut
    again, all by exact ranks. A tile keeps its members (packed) and the bounds of both quantities. There are about a thousand
    tiles at most, of ``size`` members or more. Ranks are taken without the vectors, which move once, to their tile.
    """
    usable = prototypes.where(F.col("vector").isNotNull()).select("class", "vector")
    head = usable.agg(F.count(F.lit(1)).alias("n"), F.min_by("vector", "class").alias("pivot")).first()
    wanted = min(max(math.ceil(head["n"] / size), 1), 1024)
    outer = math.ceil(math.sqrt(wanted))
    inner = math.ceil(wanted / outer)
    pivot = list(head["pivot"] or [])
    far = V.l2_distance("vector", F.array(*[F.lit(float(x)) for x in pivot]).cast("array<double>"))
    measured = usable.withColumn("_norm", V.l2_norm("vector")).withColumn("_far", far)

    def slot(value: str) -> Column:
        return F.floor(F.log1p(value) * 256)

    placed = slot_ranked(measured.drop("vector"), groups=[], slot=slot("_norm"), order=["_norm", "class"], rank="_place", total="_rows")
    placed = placed.withColumn("_outer", F.floor((F.col("_place") - 1) * outer / F.col("_rows"))).drop("_place", "_rows")
    placed = slot_ranked(placed, groups=["_outer"], slot=slot("_far"), order=["_far", "class"], rank="_place", total="_rows")
    place = F.floor((F.col("_place") - 1) * inner / F.col("_rows"))
    first = placed.groupBy("_outer", place.alias("_inner")).agg(
        F.min(F.struct("_norm", "class")).alias("_from"), F.min(F.struct("_far", "class")).alias("at")
    )  # a row per tile
    ranges = first.groupBy("_outer").agg(
        F.min("_from").alias("at"), F.array_sort(F.collect_list(F.struct("at", F.col("_inner").alias("number")))).alias("inner")
    )
    cuts = ranges.agg(F.array_sort(F.collect_list(F.struct("at", F.col("_outer").alias("number"), "inner")))).scalar()

    def last(starts: Column, *key: str) -> Column:
        """The range that a key lies in."""
        return F.get(F.filter(starts, lambda c: c["at"] <= F.struct(*key)), F.size(F.filter(starts, lambda c: c["at"] <= F.struct(*key))) - 1)

    ranged = measured.withColumn("_cuts", cuts).withColumn("_range", last(F.col("_cuts"), "_norm", "class")).drop("_cuts")
    tile = F.col("_range.number") * inner + last(F.col("_range.inner"), "_far", "class")["number"]
    dealt = _packed(ranged.select(tile.cast("int").alias("_tile"), "class", "vector", "_norm", "_far"), "vector")
    tiles = dealt.groupBy("_tile").agg(
        F.collect_list(F.struct("class", "vector")).alias("_members"),
        F.min("_norm").alias("_norm_low"), F.max("_norm").alias("_norm_high"),
        F.min("_far").alias("_far_low"), F.max("_far").alias("_far_high"),
    )
    return stored(tiles, "prototype-tiles"), pivot


def _packed(df: DataFrame, vector: str) -> DataFrame:
    """The vectors of a column as (width, values), values in four bytes where that loses nothing; packed ones stay as they are."""
    if isinstance(df.schema[vector].dataType, StructType):
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, values = T.vectors(batch[vector])
            packed = pa.StructArray.from_arrays([pa.array(widths, pa.int32()), pa.array(values, pa.binary())], ["width", "values"])
            yield batch.set_column(batch.schema.get_field_index(vector), vector, packed)

    schema = StructType([StructField(f.name, PACKED if f.name == vector else f.dataType) for f in df.schema])
    return df.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def _paged(members: DataFrame) -> DataFrame:
    """Pages (``_tiles``, ``_page_no``, ``_page``) of about ``PAGE`` members of tiles, packed and stored."""
    one = members.select("_tile", F.explode("_members").alias("_m"))
    one = _packed(one.select("_tile", F.col("_m.class").alias("class"), F.col("_m.vector").alias("vector")), "vector")
    size = PAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def rows() -> Iterator[tuple]:
            for batch in chain([first], batches):
                yield from zip(batch["_tile"].to_pylist(), batch["class"].to_pylist(), *T.unpacked(batch["vector"]), strict=True)

        for i, (tiles, page) in enumerate(T.paged(rows(), first.schema.field("class").type, size)):
            yield pa.RecordBatch.from_pydict({"_tiles": pa.array([tiles], pa.list_(pa.int32())), "_page_no": [f"{TaskContext.get().partitionId()}-{i}"], "_page": [page]})

    return stored(one.mapInArrow(run, "_tiles array<int>, _page_no string, _page binary"), "prototype-pages")


def _blocks(visits: DataFrame, identity: str, bounds: T.Bounds | None) -> DataFrame:
    """Blocks (``_needs``, ``_block_no``, ``_block``) of about ``BLOCK`` visits whose home tiles are neighbours; ``_needs`` lists those."""
    types = visits.schema
    kept = {"id": identity, "own": "_own", "v": "_v", "far": "_own_far", "own_v": "_own_v", "home": "_tile"}
    asked = _packed(visits, "_v").select([F.col(c).alias(name) for name, c in kept.items() if c in visits.columns])
    size = BLOCK

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, values = T.unpacked(batch["v"])
            names = batch.schema.names
            far = batch["far"] if "far" in names else T.between((widths, values), T.unpacked(batch["own_v"]))
            home = batch["home"].cast(pa.int32()) if bounds is None else pa.array(bounds.home(*T.measured(T.matrices(widths, values), len(widths), bounds.pivot)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["own"], far, pa.array(widths, pa.int32()), pa.array(values, pa.binary()), home], ["id", "own", "far", "width", "v", "home"])

    schema = StructType([StructField("id", types[identity].dataType), StructField("own", types["_own"].dataType), StructField("far", DoubleType()), StructField("width", IntegerType()), StructField("v", BinaryType()), StructField("home", IntegerType())])
    near = asked.mapInArrow(placed, schema).repartitionByRange("home", F.xxhash64("id")).sortWithinPartitions("home")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        rows = (row for batch in chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for i, held in enumerate(T.pieces(rows, size, 4)):
            yield _block_row(T.Block(first.schema.field("id").type, held), None, i)

    return near.mapInArrow(blocks, BLOCK_ROW)


def _block_row(block: T.Block, bounds: T.Bounds | None, number: object) -> pa.RecordBatch:
    needs = sorted(set(block.home.tolist())) if bounds is None else block.needs(bounds)
    return pa.RecordBatch.from_pydict({"_needs": pa.array([needs], pa.list_(pa.int32())), "_block_no": [str(number)], "_block": [block.dumps()]})


def _swept(pages: DataFrame, blocks: DataFrame, bounds: T.Bounds | None, first: bool, out: str | StructType) -> DataFrame:
    """Blocks after they met the pages they need: first the home tiles of their rows, then all other tiles in reach.

    A task holds some blocks and reads the pages as one stream, so neither is copied to a disk for the other, and a row leaves its
    task with the best two of all its tiles.
    """
    pairs = pages.coalesce(1).join(blocks.hint("shuffle_replicate_nl"), F.arrays_overlap("_tiles", "_needs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, T.Block] = {}
        at, page = None, None
        for batch in batches:
            for i, (page_no, block_no) in enumerate(zip(batch["_page_no"].to_pylist(), batch["_block_no"].to_pylist(), strict=True)):
                if page_no != at:
                    at, page = page_no, T.Page(batch["_page"][i].as_buffer())
                if block_no not in met:
                    met[block_no] = T.Block.loads(batch["_block"][i].as_buffer())
                block = met[block_no]
                block.meet(page, block.home[:, None] == page.tiles if first else block.near(bounds, page.tiles))
        for block_no, block in met.items():
            if first and bounds is not None:
                yield _block_row(block, bounds, block_no)
            else:
                yield pa.RecordBatch.from_arrays(list(block.found()), ["_id", "_two", "_nearer"])

    return pairs.select("_page_no", "_page", "_block_no", "_block").mapInArrow(run, out)


def _visited(visits: DataFrame, members: DataFrame, identity: str, bounds: T.Bounds | None = None) -> DataFrame:
    """Visits with the best two members they met (``_two``) and, where the own class has a distance, the members nearer than it.

    A visit names its own class (``_own``), the distance of that (``_own_far``) or its packed vector (``_own_v``), and the
    tile it meets (``_tile``). With ``bounds`` it first meets the tile that its norm and its distance to
    the pivot point to, and then all tiles that the best two and the own class do not rule out.
    """
    label = members.schema["_members"].dataType.elementType["class"].dataType
    two = ArrayType(StructType([StructField("distance", DoubleType()), StructField("class", label)]))
    found = StructType([StructField("_id", visits.schema[identity].dataType), StructField("_two", two), StructField("_nearer", LongType())])
    pages = _paged(members)
    met = _swept(pages, _blocks(visits, identity, bounds), bounds, True, found if bounds is None else BLOCK_ROW)
    if bounds is not None:
        met = _swept(pages, met, bounds, False, found)
    return met.withColumnRenamed("_id", identity)


def nearest_indexed(
    rows: DataFrame,
    prototypes: DataFrame,
    vector: str,
    identity: str,
    rank_of: str | None = None,
    size: int = 256,
) -> DataFrame:
    """As :func:`nearest_prototypes` for class tables of any size, with ``class_rank`` of the class in ``rank_of``.

    A row first meets the tile that its norm and its distance to the pivot point to, and the prototype of its own
    class. Both give distances that the answer cannot exceed, and by the triangle inequality a tile matters only if
    its ranges come that close. Rows meet those tiles in blocks, and a row's best two and its number of nearer
    prototypes are merged per ``identity`` (unique, not null). ``class_rank`` is null for classes without prototype.
    """
    tiles, pivot = prototype_index(prototypes, size)
    bounds = T.Bounds(tiles.select("_tile", "_norm_low", "_norm_high", "_far_low", "_far_high").collect(), pivot)  # about a thousand at most
    own = F.col(rank_of) if rank_of else F.lit(None).cast(prototypes.schema["class"].dataType)
    known = rows.where(F.col(identity).isNotNull()).select(identity, F.col(vector).alias("_v"), own.alias("_own"))
    known = _packed(known, "_v")
    if rank_of:
        of = prototypes.where(F.col("vector").isNotNull()).select(F.col("class").alias("_own"), F.col("vector").alias("_own_v"))
        known = known.join(_packed(of, "_own_v"), "_own", "left")
    else:
        known = known.withColumn("_own_far", F.lit(None).cast("double"))
    part = _visited(known, tiles.select("_tile", "_members"), identity, bounds)
    merged = part.groupBy(identity).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_two"))), 1, 2).alias("_best"),
        (F.sum("_nearer") + 1).cast("int").alias("_rank"),
    )
    joined = rows.join(merged, identity, "left")
    return _with_best(joined, rows.columns, "_best", *([F.col("_rank").alias("class_rank")] if rank_of else []))


def nearest_per_model(
    rows: DataFrame, prototypes: DataFrame, vector: str, model: str = "model_id"
) -> DataFrame:
    """Rows scored by every model of a prototype table (model, class, vector): one row per model.

    The rows are spread over the model ids and meet the prototype list of their model in an equi-join.
    """
    lists = prototypes.where(F.col("vector").isNotNull()).groupBy(model).agg(
        F.array_sort(F.collect_list(F.struct("class", "vector"))).alias("_list")
    )
    names = prototypes.agg(F.array_sort(F.collect_set(model))).scalar()
    spread = rows.withColumn("_models", names).withColumn(model, F.explode("_models")).drop("_models")
    ranked = spread.join(lists, model).withColumn(
        "_best", F.get(_distances(F.col(vector), F.col("_list")), F.lit(0))
    )
    return ranked.select(
        model,
        *rows.columns,
        F.col("_best.class").alias("nearest_class"),
        F.col("_best.distance").alias("nearest_distance"),
    )


def class_rank(distances: Column | str, cls: Column | str) -> Column:
    """1-based place of a class among the sorted prototype distances."""
    distances = F.col(distances) if isinstance(distances, str) else distances
    cls = F.col(cls) if isinstance(cls, str) else cls
    return F.array_position(F.transform(distances, lambda d: d["class"]), cls).cast("int")


def aggregate_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """L2 distance a class prototype moved between two aggregates; null where one side lacks it."""
    left = before.select("class", F.col("vector").alias("_a"))
    right = after.select("class", F.col("vector").alias("_b"))
    return left.join(right, "class").select("class", V.l2_distance("_b", "_a").alias("shift_l2"))
