"""Streaming window features, de-duplication and chain continuity.

Each function maps a streaming DataFrame to a streaming DataFrame; sources, sinks and triggers are the
caller's. ``run_available`` drains what is there into a table, which is how the operators are compared
with their batch forms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tracelight.operators import windows as W
from tracelight.operators.integrity import GENESIS, ChainHeads


def stream_window_features(
    events: DataFrame,
    *,
    seconds: int,
    delay: str,
    vocabulary: Sequence[str],
    client: str = "central",
) -> DataFrame:
    """Window features over a stream; a window comes out once the watermark passes its end.

    ``events`` carries ``event_time`` (timestamp) next to the normalized event columns. Streams have no
    distinct count and a set per window would grow with its traffic, so the count runs in two chained
    aggregations: the first keeps one state row per window and distinct host or port (spread over the
    tasks by value), the second counts those rows and picks up the window's own sums.
    """
    host = F.when(F.col("responder_host") != "", F.col("responder_host"))
    port = F.when(F.col("responder_port") != 0, F.col("responder_port").cast("string"))
    kinds = F.array(
        F.struct(F.lit("window").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("host").alias("kind"), host.alias("value")),
        F.struct(F.lit("port").alias("kind"), port.alias("value")),
    )
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_pop("duration")).otherwise(F.lit(0.0))
    sums = [
        F.sum(c).cast("double").alias(f"{c}_sum")
        for c in ("originator_bytes", "responder_bytes", "originator_packets", "responder_packets")
    ]
    measured = [
        F.count(F.lit(1)).cast("double").alias("connection_count"),
        F.avg("duration").alias("duration_mean"),
        spread.alias("duration_std"),
        F.max("duration").alias("duration_max"),
        *sums,
        *W.shares("protocol", "protocol", W.PROTOCOLS),
        *W.shares("service", "service", W.SERVICES),
        *W.shares("connection_state", "state", W.STATES),
    ]
    counted = ("connection_count", "unique_destination_count", "unique_destination_port_count")
    own = [c for c in W.FEATURES if c not in counted[1:]]
    first = (
        events.withWatermark("event_time", delay)
        .select("*", F.inline(kinds))
        .where(F.col("value").isNotNull())
        .groupBy(F.window("event_time", f"{seconds} seconds").alias("_window"), "capture_id", "kind", "value")
        .agg(*measured, W.label_flags(vocabulary, "label").alias("_flags"))
    )
    of_window = F.col("kind") == "window"
    grouped = first.groupBy(
        F.window(F.col("_window"), f"{seconds} seconds").alias("_span"), "capture_id"
    ).agg(
        F.count_if(F.col("kind") == "host").cast("double").alias(counted[1]),
        F.count_if(F.col("kind") == "port").cast("double").alias(counted[2]),
        *[F.max(F.when(of_window, F.col(c))).alias(c) for c in own],
        F.max(F.when(of_window, F.col("_flags"))).alias("_flags"),
    )
    start = F.unix_seconds(F.col("_span.start"))
    observed = W.flagged_labels(vocabulary, F.col("_flags"))
    return grouped.select(
        W.window_id(F.col("capture_id"), F.floor(start / seconds), client).alias("window_id"),
        start.alias("window_start_epoch"),
        (start + seconds).alias("window_end_epoch"),
        "capture_id",
        W.choose_label(observed).alias("label"),
        observed.alias("observed_labels"),
        *[F.round(c, 12).alias(c) for c in W.FEATURES],
    )


def drop_redeliveries(
    batches: DataFrame, event_time: str, delay: str, keys: Sequence[str]
) -> DataFrame:
    """First delivery per key; repeats within the watermark delay are dropped, later state is freed."""
    return batches.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


STATE = "clients string"
OUTPUT = "batch_id bigint, client_id string, session_id string, sequence_number bigint, continuity string"
#: Groups of clients that are followed together.
BUCKETS = 4096


def client_bucket(buckets: int = BUCKETS) -> Column:
    """The group a client is followed in. Files cut by it let a micro-batch touch few groups."""
    return F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int")


def _follow_chains(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Continuity of the batches of a group of clients in a micro-batch, per client in order of acquisition."""
    kept = json.loads(state.get[0]) if state.exists else []
    heads = {client: ChainHeads(head, {k: (v[0], v[1]) for k, v in sessions.items()}) for client, head, sessions in kept}
    rows = pd.concat(list(batches)).sort_values(["client_id", "acquired_at", "session_id", "sequence_number"])
    rows = rows.assign(client_id=rows["client_id"].astype(object).where(rows["client_id"].notna(), None))
    names = ("client_id", "session_id", "sequence_number", "previous_chain_hash", "chain_hash", "eligible")
    verdicts = []
    for client, session, position, previous, commitment, eligible in zip(*[rows[n] for n in names], strict=True):
        own = heads.get(client)
        if own is None:
            own = heads[client] = ChainHeads()
        verdicts.append(own.receive(session, int(position), previous, commitment, bool(eligible)))
    state.update((json.dumps([[client, own.head, own.sessions] for client, own in heads.items()]),))
    yield rows[["batch_id", "client_id", "session_id", "sequence_number"]].assign(continuity=verdicts)


def follow_chains(batches: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Verdict on every batch as it arrives, by the rule of ``integrity.verify_continuity``.

    ``eligible`` says whether a batch passed its other checks; repeated deliveries are to be dropped
    before. The state holds the accepted heads of every client, for ``buckets`` groups of clients, as a group a client
    would cost a call each; more buckets make smaller states. A group's share of one micro-batch is handled
    together; ``read_files`` bounds the files of a micro-batch. A checkpoint goes with its number of buckets.
    """
    return batches.withColumn("_bucket", client_bucket(buckets)).groupBy("_bucket").applyInPandasWithState(
        _follow_chains, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def read_files(
    spark: SparkSession, folder: str, schema: StructType, name: str = "*.parquet", files_per_trigger: int = 16
) -> DataFrame:
    """Parquet files of a folder as a stream; a micro-batch takes so many files at most."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(stream: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Writes everything that is available to a table and reads it back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)


def event_time(epoch: str) -> Column:
    """Timestamp column of an epoch column with microseconds."""
    return F.timestamp_micros(F.round(F.col(epoch) * 1e6).cast("bigint"))
