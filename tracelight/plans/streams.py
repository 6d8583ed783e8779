"""Streaming queries, each drained once and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.operators import integrity
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.dataset import _ROUNDED, rounded_features
from tracelight.plans.evidence import chain_parts, received_batches
from tracelight.plans.standins import with_parts
from tracelight.session import shared_directory
from tracelight.streaming import jobs


def drained(t: Tables, stream, name: str):
    return jobs.run_available(
        stream, shared_directory(t.spark, name), shared_directory(t.spark, f"{name}-checkpoint")
    )


DELAY_SECONDS = 600


@query(
    "t1_streaming_window_features",
    "T1",
    with_parts(
        "win",
        f"SELECT window_id, window_start_epoch, window_end_epoch, capture_id, label, observed_labels, {_ROUNDED} FROM win",
    ),
)
def streaming_window_features(t: Tables):
    """All windows: a closing row of another capture takes the watermark past the last of them."""
    path = shared_directory(t.spark, "stream-events")
    rows = X.connections(t)
    end = rows.agg(F.max("timestamp")).scalar()
    closing = rows.limit(1).withColumns(
        {"timestamp": end + 2.0 * DELAY_SECONDS, "capture_id": F.lit("closing")}
    )
    rows.unionByName(closing).write.parquet(path)
    events = jobs.read_files(t.spark, path, t.spark.read.parquet(path).schema)
    timed = events.withColumn("event_time", jobs.event_time("timestamp"))
    stream = jobs.stream_window_features(
        timed, seconds=X.WINDOW_SECONDS, delay=f"{DELAY_SECONDS} seconds", vocabulary=X.EVENT_LABELS
    )
    out = rounded_features(drained(t, stream, "stream-windows")).where("capture_id <> 'closing'")
    return out.withColumn("observed_labels", F.array_join("observed_labels", ","))


@query(
    "t2_streaming_deduplication",
    "T2",
    chain_parts("received", "SELECT batch_id, client_id, session_id, sequence_number, chain_hash FROM received"),
)
def streaming_deduplication(t: Tables):
    """Batches of which every second is delivered twice; state is freed an hour behind the stream."""
    path = shared_directory(t.spark, "stream-deliveries")
    columns = ["batch_id", "client_id", "session_id", "sequence_number", "chain_hash"]
    sent = received_batches(t).select(
        *columns[:3], F.col("sequence_number").cast("bigint").alias("sequence_number"), "chain_hash",
        F.timestamp_seconds(F.col("acquired_at") + 1_700_000_000).alias("event_time"),
    )
    sent.union(sent.where("batch_id % 2 = 0")).write.parquet(path)
    batches = jobs.read_files(t.spark, path, t.spark.read.parquet(path).schema)
    stream = jobs.drop_redeliveries(batches, "event_time", "1 hour", list(integrity.POSITION))
    return drained(t, stream, "stream-deduplicated").select(*columns)


@query(
    "t3_streaming_chain_continuity",
    "T3 I2",
    chain_parts("received cont", "SELECT r.batch_id, r.client_id, r.session_id, r.sequence_number, c.continuity FROM cont c JOIN received r USING (batch_id)"),
)
def streaming_chain_continuity(t: Tables):
    path = shared_directory(t.spark, "stream-batches")
    columns = ["batch_id", "client_id", "session_id", "acquired_at", "chain_hash", "previous_chain_hash"]
    checked = integrity.verify_links(received_batches(t)).repartition(jobs.client_bucket())  # a client's batches stay in order
    checked.select(
        *columns, F.col("sequence_number").cast("bigint").alias("sequence_number"), F.col("link_valid").alias("eligible")
    ).write.parquet(path)
    schema = t.spark.read.parquet(path).schema
    batches = jobs.read_files(t.spark, path, schema)
    return drained(t, jobs.follow_chains(batches), "stream-continuity")
