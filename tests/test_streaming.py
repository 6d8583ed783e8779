from pyspark.sql import functions as F

from tracelight.operators import integrity as I
from tracelight.operators import windows as W
from tracelight.streaming import jobs

from test_dataset import VOCABULARY, events
from test_evidence import chain


def drain(stream, folder, name):
    return jobs.run_available(stream, str(folder / name), str(folder / f"{name}-checkpoint"))


def test_stream_windows_equal_batch_and_late_rows_are_dropped(spark, tmp_path):
    timed = events(spark).withColumn("event_time", jobs.event_time("timestamp"))
    source = str(tmp_path / "in")
    closing = timed.limit(1).withColumn("event_time", F.lit("2023-12-01").cast("timestamp")).withColumn("capture_id", F.lit("end"))
    timed.unionByName(closing).coalesce(1).write.parquet(source)
    stream = jobs.stream_window_features(
        jobs.read_files(spark, source, timed.schema), seconds=60, delay="10 seconds", vocabulary=VOCABULARY
    )
    got = drain(stream, tmp_path, "out").drop("observed_labels").collect()
    batch = W.window_features(events(spark), seconds=60, vocabulary=VOCABULARY).drop("observed_labels").collect()
    assert sorted(map(str, got)) == sorted(map(str, batch)) and len(got) == 3
    timed.coalesce(1).write.mode("append").parquet(source)
    assert drain(stream, tmp_path, "out").count() == 3


def test_redeliveries(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("c", "s", 1, "2024-01-01 00:00:00")] * 3 + [("c", "s", 2, "2024-01-01 00:00:10")], "client_id string, session_id string, sequence_number int, at string")
    timed = rows.withColumn("at", F.col("at").cast("timestamp"))
    timed.write.parquet(source)
    keys = ["client_id", "session_id", "sequence_number"]
    stream = jobs.drop_redeliveries(jobs.read_files(spark, source, timed.schema), "at", "1 hour", keys)
    assert drain(stream, tmp_path, "out").count() == 2
    timed.write.mode("append").parquet(source)
    assert drain(stream, tmp_path, "out").count() == 2


def test_chain_state_lasts_over_micro_batches(spark, tmp_path):
    whole = chain(spark).withColumn("eligible", F.col("client_id") != "c2").withColumn("batch_id", F.col("acquired_at").cast("bigint")).withColumn("sequence_number", F.col("sequence_number").cast("bigint"))
    damaged = whole.where("NOT (client_id = 'c1' AND acquired_at = 1)")
    source = str(tmp_path / "in")
    columns = ["batch_id", "client_id", "session_id", "sequence_number", "acquired_at", "chain_hash", "previous_chain_hash", "eligible"]
    schema = damaged.select(*columns).schema
    for part in (damaged.where("acquired_at < 2"), damaged.where("acquired_at BETWEEN 2 AND 3"), damaged.where("acquired_at > 3")):
        part.select(*columns).coalesce(1).write.mode("append").parquet(source)
        out = drain(jobs.follow_chains(jobs.read_files(spark, source, schema)), tmp_path, "out")
    batch = I.verify_continuity(damaged, F.col("eligible")).select("client_id", "batch_id", "continuity")
    assert sorted(map(tuple, out.select("client_id", "batch_id", "continuity").collect())) == sorted(map(tuple, batch.collect()))
    refused = out.where("continuity <> 'continuous'").orderBy("client_id", "batch_id").collect()
    assert [(r["client_id"], r["batch_id"]) for r in refused] == [("c1", i) for i in range(2, 6)] + [("c2", i) for i in range(1, 6)]


def test_clients_are_followed_in_buckets(spark, tmp_path):
    whole = chain(spark, clients=9).withColumn("eligible", F.col("client_id") != "c2").withColumn("batch_id", F.col("acquired_at").cast("bigint")).withColumn("sequence_number", F.col("sequence_number").cast("bigint"))
    whole = whole.withColumn("client_id", F.when(F.col("client_id") != "c5", F.col("client_id"))).where("NOT (client_id <=> 'c1' AND acquired_at = 1)")
    source, columns = str(tmp_path / "in"), ["batch_id", "client_id", "session_id", "sequence_number", "acquired_at", "chain_hash", "previous_chain_hash", "eligible"]
    schema = whole.select(*columns).schema
    for part in (whole.where("acquired_at < 3"), whole.where("acquired_at >= 3")):
        part.select(*columns).coalesce(1).write.mode("append").parquet(source)
        out = drain(jobs.follow_chains(jobs.read_files(spark, source, schema), buckets=2), tmp_path, "out")
    batch = I.verify_continuity(whole, F.col("eligible")).select("batch_id", "client_id", "session_id", "sequence_number", "continuity")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
