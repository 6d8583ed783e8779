import json

import pytest
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators import consolidation as K
from tracelight.operators import partitioning, splitting, transforms, windows
from tracelight.operators.normalization import normalize_events
from tracelight.sources import scans

# Seven connection lines in three captures; the first two form the benign window.
LINES = [
    dict(ts=1700000000.1, uid="a", proto="tcp", service="ssl", conn_state="SF", duration=0.3, orig_bytes=400, resp_bytes=900, orig_pkts=5, resp_pkts=6, capture_id="capture-benign", label="benign"),
    dict(ts=1700000010.2, uid="b", proto="udp", service="dns", conn_state="SF", duration=0.01, orig_bytes=72, resp_bytes=120, orig_pkts=1, resp_pkts=1, capture_id="capture-benign", label="benign"),
    dict(ts=1700000100.0, uid="c", proto="tcp", service="-", conn_state="S0", duration=0.0, orig_bytes=0, resp_bytes=0, orig_pkts=1, resp_pkts=0, capture_id="capture-recon", label="Reconnaissance"),
    dict(ts=1700000101.0, uid="d", proto="tcp", service="-", conn_state="REJ", duration=0.0, orig_bytes=0, resp_bytes=0, orig_pkts=1, resp_pkts=1, capture_id="capture-recon", label="benign"),
    dict(ts=1700000102.0, uid="e", proto="icmp", service="", conn_state="OTH", duration=1.0, orig_bytes=10, resp_bytes=0, orig_pkts=1, resp_pkts=0, capture_id="capture-recon", label="reconnaissance"),
    dict(ts=1700000200.0, uid="f", proto="tcp", service="http", conn_state="SF", duration=2.0, orig_bytes=10, resp_bytes=20, orig_pkts=1, resp_pkts=2, capture_id="capture-discovery", label="discovery"),
    dict(ts=1700000201.0, uid="g", proto="tcp", service="ssh", conn_state="RSTO", duration=4.0, orig_bytes=10, resp_bytes=20, orig_pkts=1, resp_pkts=2, capture_id="capture-discovery", label="exfiltration"),
]
VOCABULARY = ("benign", "discovery", "exfiltration", "reconnaissance")


def json_rows(spark, extra=()):
    lines = []
    for i, line in enumerate(LINES):
        full = {**line, "id.resp_h": f"10.0.0.{i % 2}", "id.resp_p": 443 if i else 0}
        lines.append((json.dumps(full),))
    return spark.createDataFrame([*lines, *[(e,) for e in extra]], "value string")


def events(spark):
    good = scans.parse_json_lines(json_rows(spark)).where("reject_reason IS NULL")
    return normalize_events(
        good,
        event_id=S.derived_id("event-test", F.col("raw_line_sha256"), 20),
        capture=F.coalesce("capture_id", F.lit("batch")),
        label=S.first_label("label"),
    )


def window_table(spark, **options):
    return windows.window_features(events(spark), seconds=60, vocabulary=VOCABULARY, **options)


def test_json_lines_report_every_kind_of_bad_line(spark):
    bad = [
        "{broken",
        "[1, 2]",
        '{"uid": "x", "label": "benign"}',
        '{"ts": null, "label": "benign"}',
        '{"ts": "-", "label": "benign"}',
        '{"ts": -4, "label": "benign"}',
        '{"ts": 1, "label": ""}',
        '{"ts": 1}',
        '{"ts": 1, "label": "a", "_source_records": "text"}',
        "   ",
    ]
    parsed = scans.parse_json_lines(json_rows(spark, bad))
    counts = {r["reject_reason"]: r["count"] for r in parsed.groupBy("reject_reason").count().collect()}
    assert counts == {
        None: 7,
        "invalid_json": 1,
        "missing_timestamp": 2,
        "invalid_timestamp": 3,
        "missing_label": 2,
        "invalid_source_lineage": 1,
    }


def test_window_features_by_hand(spark):
    rows = {r["capture_id"]: r for r in window_table(spark).collect()}
    benign = rows["capture-benign"]
    assert benign["window_start_epoch"] == 28333333 * 60
    assert benign["connection_count"] == 2 and benign["unique_destination_count"] == 2
    assert benign["unique_destination_port_count"] == 1  # port zero does not count
    assert benign["protocol_tcp_fraction"] == benign["service_ssl_fraction"] == 0.5
    assert benign["state_sf_fraction"] == 1.0 and benign["state_other_fraction"] == 0.0
    assert benign["originator_bytes_sum"] == 472
    assert benign["duration_mean"] == pytest.approx(0.155) and benign["duration_std"] == pytest.approx(0.145)
    assert benign["label"] == "benign"
    recon = rows["capture-recon"]
    assert recon["label"] == "reconnaissance" and recon["observed_labels"] == ["benign", "reconnaissance"]
    assert recon["service_other_fraction"] == 1.0 and recon["protocol_icmp_fraction"] == pytest.approx(1 / 3)
    assert rows["capture-discovery"]["label"] == "multi_tactic"


def test_label_lists_of_consolidated_sources_are_sorted(spark):
    line = json.dumps({**LINES[0], "observed_tactics": ["persistence", "benign"], "_source_records": [{"row": 1}]})
    parsed = scans.parse_json_lines(spark.createDataFrame([(line,)], "value string"))
    assert parsed.first()["reject_reason"] is None
    out = normalize_events(parsed, event_id=F.lit("e"), capture=F.col("capture_id"), label=S.first_label("label"), extra=("_source_records",)).first()
    assert out["observed_tactics"] == ["benign", "persistence"] and json.loads(out["_source_records"]) == [{"row": 1}]


def test_label_choice_without_mixed_label(spark):
    rows = {r["capture_id"]: r["label"] for r in window_table(spark, mixed=None).collect()}
    assert rows["capture-discovery"] == "discovery"


def test_sketch_distinct_counts_are_close(spark):
    exact = window_table(spark).agg(F.sum("unique_destination_count")).first()[0]
    sketch = window_table(spark, approximate_distinct=True).agg(F.sum("unique_destination_count")).first()[0]
    assert exact == sketch


def test_edges_lead_to_the_windows(spark):
    edges = windows.window_event_edges(events(spark), seconds=60)
    counted = edges.groupBy("window_id").count()
    joined = window_table(spark).join(counted, "window_id")
    assert joined.where("count = connection_count").count() == 3


RECORDS = [
    # identity, tactic, technique, binary
    (1, "benign", "none", "False"),
    (2, "defense_evasion", "T1070", "True"),
    (2, "persistence", "Duplicate", "Duplicate"),
    (3, "reconnaissance", "T1046", "True"),
    (3, "persistence", "Duplicate", "Duplicate"),
    (4, "reconnaissance", "T1046", "True"),
    (4, "exfiltration", "T1041", "True"),
    (5, "exfiltration", "Duplicate", "Duplicate"),
    (6, "discovery", "Duplicate", "Duplicate"),
    (7, "discovery", "T1", "True"),
    (7, "exfiltration", "Duplicate", "Duplicate"),
]


@pytest.mark.parametrize(
    "rule,expected",
    [
        ("primary", {1: "benign", 2: "multi_tactic", 3: "reconnaissance", 4: "multi_tactic", 5: "exfiltration", 6: "multi_tactic", 7: "multi_tactic"}),
        ("any", {1: "benign", 2: "multi_tactic", 3: "multi_tactic", 4: "multi_tactic", 5: "exfiltration", 6: "discovery", 7: "multi_tactic"}),
    ],
)
def test_consolidation_rules(spark, rule, expected):
    df = spark.createDataFrame([(*r, f"file-{i}", i) for i, r in enumerate(RECORDS)], "id int, tactic string, technique string, binary string, path string, row int")
    out = K.consolidate(df, identity=["id"], tactic="tactic", technique="technique", binary="binary", source=["path", "row"], rule=rule)
    rows = {r["id"]: r for r in out.collect()}
    assert {k: r["label"] for k, r in rows.items()} == expected
    assert rows[2]["observed_techniques"] == ["T1070"] and rows[2]["source_record_count"] == 2
    assert rows[3]["first_source"]["row"] == 3
    edges = K.source_edges(df, identity=["id"], record=["id", "tactic"], source=["path", "row"])
    assert edges.join(out, "event_id").count() == len(RECORDS)


def captures(spark, counts):
    rows, day = [], 0
    for stratum, n in counts.items():
        for _ in range(n):
            rows.append((f"day-{day:03d}", day * 86400, stratum))
            day += 1
    return spark.createDataFrame(rows, "capture_id string, start_epoch bigint, stratum string")


def test_grouped_split_per_stratum(spark):
    df = captures(spark, {"benign_only": 3, "attack_present": 10})
    out = splitting.grouped_time_split(df, holdout_epoch=12 * 86400, percentages={"train": 60, "validation": 20, "test": 20})
    split = {r["capture_id"]: r["split"] for r in out.collect()}
    assert [split[f"day-{d:03d}"] for d in range(3)] == ["train", "validation", "test"]
    assert split["day-012"] == "temporal_holdout"
    assert [split[f"day-{d:03d}"] for d in range(3, 12)] == ["train"] * 5 + ["validation"] + ["test"] * 3


def test_split_needs_three_groups_and_full_percentages(spark):
    df = captures(spark, {"benign_only": 2})
    with pytest.raises(Exception, match="at least three captures"):
        splitting.grouped_time_split(df, holdout_epoch=10**9, percentages={"train": 60, "validation": 20, "test": 20}).collect()
    with pytest.raises(ValueError, match="not to 100"):
        splitting.grouped_time_split(df, holdout_epoch=1, percentages={"train": 60, "validation": 20, "test": 10})


def labelled(spark, n=200):
    return spark.range(n).select(
        F.format_string("w-%04d", "id").alias("window_id"),
        F.when(F.col("id") % 4 == 0, "attack").otherwise("benign").alias("label"),
        F.when(F.col("id") % 10 == 9, "test").otherwise("train").alias("split"),
        (F.col("id") % 7).cast("double").alias("x"),
    )


def test_sampling_keeps_evaluation_rows_and_is_repeatable(spark):
    rows = labelled(spark)
    first, second = (
        splitting.sample_training(rows, seed=5, majority_labels=["benign"], majority_fraction=0.25) for _ in range(2)
    )
    assert splitting.table_digest(first, ["window_id"]).collect() == splitting.table_digest(second, ["window_id"]).collect()
    report = {(r["split"], r["label"]): r for r in splitting.sampling_report(rows, first).collect()}
    assert all(r["valid"] for r in report.values())
    before = report["train", "benign"]["rows_before"]
    assert report["train", "benign"]["rows_after"] == before // 4
    assert report["train", "attack"]["rows_after"] == report["train", "attack"]["rows_before"]
    other = splitting.sample_training(rows, seed=6, majority_labels=["benign"], majority_fraction=0.25)
    assert splitting.table_digest(other, ["window_id"]).collect() != splitting.table_digest(first, ["window_id"]).collect()


def test_round_robin_is_balanced_disjoint_and_complete(spark):
    rows = labelled(spark, 203)
    out = partitioning.round_robin(rows, clients=5, seed=1)
    sizes = [r["count"] for r in out.groupBy("client_id").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    check = partitioning.verify_partition(rows, out).first()
    assert (check["overlapping_rows"], check["missing_rows"], check["unexpected_rows"]) == (0, 0, 0)


def test_dirichlet_partition_meets_the_minimum(spark):
    rows = labelled(spark)
    out = partitioning.dirichlet_partition(rows, clients=4, alpha=0.5, minimum=10, seed=2)
    sizes = [r["count"] for r in out.groupBy("client_id").count().collect()]
    assert len(sizes) == 4 and min(sizes) >= 10 and sum(sizes) == 200
    with pytest.raises(ValueError):
        partitioning.dirichlet_quotas({"a": 3}, clients=4, alpha=0.5, minimum=1, seed=0)


def test_shared_table_refuses_lineage_columns(spark):
    rows = labelled(spark).withColumn("nested", F.array(F.struct(F.lit(1).alias("source_records"))))
    with pytest.raises(ValueError, match="source_records"):
        partitioning.forbid_columns(rows)
    assert partitioning.shared_table(rows, ["x"], ["window_id"]).columns == ["window_id", "x"]


def test_transforms_learn_from_training_rows_only(spark):
    train = spark.createDataFrame([(float(i), 1.0) for i in range(1, 101)], "connection_count double, flat double")
    other = spark.createDataFrame([(1e9, 1.0), (0.0, 2.0)], "connection_count double, flat double")
    names = ["connection_count", "flat"]
    for mode in transforms.MODES:
        fitted = transforms.fit_transform(train, names, mode)
        mean = transforms.apply_transform(train, names, mode, fitted).agg(F.avg("connection_count"), F.stddev_pop("connection_count"), F.avg("flat")).first()
        assert mean[0] == pytest.approx(0, abs=1e-9) and mean[1] == pytest.approx(1) and mean[2] == 0
        extreme = transforms.apply_transform(other, names, mode, fitted).orderBy("flat").collect()
        assert extreme[1]["flat"] == 1.0  # constant feature: scale one
        if mode == "log1p-winsor":
            assert extreme[0]["connection_count"] < 3
    with pytest.raises(Exception, match="must not be negative"):
        bad = spark.createDataFrame([(-1.0, 1.0)], "connection_count double, flat double")
        transforms.apply_transform(bad, names, "log1p", transforms.fit_transform(train, names, "log1p")).collect()


def test_class_weights_by_formula(spark):
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    got = lambda s: {r["label"]: r["weight"] for r in transforms.class_weights(rows, s).collect()}
    assert got("balanced") == {"a": 8 / 12, "b": 2.0}
    assert got("sqrt-balanced")["b"] == pytest.approx(2**0.5) and got("none") == {"a": 1.0, "b": 1.0}
    with pytest.raises(ValueError):
        got("other")


def test_windows_know_any_number_of_labels(spark):
    names = sorted(f"label{i:03d}" for i in range(140))
    rows = events(spark).limit(1).crossJoin(spark.createDataFrame([(names[5],), (names[70],), (names[139],)], "name string"))
    out = windows.window_features(rows.withColumn("label", F.col("name")).drop("name"), seconds=60, vocabulary=names)
    assert out.first()["observed_labels"] == [names[5], names[70], names[139]]
