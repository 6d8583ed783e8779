import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.operators import errors as E
from tracelight.operators import evaluation as M
from tracelight.operators import runs as R


def from_matrix(spark, labels, matrix):
    rows = [(a, p) for a, line in zip(labels, matrix) for p, n in zip(labels, line) for _ in range(n)]
    return spark.createDataFrame(rows, "actual string, predicted string")


def test_false_alarms_by_hand(spark):
    labels = ["attack", "benign", "other"]
    matrix = M.confusion_matrix(from_matrix(spark, labels, [[3, 1, 0], [5, 33, 2], [1, 0, 6]]), labels)
    r = M.false_alarms(matrix, "benign").first()
    assert (r["actual_benign_count"], r["false_alarm_count"], r["false_alarm_rate"]) == (40, 7, 0.175)
    assert M.false_alarms(matrix, "nobody").first()["false_alarm_rate"] is None


def test_metrics_with_an_empty_class(spark):
    labels, matrix = ["a", "b", "never"], np.array([[6, 2, 0], [1, 3, 0], [0, 0, 0]])
    dense = M.confusion_matrix(from_matrix(spark, labels, matrix), labels)
    assert dense.count() == 9
    per = {r["class"]: r for r in M.class_metrics(dense).collect()}
    assert per["never"]["f1"] == per["never"]["precision"] == 0.0
    p, rec = 6 / 7, 6 / 8
    assert per["a"]["f1"] == pytest.approx(2 * p * rec / (p + rec))
    o = M.overall_metrics(M.class_metrics(dense)).first()
    assert o["accuracy"] == 0.75 and o["observed_class_count"] == 2
    assert o["balanced_accuracy"] == pytest.approx((0.75 + 0.75) / 2)
    assert o["macro_f1"] == pytest.approx((per["a"]["f1"] + per["b"]["f1"]) / 3)


def test_log_loss_and_integrity(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.25, 3.0), (0.0, 0.0)], "p double, w double")
    r = M.log_loss(rows, "p", "w").first()
    assert r["weighted_log_loss"] == pytest.approx((np.log(2) + 3 * np.log(4)) / 4)
    assert r["log_loss"] == pytest.approx((np.log(2) + np.log(4) + 52 * np.log(2)) / 3)
    matrix = M.confusion_matrix(from_matrix(spark, ["s", "t", "o"], [[5, 3, 2], [0, 1, 0], [0, 0, 1]]), ["s", "t", "o"])
    i = M.source_integrity(matrix, "s", "t").first()
    assert (i["correct_rows"], i["targeted_rows"], i["other_rows"]) == (5, 3, 2)
    assert i["source_recall"] == 0.5 and i["targeted_rate"] == 0.3


# window, capture, label, features, events, predicted
ROWS = [
    ("w01", "x", "scan", 1.0, 0.5, 2.0, 3, "scan"),
    ("w02", "x", "scan", 1.5, 0.0, 2.5, 1, "scan"),
    ("w03", "y", "scan", 5.0, 4.0, 2.0, 40, "theft"),
    ("w04", "y", "theft", 6.0, 4.5, 1.0, 7, "theft"),
    ("w05", "z", "theft", 5.0, 5.5, 2.0, 150, "theft"),
    ("w06", "z", "theft", 1.0, 1.0, 2.0, 2, "scan"),
    ("w07", "z", "login", 9.0, 0.5, 7.0, 1, "login"),
    ("w08", "x", "login", 8.0, 1.5, 7.5, 60, "login"),
    ("w09", "y", "login", 5.5, 4.0, 3.0, 5, "theft"),
    ("w10", "x", "login", 8.5, 1.0, 6.5, 9, "login"),
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "window_id string, capture_id string, actual string, f0 double, f1 double, f2 double, events int, predicted string")


def test_error_rates(rows):
    assert {r["capture_id"]: r["error_rate"] for r in E.error_summary(rows, ["capture_id"]).collect()} == {"x": 0.0, "y": pytest.approx(2 / 3), "z": pytest.approx(1 / 3)}
    by = {r["event_range"]: (r["row_count"], r["error_count"]) for r in E.rates_by_range(rows, "events").collect()}
    assert by == {"1": (2, 0), "2-5": (3, 2), "6-20": (2, 0), "21-100": (2, 1), ">100": (1, 0)}


def test_pairs_need_both_directions(rows):
    pairs = E.bidirectional_pairs(E.transitions(rows)).collect()
    assert [tuple(p) for p in pairs] == [("scan", "theft", 2)]


def test_drift_names_the_closer_class(rows):
    standard = rows.select("*", *[(F.col(f"f{i}") - 1).alias(f"z{i}") for i in range(3)])
    drift = {(r["actual"], r["predicted"], r["feature"]): r for r in E.feature_drift(standard, ["z0", "z1", "z2"]).collect()}
    r = drift["scan", "theft", "z0"]
    assert r["error_mean"] == pytest.approx(4) and r["true_mean"] == pytest.approx(0.25) and r["predicted_mean"] == pytest.approx(4.5)
    assert r["closeness_delta"] == pytest.approx(3.75 - 0.5)
    s = {(x["actual"], x["predicted"]): x for x in E.drift_summary(standard, ["z0", "z1", "z2"]).collect()}
    assert s["scan", "theft"]["status"] == "analyzed"
    expected = np.linalg.norm(np.array([5.0, 4.0, 2.0]) - np.array([1.25, 0.25, 2.25]))
    assert s["scan", "theft"]["distance_to_true"] == pytest.approx(expected)
    lonely = E.drift_summary(standard.where("window_id NOT IN ('w04', 'w05')"), ["z0"])
    assert {x["status"] for x in lonely.where("predicted = 'theft'").collect()} == {"insufficient-correct-reference-rows"}


def test_ambiguous_groups_with_a_hot_vector(spark):
    many = [(f"w{i:04d}", "a" if i % 3 else "b", "a", "c1", 1.0) for i in range(600)] + [("x", "a", "a", "c2", 2.0)]
    df = spark.createDataFrame(many, "window_id string, actual string, predicted string, capture_id string, f double")
    g = E.ambiguous_groups(df, ["f"]).collect()
    assert len(g) == 1 and g[0]["row_count"] == 600 and g[0]["error_count"] == 200 and g[0]["labels"] == "a=400,b=200"
    assert g[0]["example_ids"] == [f"w{i:04d}" for i in range(5)]
    totals = E.ambiguity_totals(E.ambiguous_groups(df.where("f = 2"), ["f"])).first()
    assert (totals["ambiguous_group_count"], totals["ambiguous_row_count"]) == (0, 0)


def test_error_records_are_checked(rows):
    records = rows.where("actual <> predicted").select("window_id", "capture_id", "actual")
    changed = records.withColumn("capture_id", F.when(F.col("window_id") == "w09", "z").otherwise(F.col("capture_id")))
    r = E.check_error_records(changed, rows, "window_id", ["capture_id", "actual"]).first()
    assert (r["record_count"], r["absent_count"], r["repeated_count"], r["capture_id_mismatches"], r["actual_mismatches"]) == (3, 0, 0, 1, 0)


def test_best_rows_and_ties(spark):
    rounds = spark.createDataFrame([("x", 1, 0.81), ("x", 2, 0.88), ("x", 3, 0.84), ("y", 4, 0.91), ("y", 7, 0.91)], "run string, round int, f1 double")
    assert {r["run"]: r["round"] for r in R.best_round(rounds, ["run"], "f1").collect()} == {"x": 2, "y": 4}
    assert R.best_profile(rounds, [], "f1", "run").first()["run"] == "y"
    history = spark.createDataFrame([(1, 1.0, 0.9, 0.5), (2, 0.8, 0.7, 0.6), (3, 0.5, 0.7, 0.6), (4, 0.3, 0.9, 0.6)], "epoch int, train_loss double, validation_loss double, validation_f1 double")
    r = R.best_epoch(history, []).first()
    assert (r["best_loss_epoch"], r["best_f1_epoch"], r["final_epoch"], r["possible_overfit"]) == (2, 2, 4, True)


def test_summaries_of_single_runs(spark):
    runs = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.7, 3.0), ("b", 0.9, None)], "variant string, f1 double, loss double")
    r = {x["variant"]: x for x in R.run_summary(runs, "variant", ["f1"]).collect()}
    assert r["a"]["f1_sample_std"] == pytest.approx(np.std([0.5, 0.7], ddof=1)) and r["b"]["f1_sample_std"] == 0.0
    s = {(x["variant"], x["metric"]): x for x in R.metric_summary(runs, ["variant"], ["f1", "loss"]).collect()}
    assert s["b", "loss"]["value_count"] == 0 and s["b", "loss"]["mean"] is None
    assert s["a", "loss"]["population_stddev"] == 1.0


def test_margin_histogram_bins(spark):
    df = spark.createDataFrame([("a", "b", i / 10) for i in range(11)] + [("b", "a", 0.5)] * 2, "actual string, predicted string, m double")
    out = E.margin_histogram(df, "m").collect()
    ab = {r["bin"]: r["error_count"] for r in out if r["actual"] == "a"}
    assert sum(ab.values()) == 11 and max(ab) == 10 and {r["bin_count"] for r in out if r["actual"] == "a"} == {11}
    assert [(r["bin_count"], r["bin"]) for r in out if r["actual"] == "b"] == [(4, 2)]
