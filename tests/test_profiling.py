import pytest
from pyspark.sql import functions as F

from tracelight.operators import profiling as P
from tracelight.operators.selection import equal_tables, perturb_fraction, relabel, triggered_set, unknown_labels
from tracelight.plans import catalog
from tracelight.session import UNSAFE_RULE, prepare, shared_directory


def records(spark):
    rows = [("a", "benign", 1), ("a", "benign", 1), ("a", "attack", 1), ("b", "attack", 5), ("", "-", 9), (None, "attack", 9)]
    return spark.createDataFrame(rows, "k string, label string, at int")


def test_duplicates_text_and_number_keys_agree(spark):
    df = records(spark).withColumn("n", F.coalesce(F.ascii("k"), F.lit(0)))
    for identity in (["k"], ["n"]):
        r = P.duplicate_summary(df, ["k", "label", "at"], identity).first()
        assert (r["row_count"], r["exact_duplicate_rows"], r["distinct_identities"]) == (6, 1, 3)
        got = {tuple(x["labels"]): x["identity_count"] for x in P.conflicting_labels(df, identity, "label").collect()}
        assert got == {("attack", "benign"): 1, ("-", "attack"): 1}


def test_missing_values(spark):
    got = {r["column_name"]: (r["missing_count"], r["missing_rate"]) for r in P.missing_profile(records(spark), ["k", "label"]).collect()}
    assert got == {"k": (2, 2 / 6), "label": (1, 1 / 6)}


def test_temporal_separation_and_risks(spark):
    apart = spark.createDataFrame([("benign", 1), ("benign", 2), ("attack", 3)], "label string, at int")
    assert P.temporal_separation(apart, "label", "at").first()["separated"]
    mixed = records(spark).withColumn("technique", F.lit(" Duplicate"))
    flags = {r["risk"]: (r["present"], r["evidence_count"]) for r in P.risk_flags(mixed, identity=["k"], label="label", moment="at", technique="technique").collect()}
    assert flags == {"time-label": (False, 0), "cross-label": (True, 2), "duplicate-marker": (True, 6), "rare-class": (True, 3)}


def test_selection_operators(spark):
    df = spark.range(40).select(F.format_string("w%02d", "id").alias("window_id"), F.lit("x").alias("label"), F.lit(0.0).alias("f"))
    marked = perturb_fraction(df, values={"f": 9.0}, target="y", fraction=0.11, seed=1)
    assert marked.where("perturbed").count() == 5 and marked.where("f = 9 AND label = 'y'").count() == 5
    assert relabel(df, "x", "z").where("relabelled AND label = 'z'").count() == 40
    assert triggered_set(df, values={"f": 2.0}, target="x").count() == 0
    assert [r[0] for r in unknown_labels(marked, df).collect()] == ["y"]
    gap = equal_tables(df, df.unionByName(df.limit(2)), ["window_id", "f"]).first()
    assert (gap["only_left"], gap["only_right"]) == (0, 2)


def test_session_and_stored_tables(spark, tmp_path):
    before = spark.conf.get("spark.sql.optimizer.excludedRules")
    prepare(spark)
    assert spark.conf.get("spark.sql.optimizer.excludedRules") == before and UNSAFE_RULE in before
    calls = []
    tables = catalog.Tables(spark, str(tmp_path))
    for _ in range(2):
        df = tables.stored("numbers", lambda t: calls.append(1) or spark.range(3))
        assert df.count() == 3
    assert calls == [1]


class Cluster:
    """Just the settings of a session that runs on a cluster."""

    def __init__(self, **settings):
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": "yarn"})


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_directory(Cluster(**{"spark.checkpoint.dir": "/shared/x"}), "t").startswith("/shared/x/t-")
    with pytest.raises(RuntimeError, match="shared folder"):
        shared_directory(Cluster(), "t")


def test_stored_sketches_merge_and_subtract(spark):
    rows = spark.range(6000).select(F.expr("CASE WHEN id < 4000 THEN 'a' ELSE 'b' END").alias("file"), F.expr("id % 3000").alias("k"))
    for size in (8, 16):
        parts = P.identity_sketches(rows, ["file"], ["k"], size)
        got = {r["file"]: (r["row_count"], r["n"]) for r in parts.select("*", F.theta_sketch_estimate("sketch").alias("n")).collect()}
        whole = P.merged_sketches(parts, size_log2=size).select("row_count", F.theta_sketch_estimate("sketch")).first()
        a, b = ({r["file"]: r["sketch"] for r in parts.collect()}[f] for f in "ab")
        one = spark.createDataFrame([(a, b)], "a binary, b binary")
        rest = one.select(F.theta_sketch_estimate(P.only_in_first("a", "b"))).first()[0]
        bound = lambda part, union: spark.range(1).select(P.sketch_bound(F.lit(size), F.lit(part), F.lit(union))).first()[0]
        assert got["a"][0] == 4000 and got["b"][0] == 2000 and whole[0] == 6000
        for found, true, union in ((got["a"][1], 3000, 3000), (got["b"][1], 2000, 2000), (whole[1], 3000, 3000), (rest, 1000, 3000)):
            assert abs(found / true - 1) <= bound(true, union)
    assert bound(3000, 3000) == 0.0


def test_null_identities_count_and_an_empty_table_has_no_sketch(spark):
    rows = spark.createDataFrame([("f", None), ("f", "x"), ("f", None)], "file string, k string")
    parts = P.identity_sketches(rows, ["file"], ["k"])
    assert parts.select("row_count", F.theta_sketch_estimate("sketch")).first()[:] == (3, 2)
    assert P.identity_sketches(rows.limit(0), ["file"], ["k"]).count() == 0
