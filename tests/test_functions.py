import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.functions import vectors as V


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)


def result(df, expr):
    return [r["x"] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_finite_double_and_int(spark):
    df = column(spark, ["1.5", "", "-", None, "nan", "inf", "1e999", " 7 ", "2d", "-3.9", "x", "0x10"])
    assert result(df, S.finite_double("v", -1.0)) == [
        1.5, -1.0, -1.0, -1.0, -1.0, -1.0, -1.0, 7.0, -1.0, -3.9, -1.0, -1.0,
    ]
    assert result(df, S.nonnegative_int("v")) == [1, 0, 0, 0, 0, 0, 0, 7, 0, 0, 0, 0]


def test_category_slug_tactic(spark):
    df = column(spark, ["TCP ", "-", "", None, " ", "Lateral  Movement!", "NONE", "__"])
    assert result(df, S.category("v"))[:5] == ["tcp", "missing", "missing", "missing", ""]
    assert result(df, S.slug("v"))[4:] == ["unknown", "lateral_movement", "none", "unknown"]
    assert result(df, S.tactic("v"))[6] == "benign"


def test_timestamps_need_an_offset(spark):
    df = column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "soon"])
    assert result(df, F.unix_seconds(S.parse_utc("v"))) == [1704067200, 1704067200, None, None]


def test_hash_bucket_and_digests_follow_the_byte_rules(spark):
    df = column(spark, ["a", "capture-1", "ü"])
    expected = [int.from_bytes(hashlib.sha256(f"42:{v}".encode()).digest()[:8], "big") % 100 for v in ["a", "capture-1", "ü"]]
    assert result(df, S.hash_bucket(42, "v")) == expected
    text = [hashlib.sha256(f'["{v}",""]'.encode()).hexdigest() for v in ["a", "capture-1", "ü"]]
    assert result(df, S.canonical_digest("v", F.lit(None))) == text


def test_ranges_support_and_tokens(spark):
    df = column(spark, [0, 1, 2, 5, 6, 20, 21, 100, 101], "int")
    assert result(df, S.event_count_range("v")) == ["1", "1", "2-5", "2-5", "6-20", "6-20", "21-100", "21-100", ">100"]
    assert result(df, S.support_category("v"))[:5] == ["absent", "rare", "rare", "supported", "supported"]
    scales = column(spark, [1.5, 2.0, 0.25, 10.0], "double")
    assert result(scales, S.scale_token("v")) == ["1p5", "2p0", "0p25", "10p0"]


def test_unknown_label_stops(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        column(spark, ["x"]).select(S.one_of("v", ["a", "b"])).collect()


def test_vector_functions(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0], [1.0, 1.0])], "i int, a array<double>, b array<double>")
    assert result(df, V.l2_norm("a")) == [5.0]
    assert result(df, V.subtract("a", "b")) == [[2.0, 3.0]]
    assert result(df, V.dot("a", "b")) == [7.0]
    assert result(df, V.scale("a", V.clip_factor(V.l2_norm("a"), F.lit(2.5)))) == [[1.5, 2.0]]
    assert result(df, V.clip_factor(F.lit(0.0), F.lit(2.5))) == [1.0]
    p = result(df, V.softmax("a"))[0]
    assert math.isclose(sum(p), 1.0) and math.isclose(p[1] / p[0], math.e)
    assert result(df, V.argmax("a")) == [1] and result(df, V.top_margin("a")) == [1.0]
    assert result(df, V.flatten_tensors(V.restore_tensors("a", [1, 1]))) == [[3.0, 4.0]]


def test_vector_guard(spark):
    df = spark.createDataFrame(
        [(0, [1.0, float("nan")]), (1, [1.0, 2.0]), (2, [1.0]), (3, None)], "i int, v array<double>"
    )
    assert result(df, V.is_finite_vector("v", 2)) == [False, True, False, False]
    with pytest.raises(Exception, match="not finite or not 2 wide"):
        df.select(V.checked_vector("v", 2)).collect()


@pytest.mark.parametrize("width", [3, 257])
def test_mean_vector_both_layouts(spark, width):
    rows = [("a", [1.0] * width, 1.0), ("a", [4.0] * width, 2.0), ("b", [5.0] * width, 1.0)]
    df = spark.createDataFrame(rows, "k string, v array<double>, w double")
    out = {r["k"]: r for r in V.mean_vector(df, ["k"], "v", "m", width, weight="w", count="n").collect()}
    assert out["a"]["m"] == [3.0] * width and out["a"]["n"] == 2 and out["b"]["m"][0] == 5.0
