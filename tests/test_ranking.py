import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators.ranking import _slot_of, exact_quantiles, hash_ranked


def test_hash_rank_matches_a_full_sort_with_a_hot_group(spark):
    rows = [("hot", f"id-{i}") for i in range(3000)] + [("small", f"s-{i}") for i in range(5)] + [(None, "n")]
    df = spark.createDataFrame(rows, "g string, id string")
    got = hash_ranked(df, groups=["g"], digest=S.seeded_digest(3, "id"), tie="id", total="n").collect()
    for group in ("hot", "small", None):
        ids = [i for g, i in rows if g == group]
        ordered = sorted(ids, key=lambda i: (hashlib.sha256(f"3:{i}".encode()).hexdigest(), i))
        mine = sorted((r["hash_rank"], r["id"]) for r in got if r["g"] == group)
        assert [i for _, i in mine] == ordered
        assert [r for r, _ in mine] == list(range(1, len(ids) + 1))
        assert {r["n"] for r in got if r["g"] == group} == {len(ids)}


@pytest.mark.parametrize("slots,levels", [(2048, 2), (4, 1), (4, 3)])
def test_quantiles_match_numpy_on_skewed_values(spark, slots, levels):
    rng = np.random.default_rng(1)
    values = {
        "heavy": np.concatenate([rng.exponential(1.0, 400), 10 ** rng.uniform(0, 9, 50)]),
        "copies": np.concatenate([np.full(700, 3.25), rng.normal(0, 1, 20)]),
        "constant": np.full(9, -2.0),
        "single": np.array([7.5]),
        "signed": rng.normal(-5, 100, 333),
    }
    df = spark.createDataFrame(
        [(k, float(x)) for k, xs in values.items() for x in xs] + [("heavy", None)], "k string, x double"
    )
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    out = exact_quantiles(df, keys=["k"], value="x", probabilities=probabilities, slots=slots, levels=levels)
    rows = out.collect()
    assert len(rows) == len(values) * len(probabilities)
    for r in rows:
        assert r["quantile"] == pytest.approx(np.quantile(values[r["k"]], r["probability"]), rel=1e-12, abs=1e-12)


def test_quantiles_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    out = exact_quantiles(df, keys=[], value="x", probabilities=[0.5, 0.255])
    assert {round(r["probability"], 3): r["quantile"] for r in out.collect()} == {0.5: 50.0, 0.255: pytest.approx(25.5)}


def test_slots_stay_small_with_outliers(spark):
    random = np.random.default_rng(9)
    values = [*np.round(random.lognormal(8, 1.5, 20000), 3).tolist(), 1e15, 4e11, -3e9, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    low, high = F.lit(min(values)), F.lit(max(values))
    slots = df.groupBy(_slot_of(F.col("v"), low, high, 2048)).count()
    assert slots.agg(F.max("count")).first()[0] < 500
    got = {r["probability"]: r["quantile"] for r in exact_quantiles(df, keys=[], value="v", probabilities=[0.01, 0.5, 0.999]).collect()}
    assert got == {p: pytest.approx(np.quantile(values, p)) for p in (0.01, 0.5, 0.999)}
