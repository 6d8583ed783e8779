"""Selection by histograms equals selection in one group, and large groups never meet in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.operators import prototypes as P
from tracelight.operators import ranking as K
from tracelight.operators import robust as R


@pytest.fixture(scope="module")
def updates(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(17, 20)).round(2)
    rows[:, 3] = 1.0
    rows[:6, 5] = 0.25
    rows[2] = rows[9]
    rows = [(f"c{i:02d}", r.tolist(), ["a", "b"][i % 2], i + 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "client_id string, vector array<double>, class string, support long").cache()


def near(left, right, keys):
    a, b = (sorted(map(tuple, d.select(*keys, *[c for c in sorted(left.columns) if c not in keys]).collect())) for d in (left, right))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(p == q if isinstance(p, str) else p == pytest.approx(q, abs=1e-9) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("strategy", ["coordinate_median", "trimmed_mean", "bulyan"])
def test_aggregates_are_the_same_both_ways(updates, strategy):
    both = [R.aggregate_updates(updates, "vector", strategy, clients=17, f=3, small_group=g) for g in (0, 10**6)]
    near(*both, ["pos"])


def test_indicators_and_thresholds_are_the_same_both_ways(updates):
    near(*[R.update_indicators(updates, "vector", g) for g in (0, 10**6)], ["client_id"])
    near(*[R.clip_threshold(updates, "vector", g) for g in (0, 10**6)], [])
    near(*[P.prototype_indicators(updates, g) for g in (0, 10**6)], ["client_id"])
    kept = [
        P.aggregate_prototypes(updates, ["a", "b"], strategy="coordinate_median", quorum=2, width=20, small_group=g)
        .select("class", F.explode("vector").alias("v")) for g in (0, 10**6)
    ]
    near(*kept, ["class"])


def test_a_million_clients_never_meet(spark):
    n = 1_000_000
    noise = (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10**9)) / 10**9).cast("double")
    rows = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    # one coordinate is spread out, the other lies within a millionth of one value
    rows = rows.withColumn("value", F.when(F.col("pos") == 0, noise * 1000 - 500).otherwise(F.lit(7.0) + noise * 1e-6))
    counts, ranges = K._narrowed(rows, ["pos"], "value", lambda r: F.array(F.floor((r - 1) / 2)), 2048, 2)
    inside = K._inside(counts, ranges, ["pos"]).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(inside) == 2 and max(r["n"] for r in inside) < 1000
    values = np.array([(r["pos"], r["value"]) for r in rows.select("pos", "value").toPandas().to_dict("records")])
    found = {r["pos"]: r["m"] for r in K.medians(rows, ["pos"], "value", "m").collect()}
    for pos in (0, 1):
        assert found[pos] == pytest.approx(np.median(values[values[:, 0] == pos][:, 1]), rel=1e-12)


def test_few_clients_use_many_tasks(spark):
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(15, 4000))
    rows = spark.createDataFrame([(f"c{i}", r.tolist()) for i, r in enumerate(wide)], "client_id string, v array<double>")
    got = {r["client_id"]: r["krum_score"] for r in R.krum_scores(rows, "v", f=3, clients=15, tile_rows=4).collect()}
    gaps = ((wide[:, None] - wide[None]) ** 2).sum(axis=2)
    for i in range(15):
        assert got[f"c{i}"] == pytest.approx(np.sort(np.delete(gaps[i], i))[:10].sum())
    with pytest.raises(Exception, match="4000 wide"):
        R.krum_scores(rows.union(rows.limit(1).select(F.lit("x"), F.array(F.lit(1.0)))), "v", f=3, clients=16).collect()
