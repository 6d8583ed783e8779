import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.functions import vectors as V
from tracelight.operators import prototypes as P
from tracelight.operators import robust as R


def updates(spark, matrix, weights=None):
    rows = [(f"client{i + 1:02d}", [float(x) for x in v], float(weights[i]) if weights else 1.0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "client_id string, v array<double>, w double")


def aggregate(df, strategy, **options):
    rows = R.aggregate_updates(df, "v", strategy, **options).orderBy("pos").collect()
    return np.array([r["value"] for r in rows])


def scores(m, f):
    d = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
    n = len(m)
    return np.array([np.sort(np.delete(d[i], i))[: n - f - 2].sum() for i in range(n)])


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(7)
    m = rng.normal(0, 1, (12, 9))
    m[3] += 40
    m[5] = m[4]
    return m


def test_bounds_fail_before_any_job():
    for strategy, f in (("multikrum", 2), ("bulyan", 1), ("trimmed_mean", 3)):
        with pytest.raises(R.BoundError):
            R.check_bound(strategy, 5, f)
    with pytest.raises(R.BoundError):
        R.check_bound("multikrum", 7, 2, keep=4)


def test_aggregators_match_numpy(spark, matrix):
    weights = list(range(1, 13))
    df = updates(spark, matrix, weights)
    f, n = 2, 12
    np.testing.assert_allclose(aggregate(df, "fedavg", clients=n, weight="w"), np.average(matrix, axis=0, weights=weights))
    np.testing.assert_allclose(aggregate(df, "coordinate_median", clients=n), np.median(matrix, axis=0))
    np.testing.assert_allclose(aggregate(df, "trimmed_mean", clients=n, f=f), np.sort(matrix, axis=0)[f : n - f].mean(axis=0))
    order = np.lexsort((np.arange(n), scores(matrix, f)))
    np.testing.assert_allclose(aggregate(df, "multikrum", clients=n, f=f), matrix[order[: n - f - 2]].mean(axis=0))
    np.testing.assert_allclose(aggregate(df, "multikrum", clients=n, f=f, keep=3), matrix[order[:3]].mean(axis=0))
    kept = matrix[order[: n - 2 * f]]
    off = np.abs(kept - np.median(kept, axis=0))
    near = np.argsort(off, axis=0, kind="stable")[: n - 4 * f]
    np.testing.assert_allclose(aggregate(df, "bulyan", clients=n, f=f), np.take_along_axis(kept, near, axis=0).mean(axis=0))


@pytest.mark.parametrize("tile_rows", [1, 3, 5, 256])
def test_krum_scores_do_not_depend_on_tiles(spark, matrix, tile_rows):
    out = R.krum_scores(updates(spark, matrix), "v", f=3, clients=12, tile_rows=tile_rows)
    got = [r["krum_score"] for r in out.orderBy("client_id").collect()]
    np.testing.assert_allclose(got, scores(matrix, 3), rtol=1e-10)


def test_wrong_client_count_stops(spark, matrix):
    with pytest.raises(Exception, match="expected 11 clients, got 12"):
        R.krum_scores(updates(spark, matrix), "v", f=2, clients=11).collect()


def test_bad_weights_stop(spark):
    with pytest.raises(Exception, match="positive and finite"):
        aggregate(updates(spark, [[1.0], [2.0]], [1, 0]), "fedavg", clients=2, weight="w")


def test_indicators_single_out_the_attacker(spark):
    m = np.array([[v, v + 1, v] for v in (0.0, 0.1, -0.1, 50.0)])
    rows = R.update_indicators(updates(spark, m), "v").orderBy("client_id").collect()
    assert rows[3]["relative_norm"] > 10 and rows[3]["mad_score"] > rows[0]["mad_score"]
    median = np.median(m, axis=0)
    for r, v in zip(rows, m):
        assert r["delta_l2"] == pytest.approx(np.linalg.norm(v))
        assert r["coordinate_median_distance"] == pytest.approx(np.linalg.norm(v - median))
        assert r["cosine_to_median"] == pytest.approx(v @ median / np.linalg.norm(v) / np.linalg.norm(median))


def test_clip_threshold_falls_back_to_the_largest_norm(spark):
    r = R.clip_threshold(updates(spark, [[0.0], [0.0], [0.0], [5.0]]), "v").first()
    assert r["median_l2"] == 0 and r["max_norm"] == 5.0
    r = R.clip_threshold(updates(spark, [[1.0], [2.0], [3.0], [10.0]]), "v").first()
    assert (r["median_l2"], r["mad_l2"], r["max_norm"]) == (2.5, 1.0, 5.5)


def test_duplicate_groups_stay_linear(spark):
    df = updates(spark, [[1.0, -0.0]] * 40 + [[2.0, 0.0]] + [[1.0, 0.0]])
    out = R.duplicate_updates(df, "v")
    assert out.count() == 42
    s = R.duplicate_summary(out).first()
    assert (s["unique_update_count"], s["exact_duplicate_group_count"], s["largest_group_size"]) == (2, 1, 41)


def test_prototypes_need_support(spark):
    rows = [("c1", "reconnaissance", [1.0, 2.0]), ("c1", "reconnaissance", [3.0, 4.0]), ("c1", "reconnaissance", [5.0, 6.0]), ("c1", "rare", [0.0, 0.0]), ("c1", "rare", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "client_id string, class string, v array<double>")
    protos, supports = P.local_prototypes(df, "v", 2, 3, ["reconnaissance", "rare", "never"])
    assert [(r["class"], r["support"], r["vector"]) for r in protos.collect()] == [("reconnaissance", 3, [3.0, 4.0])]
    assert {r["class"]: r["support"] for r in supports.collect()} == {"reconnaissance": 3, "rare": 2, "never": 0}


def submissions(spark):
    rows = [("c1", "a", 1, [0.0, 0.0]), ("c2", "a", 3, [4.0, 8.0]), ("c3", "a", 1, [100.0, 100.0]), ("c1", "b", 5, [1.0, 1.0])]
    return spark.createDataFrame(rows, "client_id string, class string, support bigint, vector array<double>")


def test_prototype_aggregation_quorum_and_carry_forward(spark):
    rows = submissions(spark)
    mean = {r["class"]: r for r in P.aggregate_prototypes(rows, ["a", "b", "c"], strategy="support_weighted_mean", quorum=2, width=2).collect()}
    assert mean["a"]["vector"] == [22.4, 24.8] and mean["b"]["status"] == "insufficient_quorum" and mean["b"]["vector"] is None
    median = P.aggregate_prototypes(rows, ["a", "b", "c"], strategy="coordinate_median", quorum=2, width=2)
    assert {r["class"]: r["vector"] for r in median.collect()}["a"] == [4.0, 8.0]
    before = spark.createDataFrame([("b", [9.0, 9.0])], "class string, vector array<double>")
    out = {r["class"]: r for r in P.carry_forward(median, before).collect()}
    assert [out[c]["status"] for c in "abc"] == ["aggregated", "retained_previous", "unavailable"]
    assert out["b"]["vector"] == [9.0, 9.0] and out["c"]["vector"] is None


def test_low_support_stops_or_is_skipped(spark):
    options = dict(strategy="support_weighted_mean", quorum=1, width=2, minimum_support=2)
    with pytest.raises(Exception, match="below the declared support"):
        P.aggregate_prototypes(submissions(spark), ["a"], **options).collect()
    kept = P.aggregate_prototypes(submissions(spark), ["a"], skip_low_support=True, **options).first()
    assert kept["supporting_client_count"] == 1 and kept["vector"] == [4.0, 8.0]


def test_nearest_prototype_paths_agree(spark, matrix):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (7, 9))
    protos = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)] + [(99, None)], "class int, vector array<double>")
    rows = updates(spark, matrix).select("client_id", "v")
    distances = np.linalg.norm(matrix[:, None, :] - centers[None, :, :], axis=2)
    ways = [P.nearest_prototypes(rows, protos, "v")] + [P.nearest_indexed(rows, protos, "v", "client_id", size=s) for s in (1, 3, 100)]
    for way in ways:
        out = way.orderBy("client_id").collect()
        assert [r["nearest_class"] for r in out] == distances.argmin(axis=1).tolist()
        ordered = np.sort(distances, axis=1)
        np.testing.assert_allclose([r["distance_margin"] for r in out], ordered[:, 1] - ordered[:, 0])
    one = P.nearest_prototypes(rows, protos.where("class = 2"), "v").first()
    assert one["nearest_class"] == 2 and one["distance_margin"] is None


def test_wide_vectors_use_the_long_layout(spark):
    width = 306
    m = np.arange(3 * width, dtype=float).reshape(3, width)
    out = V.mean_vector(updates(spark, m), [], "v", "m", width).first()["m"]
    np.testing.assert_allclose(out, m.mean(axis=0))


@pytest.mark.parametrize("count", [10, 900])
def test_listed_and_indexed_prototypes_give_the_same_ranks(spark, count):
    random = np.random.default_rng(8)
    points = random.normal(size=(count, 3)).round(1).tolist()  # with ties
    protos = spark.createDataFrame([(f"k{i:04d}", p) for i, p in enumerate(points)] + [("none", None)], "class string, vector array<double>")
    rows = [(f"r{i}", random.normal(size=3).round(1).tolist(), f"k{i % count:04d}") for i in range(30)] + [("x", points[3], "none"), ("y", [90.0, 0.0, 1.0], "k0007")]
    rows = spark.createDataFrame(rows, "id string, v array<double>, own string")
    columns = ["id", "nearest_class", "nearest_distance", "second_class", "distance_margin"]
    listed = P.nearest_prototypes(rows, protos, "v").select(*columns, P.class_rank("distances", "own").alias("class_rank"))
    want = [(*r[:5], r["class_rank"] or None) for r in listed.collect()]
    for size in (4, 64, 5000):
        got = P.nearest_indexed(rows, protos, "v", "id", rank_of="own", size=size).select(*columns, "class_rank")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_hundred_thousand_prototypes(spark):
    random = np.random.default_rng(9)
    points = random.normal(size=(100_000, 4))
    protos = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "class int, vector array<double>").repartition(8)
    queries = random.normal(size=(40, 4))
    rows = spark.createDataFrame([(i, q, i * 7) for i, q in enumerate(queries.tolist())], "id int, v array<double>, own int")
    far = np.linalg.norm(queries[:, None] - points[None], axis=2)
    got = sorted(P.nearest_indexed(rows, protos, "v", "id", rank_of="own").collect(), key=lambda r: r["id"])
    order = far.argsort(axis=1)
    assert [r["nearest_class"] for r in got] == order[:, 0].tolist() and [r["second_class"] for r in got] == order[:, 1].tolist()
    assert [r["class_rank"] for r in got] == [int((far[i] < far[i, 7 * i]).sum()) + 1 for i in range(40)]
    tiles, _ = P.prototype_index(protos)
    sizes = [r[0] for r in tiles.select(F.size("_members")).collect()]
    assert sum(sizes) == 100_000 and len(sizes) <= 1024 and max(sizes) < 600
    with pytest.raises(ValueError, match="nearest_indexed"):
        P.nearest_prototypes(rows, protos, "v")


def test_ragged_vectors_stop_a_mean(spark):
    ragged = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0, 3.0])], "k string, v array<double>")
    for width in (2, 3, 300):
        with pytest.raises(Exception, match="not finite or not"):
            V.mean_vector(ragged, ["k"], "v", "m", width).collect()


def test_rows_meet_a_tile_in_blocks_whatever_their_vectors_hold(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    random = np.random.default_rng(4)
    odd = [[1.0, None, 2.0], [float("nan"), 0.0, 1.0], [1.0, 2.0], [float("inf"), 0.0, 0.0]]
    points = random.normal(size=(60, 3)).round(1).tolist() + odd
    protos = spark.createDataFrame(list(enumerate(points)), "class long, vector array<double>")
    asked = [(f"r{i}", p, i) for i, p in enumerate(points)] + [("no", None, 3), ("other", [0.0, 0.0, 0.0], None)]
    rows = spark.createDataFrame(asked, "id string, v array<double>, own long")
    plain, strange = protos.where("class < 60"), P._visited
    columns = ["id", "nearest_class", "nearest_distance", "second_class", "distance_margin"]
    listed = P.nearest_prototypes(rows, plain, "v").select(*columns, F.when(F.col("own") < 60, P.class_rank("distances", "own")).alias("r"))
    got = P.nearest_indexed(rows, plain, "v", "id", rank_of="own", size=16).select(*columns, "class_rank")
    whole = {f"r{i}" for i in range(60)} | {"other"}
    pick = lambda df: sorted((tuple(r) for r in df.collect() if r[0] in whole), key=str)
    assert pick(got) == pick(listed)
    tile = protos.agg(F.array_sort(F.collect_list(F.struct("class", "vector"))).alias("_members")).withColumn("_tile", F.lit(0))
    visits = rows.join(protos.select(F.col("class").alias("own"), F.col("vector").alias("o")), "own", "left")
    visits = visits.select("id", F.col("v").alias("_v"), F.col("own").alias("_own"), V.l2_distance("v", "o").alias("_own_far"), F.lit(0).alias("_tile"))
    met = {r["id"]: (str(r["_two"]), r["_nearer"]) for r in strange(visits, tile.select("_tile", "_members"), "id").collect()}
    ranked = visits.join(tile, "_tile").withColumn("all", P._distances(F.col("_v"), F.col("_members")))
    mine = F.struct(F.col("_own_far").alias("distance"), F.col("_own").alias("class"))
    nearer = F.when(F.col("_own_far").isNotNull(), F.size(F.filter("all", lambda p: p < mine)))
    want = ranked.select("id", F.slice("all", 1, 2).alias("two"), nearer.alias("n")).collect()
    assert met == {r["id"]: (str(r["two"]), r["n"]) for r in want}


def test_rows_that_meet_all_tiles_are_not_copied_for_each(spark):
    random = np.random.default_rng(12)
    points = random.normal(size=(1500, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]  # equal norms, equally far from the pivot: no tile can be ruled out
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "id long, v array<double>").repartition(4)
    protos = rows.where("id % 2 = 0").select(F.col("id").alias("class"), F.col("v").alias("vector"))
    files = lambda: {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    near = P.nearest_indexed(rows.withColumn("own", F.col("id")), protos, "v", "id", rank_of="own", size=8).collect()
    written = sum(size for path, size in files().items() if path not in before)
    assert written < 12 * points.nbytes  # 129 times with a copy of the rows for each tile, 5.5 without
    far = np.linalg.norm(points[:, None] - points[None, ::2], axis=2)
    order = far.argsort(axis=1) * 2
    got = {r["id"]: r for r in near}
    assert [(got[i]["nearest_class"], got[i]["second_class"], got[i]["class_rank"]) for i in range(1500)] == [(a, b, None if i % 2 else 1) for i, (a, b) in enumerate(order[:, :2].tolist())]


@pytest.mark.parametrize(("size", "page"), [(4, 7), (64, 2048)])
def test_equal_vectors_and_repeated_classes_keep_their_order(spark, monkeypatch, size, page):
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "PAGE", page)
    random = np.random.default_rng(3)
    few = random.normal(size=(6, 3))
    members = [(None if i % 50 == 7 else int(i // 2 * 2 if i < 40 else i), few[random.integers(6)].tolist()) for i in range(240)]
    protos = spark.createDataFrame(members, "class long, vector array<double>")
    asked = [(i, (few[i % 6] if i % 3 else random.normal(size=3)).tolist(), None if i % 9 == 0 else 41 + int(random.integers(220))) for i in range(60)]
    rows = spark.createDataFrame(asked, "id long, v array<double>, own long")
    got = {r["id"]: r for r in P.nearest_indexed(rows, protos, "v", "id", rank_of="own", size=size).collect()}
    vectors = dict(members)
    key = lambda d, c: (d, c is not None, c or 0)
    apart = lambda a, b: float(np.sqrt(np.cumsum((np.array(a) - np.array(b)) ** 2)[-1]))
    for i, v, own in asked:
        ranked = sorted(key(apart(v, m), c) for c, m in members)
        first, second = (c if there else None for _, there, c in ranked[:2])
        mine = None if own is None or own not in vectors else key(apart(v, vectors[own]), own)
        rank = None if mine is None else sum(k < mine for k in ranked) + 1
        assert (got[i]["nearest_class"], got[i]["second_class"], got[i]["nearest_distance"], got[i]["class_rank"]) == (first, second, ranked[0][0], rank)


def test_without_prototypes_nothing_is_near(spark):
    protos = spark.createDataFrame([], "class long, vector array<double>")
    rows = spark.createDataFrame([(1, [0.5, 1.0], 3), (2, None, None), (None, [1.0, 1.0], 1)], "id long, v array<double>, own long")
    got = P.nearest_indexed(rows, protos, "v", "id", rank_of="own").collect()
    assert sorted((r["id"] or 0, r["nearest_class"], r["distance_margin"], r["class_rank"]) for r in got) == [(0, None, None, None), (1, None, None, None), (2, None, None, None)]
    some = spark.createDataFrame([(7, [0.0, 0.0])], "class long, vector array<double>")
    none = P.nearest_indexed(rows.where("id > 5"), some, "v", "id").collect()
    one = P.nearest_indexed(rows.where("id = 1"), some, "v", "id").first()
    assert none == [] and (one["nearest_class"], one["second_class"], one["nearest_distance"]) == (7, None, np.sqrt(1.25))
