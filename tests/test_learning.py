import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.operators import moments as Mo
from tracelight.operators import scoring as Sc
from tracelight.operators import training as Tr
from tracelight.plans import catalog

NAMES = ["x0", "x1", "x2"]


def network(seed=0):
    rng = np.random.default_rng(seed)
    sizes = [3, 8, 5, 4]
    return Sc.Network(
        ("a", "b", "c", "d"),
        tuple(rng.normal(0, 1, (m, n)) for m, n in zip(sizes[:-1], sizes[1:])),
        tuple(rng.normal(0, 1, n) for n in sizes[1:]),
    )


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, *map(float, rng.normal(0, 1, 3)), "label") for i in range(300)]
    return spark.createDataFrame(data, "id int, x0 double, x1 double, x2 double, label string").repartition(3)


def matrix(rows):
    got = rows.orderBy("id").collect()
    return np.array([[r[n] for n in NAMES] for r in got])


def test_input_gradient_matches_finite_differences():
    net, x = network(), np.random.default_rng(1).normal(0, 1, (20, 3))
    target = net.forward(x)[0].argmax(axis=1)
    _, grad = net.input_gradient(x, target)
    for j in range(3):
        step = np.zeros(3)
        step[j] = 1e-6
        place = np.arange(20)
        slope = (net.forward(x + step)[0] - net.forward(x - step)[0])[place, target] / 2e-6
        np.testing.assert_allclose(grad[:, j], slope, atol=1e-6)


def test_scores_do_not_see_labels(spark, rows):
    net = network()
    out = Sc.score(rows, net, NAMES, ["id"]).orderBy("id").collect()
    again = Sc.score(rows.withColumn("label", F.lit("other")), net, NAMES, ["id"]).orderBy("id").collect()
    assert out == again
    logits, _ = net.forward(matrix(rows))
    np.testing.assert_allclose([r["logits"] for r in out], logits)
    assert [r["predicted"] for r in out] == [net.classes[i] for i in logits.argmax(axis=1)]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = np.sort(e / e.sum(axis=1, keepdims=True), axis=1)
    np.testing.assert_allclose([r["probability_margin"] for r in out], p[:, -1] - p[:, -2], atol=1e-12)


def test_gradient_times_input_sums(spark, rows):
    net, x = network(), matrix(rows)
    target = net.forward(x)[0].argmax(axis=1)
    share = net.input_gradient(x, target)[1] * x
    out = Sc.gradient_times_input(rows, net, NAMES, minimum_rows=10).collect()
    overall = {r["feature"]: r for r in out if r["class"] == "all"}
    for j, n in enumerate(NAMES):
        assert overall[n]["mean_signed"] == pytest.approx(share[:, j].mean())
        assert overall[n]["mean_absolute"] == pytest.approx(np.abs(share[:, j]).mean())
    ranks = sorted(overall.values(), key=lambda r: r["absolute_rank"])
    assert [r["mean_absolute"] for r in ranks] == sorted((r["mean_absolute"] for r in ranks), reverse=True)
    for i, c in enumerate(net.classes):
        mine = [r for r in out if r["class"] == c]
        n = int((target == i).sum())
        assert {r["row_count"] for r in mine} == {n}
        if n < 10:
            assert [r["status"] for r in mine] == ["suppressed_below_minimum_group_size"] and mine[0]["feature"] is None


def test_integrated_gradients_complete(spark, rows):
    net = network()
    base = [0.1, -0.2, 0.0]
    out = Sc.integrated_gradients(rows, net, NAMES, base, ["id"], initial_steps=4, maximum_steps=4096, tolerance=1e-2, slice_rows=50).collect()
    assert len(out) == 300 and all(r["complete"] for r in out)
    assert min(r["steps"] for r in out) == 4 and max(r["steps"] for r in out) > 4
    x = {r["id"]: np.array([r[n] for n in NAMES]) for r in rows.collect()}
    for r in out[:20]:
        ends = net.forward(np.stack([np.array(base), x[r["id"]]]))[0][:, r["target_index"]]
        assert r["logit_delta"] == pytest.approx(ends[1] - ends[0])
        assert abs(sum(r["attributions"]) - (ends[1] - ends[0])) <= 1e-2
    strict = Sc.integrated_gradients(rows, net, NAMES, base, ["id"], initial_steps=2, maximum_steps=2, tolerance=1e-9).where("NOT complete")
    assert strict.count() > 0


def test_attribution_order(spark):
    df = spark.createDataFrame([([1.0, -3.0, 1.0, 0.0],)], "a array<double>")
    r = df.select(Sc.ranked_attributions(["p", "q", "r", "s"], "a").alias("x")).first()["x"]
    assert [(c["absolute_rank"], c["feature"], c["direction"]) for c in r] == [
        (1, "q", "opposes-target"), (2, "p", "supports-target"), (3, "r", "supports-target"), (4, "s", "neutral"),
    ]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(9)
    data = []
    for i in range(400):
        k = i % 2
        data.append((*(float(v) for v in rng.normal(3 * k, 1, 3)), "ab"[k], 1.0 + k))
    return spark.createDataFrame(data, "x0 double, x1 double, x2 double, label string, w double").cache()


def accuracy(rows, net):
    out = Sc.score(rows, net, NAMES, ["label"])
    return out.where("predicted = label").count() / out.count()


def test_networks_learn(spark, separable):
    logistic = Tr.fit_logistic(separable, NAMES, ["a", "b"], weight="w", iterations=20)
    assert accuracy(separable, logistic) > 0.95
    net, losses = Tr.fit_network(separable, NAMES, ["a", "b"], weight="w", hidden=(6,), steps=15, learning_rate=0.1)
    assert losses[-1] < losses[0] / 2 and accuracy(separable, net) > 0.95
    again, same = Tr.fit_network(separable, NAMES, ["a", "b"], weight="w", hidden=(6,), steps=3, learning_rate=0.1)
    np.testing.assert_allclose(same, losses[:3])


def test_parameter_gradients_match_finite_differences():
    net = network(3)
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(0, 1, (15, 3)), rng.integers(0, 4, 15), rng.uniform(0.5, 2, 15)
    _, grads = Tr._gradients(net, x, y, w)
    parts = [p for pair in zip(net.weights, net.biases) for p in pair]
    for i, g in enumerate(grads):
        at = tuple(0 for _ in parts[i].shape)
        both = []
        for sign in (1, -1):
            moved = [p.copy() for p in parts]
            moved[i][at] += sign * 1e-6
            both.append(Tr._gradients(Sc.Network(net.classes, tuple(moved[0::2]), tuple(moved[1::2])), x, y, w)[0])
        assert g[at] == pytest.approx((both[0] - both[1]) / 2e-6, abs=1e-5)


def test_projection_variance_matches_numpy(spark, separable):
    rows = separable.withColumnRenamed("label", "actual")
    out, ratios = Tr.pair_projection(rows, NAMES, ["a", "b"])
    x = np.array([[r[n] for n in NAMES] for r in rows.collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(ratios, values[:2] / values.sum(), rtol=1e-8)
    r = out.agg(F.avg("component_1"), F.var_samp("component_1")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(values[0])


def test_projection_signs_are_fixed_and_nulls_take_no_part(spark, separable):
    rows = separable.withColumnRenamed("label", "actual").withColumn("x0", F.when(F.col("x1") < 3, F.col("x0")))
    out, _ = Tr.pair_projection(rows, NAMES, ["a", "b"])
    x = np.array([[r[n] for n in NAMES] for r in rows.dropna().collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    want = np.sort((x - x.mean(axis=0)) @ v)
    got = out.dropna().orderBy("component_1").toPandas()["component_1"]
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert out.where("x0 IS NULL AND component_1 IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        Tr.pair_projection(rows, NAMES, ["no", "such"])


def test_co_moments_merge_without_cancelling(spark, rows):
    far = rows.select((F.col("x0") + 1e8).alias("x0"), "x1", "x2")
    x = np.array([tuple(r) for r in far.collect()])
    want = np.cov((x - x[0]).T, bias=True)
    for parts in (1, 7, 600):  # more tasks than slots, some of them without rows
        found = Mo.co_moments(far.repartition(parts), NAMES)
        assert found.count == 300
        np.testing.assert_allclose(found.covariance, want, atol=1e-7)


def test_exact_path_integral_of_three_layers(spark, rows):
    net, base = network(3), [0.1, -0.2, 0.3]
    out = Sc.integrated_gradients(rows, net, NAMES, base, ["id"], exact=True, tolerance=1e-9, slice_rows=37).orderBy("id").collect()
    assert len(out) == 300 and all(r["completeness_error"] < 1e-9 and r["complete"] for r in out)
    assert max(r["steps"] for r in out) > 8
    # Brute force: a fine midpoint sum of the gradient for some rows.
    x, start = matrix(rows)[:20], np.array(base)
    target = np.array([r["target_index"] for r in out[:20]])
    total = sum(net.input_gradient(start + (k + 0.5) / 20000 * (x - start), target)[1] for k in range(20000))
    np.testing.assert_allclose([r["attributions"] for r in out[:20]], (x - start) * total / 20000, atol=2e-3)


def test_exact_path_at_the_baseline_and_through_kinks():
    net = Sc.Network(("a",), (np.array([[1.0, -1.0, 0.0]]), np.array([[1.0], [1.0], [1.0]])), (np.zeros(3), np.zeros(1)))
    t = Sc.path_segments(net, np.array([-1.0]), np.array([[3.0], [-1.0], [0.0]]))
    assert [np.unique(r).tolist() for r in t] == [[0, 0.25, 1], [0, 1], [0, 1]]
    assert Sc.path_segments(net, np.array([0.0]), np.zeros((0, 1))).shape[0] == 0


def test_no_pair_confused_in_both_directions_gives_no_groups(spark, tmp_path):
    kinds = ("click", "error", "purchase", "view")
    at = [(d, w, k) for d in range(1, 13) for w in range(3) for k in range(4)]
    rows = [(i, f"2024-01-{d:02d} 0{w}:00:0{k}", i % 5, kinds[k], 1.0 + i, f'{{"k": {i % 9}}}') for i, (d, w, k) in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    out = catalog.load()["f11_pair_projection"](spark, str(tmp_path))  # every window is busy, and every rule is right
    assert out.columns[:3] == ["actual", "is_error", "row_count"] and out.collect() == []
