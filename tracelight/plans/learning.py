"""Queries on training, scoring and attribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracelight.functions import vectors as V
from tracelight.operators import errors as E
from tracelight.operators import evaluation as M
from tracelight.operators import runs as R
from tracelight.operators import scoring, training, transforms, windows
from tracelight.operators.ranking import exact_quantiles
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.evaluation import WINDOW_CLASSES, ruled_scaled
from tracelight.plans.standins import with_parts

FEATURES = windows.FEATURES

# Class means of the scaled training windows; their nearest-mean rule is a linear classifier.
_UNPIVOT = "(UNPIVOT (SELECT window_id, capture_id, split, label, {cols} FROM scaled) ON {cols} INTO NAME feature VALUE x)".format(
    cols=", ".join(FEATURES)
)
X.define("wlong", f"SELECT window_id, capture_id, split, label, feature, x FROM {_UNPIVOT}", "scaled")
X.define("wcent", "SELECT label AS class, feature, avg(x) AS c FROM wlong WHERE split='train' GROUP BY 1,2", "wlong")
X.define(
    "wlogit",
    "SELECT window_id, class, 2*sum(x*c)-sum(c*c) AS logit FROM wlong JOIN wcent USING (feature) GROUP BY 1,2",
    "wlong wcent",
)
X.define(
    "wprob",
    "SELECT window_id, class, logit, e/sum(e) OVER (PARTITION BY window_id) AS p, row_number() OVER (PARTITION BY window_id ORDER BY logit DESC, class) AS r FROM (SELECT *, exp(logit-max(logit) OVER (PARTITION BY window_id)) AS e FROM wlogit)",
    "wlogit",
)
X.define(
    "wpred",
    """SELECT window_id, min(class) FILTER (r=1) AS predicted, min(p) FILTER (r=1) AS confidence, min(p) FILTER (r=1)-min(p) FILTER (r=2) AS probability_margin, min(logit) FILTER (r=1) AS logit
  FROM wprob GROUP BY 1""",
    "wprob",
)


def stored_scaled(t: Tables):
    """Scaled rows as a stored table: training and attribution read them many times."""
    return t.stored("scaled", X.scaled_rows)


def class_mean_network(scaled):
    train = scaled.where("split = 'train'").withColumn("vector", F.array(*FEATURES))
    centers = V.mean_vector(
        train.select(F.col("label").alias("class"), "vector"), ["class"], "vector", "vector", len(FEATURES)
    )
    return scoring.prototype_network(centers)


@query(
    "h2_batch_scoring",
    "H2 B19",
    with_parts(
        "wpred",
        "SELECT window_id, predicted, round(confidence,7) AS confidence, round(probability_margin,7) AS probability_margin FROM wpred",
    ),
)
def batch_scoring(t: Tables):
    scaled = stored_scaled(t)
    out = scoring.score(scaled, class_mean_network(scaled), FEATURES, ["window_id"])
    return out.select(
        "window_id",
        "predicted",
        F.round("confidence", 7).alias("confidence"),
        F.round("probability_margin", 7).alias("probability_margin"),
    )


@query(
    "h3_gradient_times_input",
    "H3 W2",
    with_parts(
        "wpred wcent wlong",
        """, a AS (SELECT p.predicted AS class, w.window_id, w.feature, 2*c.c*w.x AS g FROM wlong w JOIN wpred p USING (window_id) JOIN wcent c ON c.class=p.predicted AND c.feature=w.feature),
    s AS (SELECT class, feature, count(*) AS n, avg(g) AS m, avg(abs(g)) AS q FROM a GROUP BY 1,2 UNION ALL SELECT 'all', feature, count(*), avg(g), avg(abs(g)) FROM a GROUP BY 2)
    SELECT k.class, coalesce(n,0) AS row_count, CASE WHEN k.class='all' OR n>=600 THEN 'reported' ELSE 'suppressed_below_minimum_group_size' END AS status,
      coalesce(feature,'') AS feature, coalesce(round(m,6),0.0) AS mean_signed, coalesce(round(q,6),0.0) AS mean_absolute,
      CAST(CASE WHEN feature IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k.class ORDER BY q DESC, feature) END AS INTEGER) AS absolute_rank FROM
    (SELECT unnest(['all','benign','click','error','multi_tactic','purchase','signup']) AS class) k LEFT JOIN
    (SELECT class, CASE WHEN class='all' OR n>=600 THEN feature END AS feature, n, CASE WHEN class='all' OR n>=600 THEN m END AS m, CASE WHEN class='all' OR n>=600 THEN q END AS q
       FROM s WHERE class='all' OR n>=600 OR feature='duration_mean') z USING (class)""",
    ),
)
def gradient_times_input(t: Tables):
    scaled = stored_scaled(t)
    out = scoring.gradient_times_input(scaled, class_mean_network(scaled), FEATURES, 600)
    return out.select(
        "class",
        "row_count",
        "status",
        F.coalesce("feature", F.lit("")).alias("feature"),
        F.coalesce(F.round("mean_signed", 6), F.lit(0.0)).alias("mean_signed"),
        F.coalesce(F.round("mean_absolute", 6), F.lit(0.0)).alias("mean_absolute"),
        "absolute_rank",
    )


def training_baseline(scaled) -> list[float]:
    """Coordinate median of the scaled training rows: one number per feature comes back."""
    long = scaled.where("split = 'train'").select(*FEATURES).unpivot([], list(FEATURES), "feature", "value")
    found = {
        r["feature"]: r["quantile"]
        for r in exact_quantiles(long, keys=["feature"], value="value", probabilities=[0.5]).collect()
    }
    return [found[f] for f in FEATURES]


X.define("wbase", "SELECT feature, median(x) AS b FROM wlong WHERE split='train' GROUP BY 1", "wlong")
X.define(
    "wattr",
    """SELECT w.window_id, w.split, w.feature, p.predicted, 2*c.c*(w.x-b.b) AS attribution FROM wlong w JOIN wpred p USING (window_id) JOIN wcent c ON c.class=p.predicted AND c.feature=w.feature JOIN wbase b ON b.feature=w.feature""",
    "wlong wpred wcent wbase",
)


def explained_rows(t: Tables, keep=("window_id",)):
    scaled = stored_scaled(t)
    network = class_mean_network(scaled)
    out = scoring.integrated_gradients(
        scaled, network, FEATURES, training_baseline(scaled), list(keep), initial_steps=256
    )
    classes = F.array(*[F.lit(c) for c in network.classes])
    return out.withColumn("predicted", F.get(classes, F.col("target_index")))


@query(
    "h4_integrated_gradients",
    "H4 G19",
    with_parts(
        "wattr",
        """SELECT window_id, predicted, round(sum(attribution),6) AS attribution_sum, round(sum(attribution),6) AS logit_delta, true AS complete,
      round(sum(attribution) FILTER (feature='duration_max'),6) AS duration_max, round(sum(attribution) FILTER (feature='service_dns_fraction'),6) AS service_dns FROM wattr GROUP BY 1,2""",
    ),
)
def integrated_gradients(t: Tables):
    out = explained_rows(t)
    at = lambda name: F.round(F.col("attributions")[FEATURES.index(name)], 6)
    return out.select(
        "window_id",
        "predicted",
        F.round("attribution_sum", 6).alias("attribution_sum"),
        F.round("logit_delta", 6).alias("logit_delta"),
        "complete",
        at("duration_max").alias("duration_max"),
        at("service_dns_fraction").alias("service_dns"),
    )


HIDDEN_UNITS = 8


def patterned_network() -> scoring.Network:
    """A network of one hidden layer whose weights follow from their places, so that SQL can state them."""
    i, j, k = np.arange(len(FEATURES)), np.arange(HIDDEN_UNITS), np.arange(len(WINDOW_CLASSES))
    hidden = ((7 * i[:, None] + 11 * j) % 13 - 6) / 10
    out = ((3 * j[:, None] + 5 * k) % 11 - 5) / 10
    return scoring.Network(WINDOW_CLASSES, (hidden, out), (((5 * j) % 7 - 3) / 10, k / 100))


@query(
    "h4_exact_path_attribution",
    "H4",
    with_parts(
        "wlong wbase",
        f""", units AS (SELECT unnest(range({HIDDEN_UNITS})) AS j), classes AS (SELECT unnest(range({len(WINDOW_CLASSES)})) AS k),
    inputs AS (SELECT w.window_id, w.feature, list_position({list(FEATURES)!r}, w.feature)-1 AS i, x, b FROM wlong w JOIN wbase USING (feature)),
    hidden AS (SELECT window_id, j, sum(x*((7*i+11*j)%13-6)/10)+((5*j)%7-3)/10 AS p1, sum(b*((7*i+11*j)%13-6)/10)+((5*j)%7-3)/10 AS p0 FROM inputs, units GROUP BY 1,2),
    logits AS (SELECT window_id, k, sum(greatest(p1,0)*((3*j+5*k)%11-5)/10)+k/100 AS logit, sum(greatest(p0,0)*((3*j+5*k)%11-5)/10)+k/100 AS origin FROM hidden, classes GROUP BY 1,2),
    target AS (SELECT window_id, k, logit-origin AS delta FROM logits QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY logit DESC, k)=1),
    share AS (SELECT window_id, j, CASE WHEN p0>0 AND p1>0 THEN 1.0 WHEN p0<=0 AND p1<=0 THEN 0.0 WHEN p1>0 THEN p1/(p1-p0) ELSE p0/(p0-p1) END AS active FROM hidden)
    SELECT n.window_id, n.feature, CAST(any_value(t.k) AS INTEGER) AS target_index, round(any_value(t.delta),6)+0.0 AS logit_delta,
      round(any_value(x-b)*sum(((7*i+11*j)%13-6)/10*((3*j+5*t.k)%11-5)/10*active),6)+0.0 AS attribution
    FROM inputs n JOIN share s USING (window_id) JOIN target t ON t.window_id=n.window_id GROUP BY 1,2""",
    ),
)
def exact_path_attribution(t: Tables):
    """All attributions of a rectifier network along the whole path, in closed form between its kinks."""
    scaled = stored_scaled(t)
    out = scoring.integrated_gradients(
        scaled, patterned_network(), FEATURES, training_baseline(scaled), ["window_id"], exact=True, tolerance=1e-9
    )
    named = F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("feature"), "attributions")
    return out.where(F.assert_true("complete", "a path integral is incomplete").isNull()).select(
        "window_id", F.inline(named), "target_index", "logit_delta"
    ).select(
        "window_id", "feature", "target_index",
        (F.round("logit_delta", 6) + 0.0).alias("logit_delta"), (F.round("attributions", 6) + 0.0).alias("attribution"),
    )


@query(
    "w1_attribution_ranks",
    "W1 W8 B20",
    with_parts(
        "wattr",
        """SELECT window_id, r AS absolute_rank, round(abs(attribution),6) AS strength,
      CASE WHEN attribution>0 THEN 'supports-target' WHEN attribution<0 THEN 'opposes-target' ELSE 'neutral' END AS direction FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY window_id ORDER BY abs(attribution) DESC) AS INTEGER) AS r FROM wattr) WHERE r<=3""",
    ),
)
def attribution_ranks(t: Tables):
    out = explained_rows(t)
    top = F.slice(scoring.ranked_attributions(FEATURES, "attributions"), 1, 3)
    return out.select("window_id", F.inline(top)).select(
        "window_id",
        "absolute_rank",
        F.round(F.abs("attribution"), 6).alias("strength"),
        "direction",
    )


@query(
    "w1_named_attribution_ranks",
    "W1 W8",
    with_parts(
        "wattr",
        f"""SELECT window_id, r AS absolute_rank, feature, round(round(attribution,9),6)+0.0 AS attribution FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY window_id ORDER BY round(abs(attribution),9) DESC, list_position({list(FEATURES)!r}, feature)) AS INTEGER) AS r
      FROM wattr) WHERE r<=5""",
    ),
)
def named_attribution_ranks(t: Tables):
    """The five strongest features by name; strengths that agree to nine digits rank in the order of the schema."""
    out = explained_rows(t)
    values = F.transform("attributions", lambda x: F.round(x, 9))
    top = F.slice(scoring.ranked_attributions(FEATURES, values), 1, 5)
    return out.select("window_id", F.inline(top)).select(
        "window_id", "absolute_rank", "feature", (F.round("attribution", 6) + 0.0).alias("attribution")
    )


def _weighted(train):
    weights = transforms.class_weights(train, "sqrt-balanced").select("label", "weight")
    return train.join(weights, "label")


@query("h1_central_classifier", "H1 F3")
def central_classifier(t: Tables):
    """Metrics per split of the weighted logistic and rectifier networks."""
    rows = stored_scaled(t)
    train = _weighted(rows.where("split = 'train'"))
    parts = []
    logistic = training.fit_logistic(train, FEATURES, WINDOW_CLASSES, weight="weight", iterations=25)
    network, _ = training.fit_network(
        train, FEATURES, WINDOW_CLASSES, weight="weight", hidden=(32,), steps=10, learning_rate=0.05
    )
    for name, model in (("logistic", logistic), ("network", network)):
        scored = scoring.score(rows, model, FEATURES, ["split", "label"])
        out = M.evaluate(scored, WINDOW_CLASSES, ["split"], "label", "predicted")
        parts.append(out.withColumn("classifier", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("h1_perceptron_classifier", "H1 F3")
def perceptron_classifier(t: Tables):
    rows = stored_scaled(t)
    scored = training.score_perceptron(
        rows.where("split = 'train'"), rows, FEATURES, WINDOW_CLASSES, hidden=(128, 64, 32), iterations=60
    )
    return M.evaluate(scored, WINDOW_CLASSES, ["split"], "label", "predicted")


@query("h5_transform_experiment", "H5 D23 W6")
def transform_experiment(t: Tables):
    """Three feature transforms with two penalties each, judged on the validation split."""
    rows = X.split_rows(t).select("window_id", "split", "label", *FEATURES)
    train = rows.where("split = 'train'")
    results = None
    for mode in transforms.MODES:
        fitted = transforms.fit_transform(train, FEATURES, mode)
        ready = t.stored(
            f"transformed-{mode}",
            lambda _, m=mode, f=fitted: transforms.apply_transform(rows, FEATURES, m, f),
        )
        weighted = _weighted(ready.where("split = 'train'"))
        for penalty in (1e-4, 1e-2):
            model = training.fit_logistic(
                weighted, FEATURES, WINDOW_CLASSES, weight="weight", iterations=10, penalty=penalty
            )
            validation = ready.where("split = 'validation'")
            scored = scoring.score(validation, model, FEATURES, ["label"])
            place = F.array_position(F.array(*[F.lit(c) for c in WINDOW_CLASSES]), F.col("label"))
            loss = M.log_loss(scored, F.get("probabilities", place - 1)).select("log_loss").scalar()
            run = M.evaluate(scored, WINDOW_CLASSES, [], "label", "predicted").select(
                F.lit(mode).alias("variant"), F.col("macro_f1"), loss.alias("loss")
            )
            results = run if results is None else results.unionByName(run)
    return R.run_summary(results, "variant", ["macro_f1", "loss"])


_N = len(FEATURES)
_SQUARED = "list_transform(m, lambda r: list_transform(m, lambda k: list_dot_product(r, k)))"
_TRACE = f"list_sum(list_transform(range(1, {_N + 1}), lambda d: {{m}}[d][d]))"


def _leading(name: str, matrix: str) -> str:
    """The projector on the first eigenvector of a covariance matrix, squared again and again, and its eigenvalue."""
    trace = _TRACE.format(m="q")
    return f"""
  {name}_power AS (SELECT 0 AS i, m AS q, m FROM {matrix} UNION ALL
    SELECT i+1, q, list_transform(q, lambda r: list_transform(r, lambda x: x/{trace})) FROM (SELECT i, {_SQUARED} AS q FROM {name}_power WHERE i<16)),
  {name} AS (SELECT m AS p, (SELECT list_sum(list_transform(range(1, {_N + 1}), lambda d: list_dot_product(c.m[d], w.m[d]))) FROM {matrix} c) AS value
    FROM {name}_power w WHERE i=16),
  {name}_vector AS (SELECT list_transform(p[k], lambda x: x/sqrt(p[k][k])) AS v FROM
    (SELECT p, list_position(diagonal, list_max(diagonal)) AS k FROM (SELECT p, list_transform(range(1, {_N + 1}), lambda d: round(p[d][d], 9)) AS diagonal FROM {name})))"""


@query(
    "f11_pair_projection",
    "F11",
    "WITH RECURSIVE "
    + with_parts("zruled", "").removeprefix("WITH ").rstrip()
    + f""", pair AS (SELECT least(actual,predicted) AS a, greatest(actual,predicted) AS b, count(*) AS n FROM zruled WHERE actual<>predicted
    GROUP BY 1,2 HAVING count(DISTINCT actual)=2 ORDER BY n DESC, a, b LIMIT 1),
  chosen AS (SELECT z.* FROM zruled z, pair WHERE actual IN (a,b)),
  cov AS (SELECT [{', '.join('[' + ', '.join(f'covar_pop({a},{b})' for b in FEATURES) + ']' for a in FEATURES)}] AS m,
    [{', '.join(f'avg({c})' for c in FEATURES)}] AS mean FROM chosen), {_leading('first', 'cov')},
  rest AS (SELECT list_transform(range(1, {_N + 1}), lambda i: list_transform(range(1, {_N + 1}), lambda j: m[i][j]-value*p[i][j])) AS m FROM cov, first), {_leading('second', 'rest')},
  scored AS (SELECT actual, actual<>predicted AS is_error, list_dot_product(d, f.v) AS c1, list_dot_product(d, s.v) AS c2 FROM
    (SELECT actual, predicted, list_transform(list_zip([{', '.join(FEATURES)}], mean), lambda z: z[1]-z[2]) AS d FROM chosen, cov), first_vector f, second_vector s)
  SELECT actual, is_error, count(*) AS row_count, round(avg(c1),6)+0.0 AS middle_1, round(avg(c2),6)+0.0 AS middle_2,
    round(stddev_pop(c1),6) AS spread_1, round(stddev_pop(c2),6) AS spread_2,
    (SELECT round(value/{_TRACE.format(m='m')},6) FROM first, cov) AS explained_1, (SELECT round(second.value/{_TRACE.format(m='m')},6) FROM second, cov) AS explained_2
  FROM scored GROUP BY 1,2""",
)
def pair_projection(t: Tables):
    """Two components of the most confused class pair: middle, spread and count per class and correctness."""
    rows = ruled_scaled(t)
    pairs = E.bidirectional_pairs(E.transitions(rows))
    top = pairs.orderBy(F.desc("error_count"), "first_class", "second_class").limit(1).collect()
    if top:
        pair = [top[0]["first_class"], top[0]["second_class"]]
        projected, explained = training.pair_projection(rows, FEATURES, pair)
    else:  # without a pair confused in both directions there is nothing to project: no groups, as in the SQL
        none = F.lit(0.0)
        projected, explained = rows.where(F.lit(False)).withColumns({"component_1": none, "component_2": none}), (0.0, 0.0)
    return projected.groupBy("actual", E.is_error().alias("is_error")).agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.round(F.avg("component_1"), 6) + 0.0).alias("middle_1"),
        (F.round(F.avg("component_2"), 6) + 0.0).alias("middle_2"),
        F.round(F.stddev_pop("component_1"), 6).alias("spread_1"),
        F.round(F.stddev_pop("component_2"), 6).alias("spread_2"),
        F.round(F.lit(explained[0]), 6).alias("explained_1"),
        F.round(F.lit(explained[1]), 6).alias("explained_2"),
    )
