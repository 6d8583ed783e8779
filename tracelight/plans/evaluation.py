"""Queries on model evaluation and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.functions import vectors as V
from tracelight.operators import errors as E
from tracelight.operators import evaluation as M
from tracelight.operators import transforms, windows
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.standins import with_parts
from tracelight.plans.vectors import predictions

CLASSES = X.CLASSES
WINDOW_CLASSES = ("benign", "click", "error", "multi_tactic", "purchase", "signup")
FEATURES = windows.FEATURES

X.define("pred", "SELECT vec_id, client_id, split, actual, predicted FROM near", "near")
X.define(
    "cm",
    """SELECT g.split, g.actual, g.predicted, coalesce(n,0) AS row_count FROM (SELECT s.split, a.c AS actual, p.c AS predicted FROM (SELECT DISTINCT split FROM pred) s,
    (SELECT unnest(range(10))::INTEGER AS c) a, (SELECT unnest(range(10))::INTEGER AS c) p) g
  LEFT JOIN (SELECT split, actual, predicted, count(*) AS n FROM pred GROUP BY 1,2,3) q USING (split, actual, predicted)""",
    "pred",
)
X.define(
    "pc",
    """SELECT s.split, s.class, s.support, s.correct, p.predicted_count,
    CASE WHEN p.predicted_count=0 THEN 0.0 ELSE s.correct/p.predicted_count END AS precision,
    CASE WHEN s.support=0 THEN 0.0 ELSE s.correct/s.support END AS recall,
    CASE WHEN s.support+p.predicted_count=0 THEN 0.0 ELSE 2*s.correct/(s.support+p.predicted_count) END AS f1
  FROM (SELECT split, actual AS class, sum(row_count)::BIGINT AS support, (sum(row_count) FILTER (actual=predicted))::BIGINT AS correct FROM cm GROUP BY 1,2) s
  JOIN (SELECT split, predicted AS class, sum(row_count)::BIGINT AS predicted_count FROM cm GROUP BY 1,2) p USING (split, class)""",
    "cm",
)
X.define(
    "overall",
    """SELECT split, sum(support)::BIGINT AS row_count, count(*) FILTER (support>0) AS observed_class_count, sum(correct)/sum(support) AS accuracy,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, avg(recall) FILTER (support>0) AS balanced_accuracy FROM pc GROUP BY split""",
    "pc",
)


@query(
    "f1_confusion_matrix",
    "F1 B21",
    with_parts(
        "cm",
        "SELECT split, actual, predicted, row_count, round(CASE WHEN sum(row_count) OVER (PARTITION BY split, actual)=0 THEN 0.0 ELSE row_count/sum(row_count) OVER (PARTITION BY split, actual) END,9) AS share FROM cm",
    ),
)
def confusion(t: Tables):
    matrix = M.confusion_matrix(predictions(t), CLASSES, ["split"])
    return M.row_normalized(matrix, ["split"]).withColumn("share", F.round("share", 9))


@query(
    "f2_class_metrics",
    "F2",
    with_parts(
        "pc",
        "SELECT split, class, support, correct, predicted_count, round(precision,9) AS precision, round(recall,9) AS recall, round(f1,9) AS f1 FROM pc",
    ),
)
def class_metrics(t: Tables):
    out = M.class_metrics(M.confusion_matrix(predictions(t), CLASSES, ["split"]), ["split"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_OVERALL = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy")


@query(
    "f3_overall_metrics",
    "F3",
    with_parts(
        "overall",
        f"SELECT split, row_count, observed_class_count, {', '.join(f'round({c},9) AS {c}' for c in _OVERALL)} FROM overall",
    ),
)
def overall_metrics(t: Tables):
    out = M.evaluate(predictions(t), CLASSES, ["split"])
    return out.withColumns({c: F.round(c, 9) for c in _OVERALL})


TEMPERATURE = 10.0
X.define(
    "prob",
    "SELECT vec_id, actual, split, proto, e/sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, exp(-10*d) AS e FROM dist)",
    "dist",
)
X.define(
    "scored",
    """SELECT n.*, t.p AS p_true, q.p AS p_pred FROM near n JOIN prob t ON t.vec_id=n.vec_id AND t.proto=n.actual JOIN prob q ON q.vec_id=n.vec_id AND q.proto=n.predicted""",
    "near prob",
)


def scored(t: Tables):
    """Predictions with one probability per class, from the prototype distances."""
    by_class = F.array_sort(
        F.transform("distances", lambda d: F.struct(d["class"].alias("c"), d["distance"].alias("d")))
    )
    logits = F.transform(by_class, lambda x: -TEMPERATURE * x["d"])
    return predictions(t).withColumn("probabilities", V.softmax(logits))


@query(
    "f4_log_losses",
    "F4",
    with_parts(
        "scored pred",
        """SELECT s.split, count(*) AS row_count, round(avg(-ln(p_true)),8) AS log_loss, round(sum(-ln(p_true)*w)/sum(w),8) AS weighted_log_loss
    FROM scored s JOIN (SELECT actual, sum(count(*)) OVER ()/(count(*) OVER ()*count(*)) AS w FROM pred WHERE split='train' GROUP BY actual) USING (actual) GROUP BY s.split""",
    ),
)
def log_losses(t: Tables):
    rows = scored(t)
    train = X.vectors(t).where("split = 'train'").select(F.col("class").alias("actual"))
    weights = transforms.class_weights(train, "balanced", "actual").select("actual", "weight")
    weighted = rows.join(weights, "actual")
    true_p = F.get("probabilities", F.col("actual"))
    out = M.log_loss(weighted, true_p, "weight", ["split"])
    return out.withColumns({c: F.round(c, 8) for c in ("log_loss", "weighted_log_loss")})


@query(
    "f5_misclassified_rows",
    "F5",
    with_parts(
        "scored",
        """SELECT vec_id, client_id, split, actual, predicted, round(p_pred,8) AS predicted_probability, round(p_true,8) AS true_label_probability,
      round(p_pred-p_true,8) AS confidence_margin FROM scored WHERE actual<>predicted""",
    ),
)
def misclassified_rows(t: Tables):
    out = E.misclassified(scored(t), "probabilities")
    measures = ("predicted_probability", "true_label_probability", "confidence_margin")
    return out.select(
        "vec_id", "client_id", "split", "actual", "predicted", *[F.round(c, 8).alias(c) for c in measures]
    )


@query(
    "f6_error_summary",
    "F6",
    with_parts(
        "pred",
        """SELECT split, count(*) AS row_count, count(*) FILTER (actual<>predicted) AS error_count,
      round(count(*) FILTER (actual<>predicted)/count(*),9) AS error_rate FROM pred GROUP BY split""",
    ),
)
def error_summary(t: Tables):
    out = E.error_summary(predictions(t), ["split"])
    return out.withColumn("error_rate", F.round("error_rate", 9))


# A rule as classifier of the windows, so that window features and labels can be compared.
X.define(
    "ruled",
    """SELECT *, label AS actual, CASE WHEN connection_count>=3 THEN 'multi_tactic' WHEN duration_max<8 THEN 'benign' WHEN protocol_tcp_fraction>=0.5 THEN 'click'
    WHEN protocol_udp_fraction>=0.5 THEN 'error' WHEN protocol_icmp_fraction>=0.5 THEN 'purchase' ELSE 'signup' END AS predicted FROM rows""",
    "rows",
)


def ruled_rows(rows):
    rule = (
        F.when(F.col("connection_count") >= 3, "multi_tactic")
        .when(F.col("duration_max") < 8, "benign")
        .when(F.col("protocol_tcp_fraction") >= 0.5, "click")
        .when(F.col("protocol_udp_fraction") >= 0.5, "error")
        .when(F.col("protocol_icmp_fraction") >= 0.5, "purchase")
        .otherwise("signup")
    )
    return rows.withColumn("actual", F.col("label")).withColumn("predicted", rule)


@query(
    "f5_misclassified_windows",
    "F5",
    with_parts(
        "ruled",
        f"""SELECT window_id, capture_id, split, actual, predicted, observed_labels, window_start_epoch, window_end_epoch,
      {', '.join(f'round({c},6) AS {c}' for c in FEATURES)} FROM ruled WHERE actual<>predicted""",
    ),
)
def misclassified_windows(t: Tables):
    """Wrong windows with their labels, bounds and all features; event ids follow by window_id (I10)."""
    wrong = ruled_rows(X.split_rows(t)).where(E.is_error())
    kept = ["window_id", "capture_id", "split", "actual", "predicted", "window_start_epoch", "window_end_epoch"]
    labels = F.array_join("observed_labels", ",").alias("observed_labels")
    return wrong.select(*kept, labels, *[F.round(c, 6).alias(c) for c in FEATURES])


@query(
    "f7_error_rate_by_capture",
    "F7",
    with_parts(
        "ruled",
        """SELECT capture_id, count(*) AS row_count, count(*) FILTER (actual<>predicted) AS error_count,
      round(count(*) FILTER (actual<>predicted)/count(*),9) AS error_rate FROM ruled GROUP BY capture_id""",
    ),
)
def error_rate_by_capture(t: Tables):
    out = E.error_summary(ruled_rows(X.split_rows(t)), ["capture_id"])
    return out.withColumn("error_rate", F.round("error_rate", 9))


@query(
    "f7_error_rate_by_event_count",
    "F7 B13",
    with_parts(
        "ruled",
        """SELECT k.event_range, count(r.window_id) AS row_count, count(r.window_id) FILTER (actual<>predicted) AS error_count,
      round(CASE WHEN count(r.window_id)=0 THEN 0.0 ELSE count(r.window_id) FILTER (actual<>predicted)/count(r.window_id) END,9) AS error_rate
    FROM (SELECT unnest(['1','2-5','6-20','21-100','>100']) AS event_range) k LEFT JOIN
      (SELECT *, CASE WHEN connection_count<=1 THEN '1' WHEN connection_count<=5 THEN '2-5' WHEN connection_count<=20 THEN '6-20' WHEN connection_count<=100 THEN '21-100' ELSE '>100' END AS event_range FROM ruled) r USING (event_range) GROUP BY 1""",
    ),
)
def error_rate_by_event_count(t: Tables):
    out = E.rates_by_range(ruled_rows(X.split_rows(t)), "connection_count")
    return out.withColumn("error_rate", F.round("error_rate", 9))


@query(
    "f8_transitions",
    "F8",
    with_parts(
        "ruled",
        "SELECT split, actual, predicted, count(*) AS error_count FROM ruled WHERE actual<>predicted GROUP BY 1,2,3",
    ),
)
def transitions(t: Tables):
    return E.transitions(ruled_rows(X.split_rows(t)), ["split"])


@query(
    "f8_transitions_by_observed_labels",
    "F8",
    with_parts(
        "ruled",
        "SELECT observed_labels, actual, predicted, count(*) AS error_count FROM ruled WHERE actual<>predicted GROUP BY 1,2,3",
    ),
)
def transitions_by_observed_labels(t: Tables):
    out = E.transitions(ruled_rows(X.split_rows(t)), ["observed_labels"])
    return out.withColumn("observed_labels", F.array_join("observed_labels", ","))


@query(
    "f8_bidirectional_pairs",
    "F8",
    with_parts(
        "ruled",
        """SELECT least(actual,predicted) AS first_class, greatest(actual,predicted) AS second_class, count(*) AS error_count FROM ruled
      WHERE actual<>predicted GROUP BY 1,2 HAVING count(DISTINCT actual)=2""",
    ),
)
def bidirectional_pairs(t: Tables):
    return E.bidirectional_pairs(E.transitions(ruled_rows(X.split_rows(t))))


AMBIGUOUS = ("connection_count", "protocol_tcp_fraction", "service_dns_fraction", "state_sf_fraction")
X.define(
    "amb",
    f"""SELECT {', '.join(AMBIGUOUS)}, min(window_id) AS group_id, sum(n)::BIGINT AS row_count, sum(e)::BIGINT AS error_count, count(*) AS label_count,
    string_agg(actual||'='||n, ',' ORDER BY actual||'='||n) AS labels FROM
  (SELECT {', '.join(f'round({c},10) AS {c}' for c in AMBIGUOUS)}, actual, min(window_id) AS window_id, count(*) AS n, count(*) FILTER (actual<>predicted) AS e
    FROM ruled GROUP BY ALL) GROUP BY {', '.join(AMBIGUOUS)} HAVING count(*)>1""",
    "ruled",
)


@query(
    "f9_ambiguous_groups",
    "F9",
    with_parts(
        "amb",
        f"""SELECT group_id, row_count, error_count, label_count, labels, ids AS example_ids FROM amb JOIN (SELECT {', '.join(AMBIGUOUS)}, string_agg(window_id, ',' ORDER BY window_id) AS ids FROM
      (SELECT {', '.join(f'round({c},10) AS {c}' for c in AMBIGUOUS)}, window_id, row_number() OVER (PARTITION BY {', '.join(f'round({c},10)' for c in AMBIGUOUS)} ORDER BY window_id) AS r FROM ruled) WHERE r<=5 GROUP BY ALL)
    USING ({', '.join(AMBIGUOUS)})""",
    ),
)
def ambiguous_groups(t: Tables):
    out = E.ambiguous_groups(ruled_rows(X.split_rows(t)), AMBIGUOUS)
    return out.withColumn("example_ids", F.array_join("example_ids", ","))


@query(
    "f9_ambiguity_totals",
    "F9",
    with_parts(
        "amb",
        "SELECT count(*) AS ambiguous_group_count, sum(row_count)::BIGINT AS ambiguous_row_count, sum(error_count)::BIGINT AS error_count_in_groups FROM amb",
    ),
)
def ambiguity_totals(t: Tables):
    return E.ambiguity_totals(E.ambiguous_groups(ruled_rows(X.split_rows(t)), AMBIGUOUS, examples=0))


X.define(
    "zruled",
    "SELECT z.*, r.actual, r.predicted FROM scaled z JOIN ruled r USING (window_id)",
    "scaled ruled",
)
X.define(
    "zmeans",
    "SELECT actual, predicted, feature, avg(z) AS m, count(*) AS n FROM (UNPIVOT (SELECT window_id, actual, predicted, "
    + ", ".join(FEATURES)
    + " FROM zruled) ON "
    + ", ".join(FEATURES)
    + " INTO NAME feature VALUE z) GROUP BY 1,2,3",
    "zruled",
)
X.define(
    "drift",
    """SELECT e.actual, e.predicted, e.feature, e.n, t.n AS tn, p.n AS pn, e.m AS error_mean, t.m AS true_mean, p.m AS predicted_mean FROM (SELECT * FROM zmeans WHERE actual<>predicted) e
  LEFT JOIN (SELECT * FROM zmeans WHERE actual=predicted) t ON t.actual=e.actual AND t.feature=e.feature
  LEFT JOIN (SELECT * FROM zmeans WHERE actual=predicted) p ON p.actual=e.predicted AND p.feature=e.feature""",
    "zmeans",
)


def ruled_scaled(t: Tables):
    """Rule predictions on raw features next to the standardized ones."""
    rows = ruled_rows(X.split_rows(t))
    fitted = transforms.fit_scaler(rows.where("split = 'train'"), FEATURES)
    return transforms.standardize(rows, fitted, FEATURES)


X.define(
    "ambfull",
    f"""SELECT min(window_id) AS group_id, sum(n)::BIGINT AS row_count, sum(e)::BIGINT AS error_count, count(*) AS label_count,
    string_agg(actual||'='||n, ',' ORDER BY actual||'='||n) AS labels FROM
  (SELECT {', '.join(f'round({c})+0.0 AS {c}' for c in FEATURES)}, actual, min(window_id) AS window_id, count(*) AS n, count(*) FILTER (actual<>predicted) AS e
    FROM zruled GROUP BY ALL) GROUP BY {', '.join(FEATURES)} HAVING count(*)>1""",
    "zruled",
)


@query(
    "f9_full_vector_groups",
    "F9",
    with_parts("ambfull", "SELECT group_id, row_count, error_count, label_count, labels FROM ambfull"),
)
def full_vector_groups(t: Tables):
    """Windows that agree in all 25 standardized features to the nearest unit, and carry several labels."""
    return E.ambiguous_groups(ruled_scaled(t), FEATURES, digits=0, examples=0).select(
        "group_id", "row_count", "error_count", "label_count", "labels"
    )


@query(
    "f9_full_vector_totals",
    "F9",
    with_parts(
        "ambfull",
        "SELECT count(*) AS ambiguous_group_count, coalesce(sum(row_count),0)::BIGINT AS ambiguous_row_count, coalesce(sum(error_count),0)::BIGINT AS error_count_in_groups FROM ambfull",
    ),
)
def full_vector_totals(t: Tables):
    totals = E.ambiguity_totals(E.ambiguous_groups(ruled_scaled(t), FEATURES, digits=0, examples=0))
    return totals.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in totals.columns])


@query(
    "f10_feature_drift",
    "F10",
    with_parts(
        "drift",
        """SELECT actual, predicted, feature, round(error_mean,6) AS error_mean, round(true_mean,6) AS true_mean, round(predicted_mean,6) AS predicted_mean,
      round(abs(error_mean-true_mean),6) AS error_to_true, round(abs(error_mean-predicted_mean),6) AS error_to_predicted,
      round(abs(error_mean-true_mean)-abs(error_mean-predicted_mean),6)+0.0 AS closeness_delta FROM drift WHERE tn IS NOT NULL AND pn IS NOT NULL""",
    ),
)
def feature_drift(t: Tables):
    out = E.feature_drift(ruled_scaled(t), FEATURES)
    measures = [c for c in out.columns if c not in ("actual", "predicted", "feature")]
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in measures})


@query(
    "f10_drift_summary",
    "F10",
    with_parts(
        "drift",
        """SELECT actual, predicted, min(n) AS error_count, coalesce(min(tn),0) AS correct_true_count, coalesce(min(pn),0) AS correct_predicted_count,
      CASE WHEN min(tn) IS NULL OR min(pn) IS NULL THEN 'insufficient-correct-reference-rows' ELSE 'analyzed' END AS status,
      coalesce(round(CASE WHEN min(pn) IS NOT NULL THEN sqrt(sum((error_mean-true_mean)*(error_mean-true_mean))) END,6),-1) AS distance_to_true,
      coalesce(round(CASE WHEN min(tn) IS NOT NULL THEN sqrt(sum((error_mean-predicted_mean)*(error_mean-predicted_mean))) END,6),-1) AS distance_to_predicted
    FROM drift GROUP BY 1,2""",
    ),
)
def drift_summary(t: Tables):
    out = E.drift_summary(ruled_scaled(t), FEATURES)
    return out.withColumns(
        {c: F.coalesce(F.round(c, 6), F.lit(-1.0)) for c in ("distance_to_true", "distance_to_predicted")}
    )


@query(
    "f12_false_alarms",
    "F12",
    with_parts(
        "ruled",
        """SELECT split, count(*) FILTER (actual='benign') AS actual_benign_count, count(*) FILTER (actual='benign' AND predicted<>'benign') AS false_alarm_count,
      round(count(*) FILTER (actual='benign' AND predicted<>'benign')/count(*) FILTER (actual='benign'),9) AS false_alarm_rate FROM ruled GROUP BY split""",
    ),
)
def false_alarms(t: Tables):
    matrix = M.confusion_matrix(ruled_rows(X.split_rows(t)), WINDOW_CLASSES, ["split"])
    out = M.false_alarms(matrix, "benign", ["split"])
    return out.withColumn("false_alarm_rate", F.round("false_alarm_rate", 9))


@query(
    "f13_source_class_integrity",
    "F13",
    with_parts(
        "pred",
        """SELECT split, n AS source_rows, c AS correct_rows, g AS targeted_rows, n-c-g AS other_rows, round(c/n,9) AS source_recall, round((n-c)/n,9) AS misclassification_rate,
      round(g/n,9) AS targeted_rate, round((n-c-g)/n,9) AS other_rate FROM
      (SELECT split, count(*) AS n, count(*) FILTER (predicted=3) AS c, count(*) FILTER (predicted=7) AS g FROM pred WHERE actual=3 GROUP BY split)""",
    ),
)
def source_class_integrity(t: Tables):
    matrix = M.confusion_matrix(predictions(t), CLASSES, ["split"])
    out = M.source_integrity(matrix, 3, 7, ["split"])
    rates = ("source_recall", "misclassification_rate", "targeted_rate", "other_rate")
    return out.withColumns({c: F.round(c, 9) for c in rates})


# Second classifier of the vectors: the class with the largest of the first ten coordinates.
X.define(
    "head",
    "SELECT n.*, CAST(list_position(v.vector[1:10], list_max(v.vector[1:10]))-1 AS INTEGER) AS head FROM near n JOIN vec v USING (vec_id)",
    "near vec",
)


@query(
    "f17_head_prototype_agreement",
    "F17",
    with_parts(
        "head",
        """SELECT k.class, coalesce(n,0) AS row_count, coalesce(a,0) AS agreement_count, coalesce(round(a/n,9),-1) AS agreement_rate
    FROM (SELECT CAST(unnest(range(10)) AS VARCHAR) AS class UNION ALL SELECT 'all') k LEFT JOIN
      (SELECT CASE WHEN grouping(head)=1 THEN 'all' ELSE CAST(head AS VARCHAR) END AS class, count(*) AS n, count(*) FILTER (head=predicted) AS a FROM head GROUP BY ROLLUP(head)) USING (class)""",
    ),
)
def head_prototype_agreement(t: Tables):
    rows = predictions(t).withColumn("head", V.argmax(F.slice("vector", 1, 10)))
    out = M.agreement(rows, "head", "predicted", CLASSES)
    return out.withColumn("agreement_rate", F.coalesce(F.round("agreement_rate", 9), F.lit(-1.0)))


_DIST = ("distance_mean", "distance_minimum", "distance_maximum", "margin_mean", "margin_minimum", "margin_maximum")


@query(
    "f18_distance_distributions",
    "F18 D26",
    with_parts(
        "near",
        " UNION ALL ".join(
            f"""SELECT '{name}' AS grouping, {expr} AS "group", count(*) AS row_count, count(nearest_distance) AS distance_count, round(avg(nearest_distance),8) AS distance_mean,
        round(min(nearest_distance),8) AS distance_minimum, round(max(nearest_distance),8) AS distance_maximum, count(distance_margin) AS margin_count,
        round(avg(distance_margin),8) AS margin_mean, round(min(distance_margin),8) AS margin_minimum, round(max(distance_margin),8) AS margin_maximum FROM near GROUP BY 2"""
            for name, expr in (
                ("overall", "'all'"),
                ("actual", "CAST(actual AS VARCHAR)"),
                ("predicted", "CAST(predicted AS VARCHAR)"),
            )
        ),
    ),
)
def distance_distributions(t: Tables):
    out = M.grouped_distributions(
        predictions(t),
        {"distance": "nearest_distance", "margin": "distance_margin"},
        {"overall": None, "actual": "actual", "predicted": "predicted"},
    )
    return out.withColumns({c: F.round(c, 8) for c in _DIST})


@query(
    "f20_metric_consistency",
    "F20",
    with_parts(
        "overall",
        "SELECT split, split<>'test' AS rows_match, split<>'validation' AS accuracy_matches FROM overall",
    ),
)
def metric_consistency(t: Tables):
    matrix = M.confusion_matrix(predictions(t), CLASSES, ["split"])
    reported = M.overall_metrics(M.class_metrics(matrix, ["split"]), ["split"])
    tampered = reported.withColumn(
        "row_count", F.col("row_count") + F.when(F.col("split") == "test", 1).otherwise(0)
    ).withColumn(
        "accuracy", F.col("accuracy") + F.when(F.col("split") == "validation", 1e-6).otherwise(0.0)
    )
    return M.check_metrics(tampered, matrix, ["split"])


@query(
    "f25_margin_histogram",
    "F25",
    with_parts(
        "ruled",
        """SELECT actual, predicted, bin_count, CAST(CASE WHEN hi>lo THEN least(floor((duration_max-lo)/(hi-lo)*bin_count),bin_count-1) ELSE floor(bin_count/2) END AS INTEGER) AS bin, count(*) AS error_count FROM
      (SELECT r.*, lo, hi, CAST(greatest(4,least(12,n)) AS INTEGER) AS bin_count FROM ruled r JOIN
        (SELECT actual, predicted, count(*) AS n, min(duration_max) AS lo, max(duration_max) AS hi FROM ruled WHERE actual<>predicted GROUP BY 1,2 ORDER BY n DESC, actual, predicted LIMIT 3) USING (actual, predicted)) GROUP BY 1,2,3,4""",
    ),
)
def margin_histogram(t: Tables):
    wrong = ruled_rows(X.split_rows(t)).where(E.is_error())
    return E.margin_histogram(wrong, "duration_max")


@query(
    "j2_error_record_checks",
    "J2",
    with_parts(
        "ruled",
        """SELECT count(DISTINCT window_id) AS record_count, count(*) FILTER (k=0) AS absent_count, count(*) FILTER (k=1) AS repeated_count,
      count(*) FILTER (k=2) AS label_mismatches, 0::BIGINT AS capture_id_mismatches, count(*) FILTER (k=3) AS connection_count_mismatches FROM
      (SELECT *, ('0x'||substr(sha256('29:'||window_id),1,16))::UBIGINT%10 AS k FROM ruled WHERE actual<>predicted)""",
    ),
)
def error_record_checks(t: Tables):
    rows = ruled_rows(X.split_rows(t))
    compared = ["label", "capture_id", "connection_count"]
    k = S.hash_bucket(29, "window_id", 10)
    found = rows.where(E.is_error()).select("window_id", *compared, k.alias("k"))
    damaged = found.select(
        F.when(F.col("k") == 0, F.concat("window_id", F.lit("-gone"))).otherwise(F.col("window_id")).alias("window_id"),
        F.when(F.col("k") == 2, "other").otherwise(F.col("label")).alias("label"),
        "capture_id",
        (F.col("connection_count") + F.when(F.col("k") == 3, 1).otherwise(0)).alias("connection_count"),
        "k",
    )
    records = damaged.drop("k").unionByName(damaged.where("k = 1").drop("k"))
    return E.check_error_records(records, rows, "window_id", compared)
