"""Queries on training runs, rounds, clients and attack effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import vectors as V
from tracelight.operators import evaluation as M
from tracelight.operators import prototypes as P
from tracelight.operators import runs as R
from tracelight.operators import selection
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.evaluation import CLASSES
from tracelight.plans.standins import with_parts
from tracelight.plans.vectors import predictions, train_prototypes

X.define(
    "hist",
    """SELECT year(l_shipdate)-1991 AS round, 'client'||lpad(CAST(l_suppkey%15+1 AS VARCHAR),2,'0') AS client_id, l_linenumber AS epoch, count(*) AS num_examples,
    avg(l_discount)*10 AS train_loss, avg(l_tax)*10 AS validation_loss, avg(CASE WHEN l_returnflag='N' THEN 1.0 ELSE 0.0 END) AS train_f1,
    avg(CASE WHEN l_linestatus='O' THEN 1.0 ELSE 0.0 END) AS validation_f1 FROM lineitem GROUP BY 1,2,3""",
)
METRICS = ("train_loss", "validation_loss", "train_f1", "validation_f1")


def history(t: Tables):
    """Shipped lines per year, supplier group and line number as rounds, clients and epochs."""
    client = F.concat(F.lit("client"), F.lpad((F.col("l_suppkey") % 15 + 1).cast("string"), 2, "0"))
    share = lambda c, v: F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    return t.lineitem.groupBy(
        (F.year("l_shipdate") - 1991).alias("round"),
        client.alias("client_id"),
        F.col("l_linenumber").alias("epoch"),
    ).agg(
        F.count(F.lit(1)).alias("num_examples"),
        (F.avg("l_discount") * 10).alias("train_loss"),
        (F.avg("l_tax") * 10).alias("validation_loss"),
        share("l_returnflag", "N").alias("train_f1"),
        share("l_linestatus", "O").alias("validation_f1"),
    )


def rounded(df, columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "d22_client_metric_summary",
    "D22",
    with_parts(
        "hist",
        " UNION ALL ".join(
            f"""SELECT round, '{m}' AS metric, count({e}) AS value_count, round(avg({e}),8) AS mean, round(CASE WHEN count({e})>1 THEN stddev_pop({e}) ELSE 0.0 END,8) AS population_stddev,
        round(min({e}),8) AS minimum, round(max({e}),8) AS maximum FROM hist GROUP BY round"""
            for m, e in [(m, m if m != "train_f1" else "CASE WHEN epoch<>3 THEN train_f1 END") for m in METRICS]
        ),
    ),
)
def client_metric_summary(t: Tables):
    rows = history(t).withColumn("train_f1", F.when(F.col("epoch") != 3, F.col("train_f1")))
    out = R.metric_summary(rows, ["round"], METRICS)
    return rounded(out, ["mean", "population_stddev", "minimum", "maximum"])


X.define(
    "runs",
    "SELECT client_id AS variant, round, avg(validation_f1) AS macro_f1, avg(validation_loss) AS loss FROM hist GROUP BY 1,2",
    "hist",
)
X.define(
    "variants",
    """SELECT variant, count(*) AS run_count, round(avg(macro_f1),8) AS macro_f1_mean, round(coalesce(stddev_samp(macro_f1),0.0),8) AS macro_f1_sample_std,
    round(avg(loss),8) AS loss_mean, round(coalesce(stddev_samp(loss),0.0),8) AS loss_sample_std FROM runs GROUP BY variant""",
    "runs",
)


def variant_runs(t: Tables):
    return history(t).groupBy(F.col("client_id").alias("variant"), "round").agg(
        F.avg("validation_f1").alias("macro_f1"), F.avg("validation_loss").alias("loss")
    )


def variant_summary(t: Tables):
    out = R.run_summary(variant_runs(t), "variant", ["macro_f1", "loss"])
    return rounded(out, [c for c in out.columns if c not in ("variant", "run_count")])


query("d23_repeated_run_summary", "D23", with_parts("variants", "SELECT * FROM variants"))(variant_summary)


@query(
    "w6_best_variant",
    "W6 H5",
    with_parts(
        "variants",
        "SELECT * FROM variants ORDER BY macro_f1_mean DESC, loss_mean, variant LIMIT 1",
    ),
)
def best_variant(t: Tables):
    return R.best_variant(variant_summary(t), "macro_f1_mean", "loss_mean", "variant")


@query(
    "d24_weighted_losses",
    "D24",
    with_parts(
        "hist",
        """SELECT round, sum(num_examples)::BIGINT AS total_examples, round(sum(train_loss*num_examples)/sum(num_examples),8) AS train_loss,
      round(sum(validation_loss*num_examples)/sum(num_examples),8) AS validation_loss FROM hist GROUP BY round""",
    ),
)
def weighted_losses(t: Tables):
    losses = ["train_loss", "validation_loss"]
    return rounded(R.weighted_losses(history(t), ["round"], losses, "num_examples"), losses)


@query(
    "d25_curve_by_epoch",
    "D25",
    with_parts(
        "hist",
        """SELECT epoch, 'validation_f1' AS metric, count(*) AS value_count, round(avg(validation_f1),8) AS mean, round(stddev_pop(validation_f1),8) AS population_stddev FROM hist GROUP BY epoch""",
    ),
)
def curve_by_epoch(t: Tables):
    out = R.metric_summary(history(t), ["epoch"], ["validation_f1"])
    return rounded(out, ["mean", "population_stddev"]).drop("minimum", "maximum")


@query(
    "d28_communication_bytes",
    "D28",
    """SELECT c_nationkey AS round, sum(length(c_name))::BIGINT AS upload_model_bytes, sum(length(c_mktsegment))::BIGINT AS upload_prototype_bytes,
      length(min(n_name))*count(*) AS broadcast_model_bytes, length(min(r_name))*count(*) AS broadcast_prototype_bytes,
      (sum(length(c_name))+sum(length(c_mktsegment))+length(min(n_name))*count(*)+length(min(r_name))*count(*))::BIGINT AS total_bytes
    FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY c_nationkey""",
)
def communication_bytes(t: Tables):
    uploads = t.customer.select(
        F.col("c_nationkey").alias("round"),
        F.octet_length("c_name").cast("bigint").alias("model_bytes"),
        F.octet_length("c_mktsegment").cast("bigint").alias("prototype_bytes"),
    )
    broadcasts = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("round"),
        F.octet_length("n_name").cast("bigint").alias("model_bytes"),
        F.octet_length("r_name").cast("bigint").alias("prototype_bytes"),
    )
    return R.communication(uploads, broadcasts, ["round"], "_clients")


@query(
    "w4_best_round",
    "W4",
    with_parts(
        "runs",
        """SELECT variant, round, round(f,6) AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f DESC, round) AS r FROM
      (SELECT variant, round, round(macro_f1,2) AS f FROM runs)) WHERE r=1""",
    ),
)
def best_round(t: Tables):
    rows = variant_runs(t).select("variant", "round", F.round("macro_f1", 2).alias("macro_f1"))
    return R.best_round(rows, ["variant"], "macro_f1")


@query(
    "w14_best_epoch",
    "W14",
    with_parts(
        "hist",
        """SELECT client_id, round, arg_min(epoch, (vl,epoch)) AS best_loss_epoch, min(vl) AS best_validation_loss, arg_min(epoch, (-vf,epoch)) AS best_f1_epoch, max(epoch) AS final_epoch,
      arg_max(vl,epoch)>min(vl)*1.05 AND arg_max(tl,epoch)<arg_min(tl,(vl,epoch)) AS possible_overfit
    FROM (SELECT *, round(validation_loss,6) AS vl, round(validation_f1,2) AS vf, round(train_loss,6) AS tl FROM hist) GROUP BY 1,2""",
    ),
)
def best_epoch(t: Tables):
    rows = rounded(history(t), ["validation_loss", "train_loss"], 6)
    return R.best_epoch(rounded(rows, ["validation_f1"], 2), ["client_id", "round"])


@query(
    "w5_best_candidate",
    "W5",
    with_parts(
        "hist",
        """SELECT round, client_id, epoch, f AS score FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY f DESC, epoch, client_id) AS r FROM
      (SELECT round, client_id, epoch, round(validation_f1,1) AS f FROM hist)) WHERE r=1""",
    ),
)
def best_candidate(t: Tables):
    rows = history(t).select("round", "client_id", "epoch", F.round("validation_f1", 1).alias("score"))
    return R.best_candidate(rows, ["round"], "score", "epoch", "client_id")


@query(
    "w7_best_profile",
    "W7",
    with_parts(
        "hist",
        """SELECT round, epoch, client_id, f AS score FROM (SELECT *, row_number() OVER (PARTITION BY round, epoch ORDER BY f DESC, client_id DESC) AS r FROM
      (SELECT round, client_id, epoch, round(validation_f1,1) AS f FROM hist)) WHERE r=1""",
    ),
)
def best_profile(t: Tables):
    rows = history(t).select("round", "client_id", "epoch", F.round("validation_f1", 1).alias("score"))
    return R.best_profile(rows, ["round", "epoch"], "score", "client_id")


def nested_history(t: Tables):
    """One record per round and client with its epochs nested; seven epochs per round."""
    epoch = F.struct("epoch", *METRICS)
    return history(t).groupBy("round", "client_id").agg(
        F.array_sort(F.collect_list(epoch)).alias("history"), F.lit(7).alias("epochs")
    )


@query(
    "f22_learning_curve",
    "F22",
    with_parts(
        "hist",
        f"SELECT client_id, round, CAST((round-1)*7+epoch AS INTEGER) AS global_local_epoch, epoch, {', '.join(f'round({m},8) AS {m}' for m in METRICS)} FROM hist",
    ),
)
def learning_curve(t: Tables):
    return rounded(R.learning_curve(nested_history(t), ["client_id"]), METRICS)


@query(
    "f22_client_curve_summary",
    "F22",
    with_parts(
        "hist",
        """SELECT client_id, count(*) AS epoch_count, round(arg_min(train_loss,(round-1)*7+epoch),8) AS first_train_loss, round(arg_max(train_loss,(round-1)*7+epoch),8) AS last_train_loss,
      round(arg_max(train_loss,(round-1)*7+epoch)-arg_min(train_loss,(round-1)*7+epoch),8) AS train_loss_change FROM hist GROUP BY client_id""",
    ),
)
def client_curve_summary(t: Tables):
    curve = R.learning_curve(nested_history(t), ["client_id"])
    out = R.client_summary(curve, ["train_loss"])
    return rounded(out, ["first_train_loss", "last_train_loss", "train_loss_change"])


@query(
    "f23_sweep_comparability",
    "F23",
    """SELECT r_name, field, value_count, value_count=1 AS comparable FROM (
      SELECT r_name, 'n_regionkey' AS field, count(DISTINCT n_regionkey) AS value_count FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1
      UNION ALL SELECT r_name, 'n_name', count(DISTINCT n_name) FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1
      UNION ALL SELECT r_name, 'initial', count(DISTINCT substr(n_name,1,1)) FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1)""",
)
def sweep_comparability(t: Tables):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("initial", F.substring("n_name", 1, 1))
    return R.comparability(rows, ["r_name"], ["n_regionkey", "n_name", "initial"])


@query(
    "s5_sweep_grid",
    "S5 B22",
    """SELECT DISTINCT 'f'||f||'-scale-'||replace(rtrim(CAST(CAST(scale AS DECIMAL(20,6)) AS VARCHAR),'0'),'.','p') AS scenario_id, f, scale, f=3 AND scale=0.05 AS primary_anchor FROM
      (SELECT l_linenumber AS f, 0.05::DOUBLE AS scale FROM lineitem UNION SELECT 3, l_discount FROM lineitem WHERE l_discount>0)""",
)
def sweep_grid(t: Tables):
    f_values = t.lineitem.select(F.col("l_linenumber").alias("f")).distinct()
    scales = t.lineitem.where("l_discount > 0").select(F.col("l_discount").alias("scale")).distinct()
    return R.sweep_grid(f_values, scales, fixed_f=3, fixed_scale=0.05)


# Conditions: the first f clients report class 3 as class 7 for a share of its rows.
SOURCE, TARGET = 3, 7
SCENARIOS = (("clean", 0, 0.0), ("f1-scale-1p0", 1, 1.0), ("f3-scale-0p5", 3, 0.5), ("f3-scale-1p0", 3, 1.0))
STRATEGIES = ("support_weighted_mean", "coordinate_median")
X.define(
    "cond",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS condition, vec_id, client_id, pos, v, CASE WHEN class={SOURCE} AND vec_id%15<{f} AND (vec_id//15)%4<{int(4 * s)} THEN {TARGET} ELSE class END AS class FROM veclong"""
        for name, f, s in SCENARIOS
    ),
    "veclong",
)
X.define(
    "cproto",
    "SELECT condition, client_id, class, pos, avg(v) AS v, count(*) AS support FROM cond GROUP BY 1,2,3,4",
    "cond",
)
X.define(
    "models",
    f"""SELECT condition, '{STRATEGIES[0]}' AS strategy, class, pos, sum(v*support)/sum(support) AS c FROM cproto GROUP BY 1,3,4
  UNION ALL SELECT condition, '{STRATEGIES[1]}', class, pos, median(v) FROM cproto GROUP BY 1,3,4""",
    "cproto",
)
X.define(
    "mpred",
    """SELECT condition, strategy, vec_id, split, actual, arg_min(proto, (d, proto)) AS predicted FROM
  (SELECT m.condition, m.strategy, vec_id, v.split, v.class AS actual, m.class AS proto, sum((v.v-m.c)*(v.v-m.c)) AS d FROM veclong v JOIN models m USING (pos) WHERE v.split<>'train' GROUP BY ALL) GROUP BY ALL""",
    "veclong models",
)
X.define(
    "mpc",
    """SELECT condition, strategy, split, class, sum(s) AS support, sum(t) AS correct, sum(p) AS predicted_count, CASE WHEN sum(s)+sum(p)=0 THEN 0.0 ELSE 2*sum(t)/(sum(s)+sum(p)) END AS f1 FROM
  (SELECT condition, strategy, split, actual AS class, 1 AS s, CASE WHEN actual=predicted THEN 1 ELSE 0 END AS t, 0 AS p FROM mpred
   UNION ALL SELECT condition, strategy, split, predicted, 0, 0, 1 FROM mpred) GROUP BY ALL""",
    "mpred",
)
X.define(
    "outcomes",
    f"""SELECT condition, strategy, split, sum(f1)/10 AS macro_f1, sum(correct)/sum(support) AS accuracy,
    (SELECT count(*) FILTER (predicted={SOURCE})/count(*) FROM mpred q WHERE q.condition=p.condition AND q.strategy=p.strategy AND q.split=p.split AND actual={SOURCE}) AS source_recall,
    (SELECT count(*) FILTER (predicted={TARGET})/count(*) FROM mpred q WHERE q.condition=p.condition AND q.strategy=p.strategy AND q.split=p.split AND actual={SOURCE}) AS targeted_rate
  FROM mpc p GROUP BY condition, strategy, split""",
    "mpc mpred",
)


def condition_prototypes(t: Tables):
    """(condition, client, class) prototypes of every scenario, from one pass over the rows."""
    rows = X.vectors(t)
    place = F.pmod("vec_id", F.lit(15))
    slice_ = F.floor(F.col("vec_id") / 15) % 4
    cells = []
    for name, f, share in SCENARIOS:
        hit = (F.col("class") == SOURCE) & (place < f) & (slice_ < int(4 * share))
        cells.append(F.struct(F.lit(name).alias("condition"), F.when(hit, TARGET).otherwise(F.col("class")).alias("class")))
    spread = rows.select("client_id", "vector", F.inline(F.array(*cells)))
    return V.mean_vector(spread, ["condition", "client_id", "class"], "vector", "vector", X.WIDTH, count="support")


def condition_models(t: Tables):
    return t.stored("condition-models", build_condition_models)


def build_condition_models(t: Tables):
    """Global prototypes (condition, strategy, class, vector) under both aggregations."""
    local = condition_prototypes(t)
    keys = ["condition", "class"]
    mean = V.mean_vector(local, keys, "vector", "vector", X.WIDTH, weight="support")
    long = V.coordinates(local, keys, "vector").groupBy(*keys, "pos").agg(F.median("value").alias("value"))
    median = V.gather(long, keys, "value", "vector")
    return mean.withColumn("strategy", F.lit(STRATEGIES[0])).unionByName(
        median.withColumn("strategy", F.lit(STRATEGIES[1]))
    )


def outcomes(t: Tables):
    return t.stored("outcomes", build_outcomes)


def build_outcomes(t: Tables):
    """Metrics of every scenario and strategy on the evaluation splits."""
    models = condition_models(t).withColumn("model_id", F.concat_ws("|", "condition", "strategy"))
    rows = X.vectors(t).where("split <> 'train'").select("vec_id", "split", "class", "vector")
    scored = P.nearest_per_model(rows.withColumnRenamed("class", "actual"), models, "vector")
    keys = ["model_id", "split"]
    matrix = M.confusion_matrix(scored, CLASSES, keys, "actual", "nearest_class")
    overall = M.overall_metrics(M.class_metrics(matrix, keys), keys).select(*keys, "macro_f1", "accuracy")
    source = M.source_integrity(matrix, SOURCE, TARGET, keys).select(*keys, "source_recall", "targeted_rate")
    name = F.split("model_id", r"\|")
    return overall.join(source, keys).select(
        name[0].alias("condition"),
        name[1].alias("strategy"),
        "split",
        "macro_f1",
        "accuracy",
        "source_recall",
        "targeted_rate",
    )


OUTCOME_METRICS = ("macro_f1", "accuracy", "source_recall", "targeted_rate")


@query(
    "f16_attack_effects",
    "F16 J9",
    with_parts(
        "outcomes",
        "SELECT a.condition, a.strategy, a.split, "
        + ", ".join(f"round(a.{m}-c.{m},8) AS {m}_delta, round(a.{m},8) AS attacked_{m}" for m in OUTCOME_METRICS)
        + " FROM outcomes a JOIN outcomes c USING (strategy, split) WHERE a.condition<>'clean' AND c.condition='clean'",
    ),
)
def attack_effects(t: Tables):
    out = R.attack_effects(outcomes(t), ["strategy", "split"], OUTCOME_METRICS)
    return rounded(out, [c for c in out.columns if c not in ("condition", "strategy", "split")])


X.define(
    "sens",
    """SELECT a.condition AS scenario_id, CASE WHEN a.strategy='coordinate_median' THEN 'robust' ELSE 'baseline' END AS profile, a.strategy,
    a.source_recall-c.source_recall AS recall_delta, a.macro_f1-c.macro_f1 AS macro_f1_delta, a.source_recall AS attacked_recall, a.targeted_rate AS attacked_targeted_rate
  FROM outcomes a JOIN outcomes c USING (strategy, split) WHERE a.condition<>'clean' AND c.condition='clean' AND split='test'""",
    "outcomes",
)


def sensitivity_rows(t: Tables):
    effects = R.attack_effects(outcomes(t).where("split = 'test'"), ["strategy"], OUTCOME_METRICS)
    return effects.select(
        F.col("condition").alias("scenario_id"),
        F.when(F.col("strategy") == STRATEGIES[1], "robust").otherwise("baseline").alias("profile"),
        "strategy",
        F.col("source_recall_delta").alias("recall_delta"),
        "macro_f1_delta",
        F.col("attacked_source_recall").alias("attacked_recall"),
        F.col("attacked_targeted_rate"),
    )


_SENS = ("recall_delta", "macro_f1_delta", "attacked_recall", "attacked_targeted_rate")


@query(
    "f21_sensitivity_table",
    "F21",
    with_parts(
        "sens",
        f"SELECT scenario_id, profile, strategy, {', '.join(f'round({c},8) AS {c}' for c in _SENS)} FROM sens",
    ),
)
def sensitivity_table(t: Tables):
    return rounded(sensitivity_rows(t), _SENS)


@query(
    "w11_sensitivity_extrema",
    "W11 F21",
    with_parts(
        "sens",
        """SELECT arg_min(scenario_id,(recall_delta,scenario_id)) FILTER (profile='baseline') AS worst_scenario_id, round(min(recall_delta) FILTER (profile='baseline'),8) AS worst_recall_delta,
      round(arg_min(attacked_recall,(recall_delta,scenario_id)) FILTER (profile='baseline'),8) AS worst_attacked_recall,
      round(max(abs(recall_delta)) FILTER (profile='robust'),8) AS largest_robust_recall_change, round(max(attacked_targeted_rate),8) AS largest_targeted_rate FROM sens""",
    ),
)
def sensitivity_extrema(t: Tables):
    out = R.sensitivity_extrema(sensitivity_rows(t), "baseline", "robust")
    return rounded(out, [c for c in out.columns if c != "worst_scenario_id"])


# Client models: prototypes from a client's own rows, judged on rows the client never saw.
X.define(
    "cmodel",
    "SELECT client_id AS model_id, class, pos, avg(v) AS c FROM veclong WHERE split='train' GROUP BY 1,2,3 UNION ALL SELECT 'base', class, pos, c FROM cent",
    "veclong cent",
)


def client_models(t: Tables):
    return t.stored("client-models", build_client_models)


def build_client_models(t: Tables):
    own = V.mean_vector(
        X.vectors(t).where("split = 'train'"), ["client_id", "class"], "vector", "vector", X.WIDTH
    ).withColumnRenamed("client_id", "model_id")
    return own.unionByName(train_prototypes(t).withColumn("model_id", F.lit("base")).select(*own.columns))


@query(
    "f15_validation_impact",
    "F15",
    with_parts(
        "cmodel",
        """, p AS (SELECT model_id, actual, arg_min(proto,(d,proto)) AS predicted FROM (SELECT m.model_id, vec_id, v.class AS actual, m.class AS proto, sum((v.v-m.c)*(v.v-m.c)) AS d
      FROM veclong v JOIN cmodel m USING (pos) WHERE v.split='validation' GROUP BY ALL) GROUP BY model_id, vec_id, actual),
    f AS (SELECT model_id, sum(f1)/10 AS f FROM (SELECT model_id, class, CASE WHEN sum(s)+sum(q)=0 THEN 0.0 ELSE 2*sum(t)/(sum(s)+sum(q)) END AS f1 FROM
      (SELECT model_id, actual AS class, 1 AS s, CASE WHEN actual=predicted THEN 1 ELSE 0 END AS t, 0 AS q FROM p UNION ALL SELECT model_id, predicted, 0, 0, 1 FROM p) GROUP BY 1,2) GROUP BY 1)
    SELECT a.model_id, round(a.f,8) AS validation_macro_f1, round(b.f-a.f,8) AS validation_impact FROM f a, f b WHERE b.model_id='base' AND a.model_id<>'base'""",
    ),
)
def validation_impact(t: Tables):
    rows = X.vectors(t).where("split = 'validation'").select("vec_id", F.col("class").alias("actual"), "vector")
    scored = P.nearest_per_model(rows, client_models(t), "vector")
    metrics = M.evaluate(scored, CLASSES, ["model_id"], "actual", "nearest_class")
    base = metrics.where("model_id = 'base'").select("macro_f1").scalar()
    return metrics.where("model_id <> 'base'").select(
        "model_id",
        F.round("macro_f1", 8).alias("validation_macro_f1"),
        F.round(base - F.col("macro_f1"), 8).alias("validation_impact"),
    )


@query(
    "f14_triggered_success",
    "F14 C8",
    with_parts(
        "cmodel",
        """, p AS (SELECT model_id, arg_min(proto,(d,proto)) AS predicted FROM (SELECT m.model_id, vec_id, m.class AS proto, sum(((CASE WHEN v.pos<4 THEN 0.4 ELSE v.v END)-m.c)*((CASE WHEN v.pos<4 THEN 0.4 ELSE v.v END)-m.c)) AS d
      FROM veclong v JOIN cmodel m USING (pos) WHERE v.split='test' AND v.class<>7 GROUP BY ALL) GROUP BY model_id, vec_id),
    s AS (SELECT model_id, count(*) AS n, count(*) FILTER (predicted=7) AS k FROM p GROUP BY 1)
    SELECT a.model_id, a.n AS triggered_rows, a.k AS success_count, round(a.k/a.n,8) AS success_rate, round(a.k/a.n-b.k/b.n,8) AS success_rate_lift FROM s a, s b WHERE b.model_id='base' AND a.model_id<>'base'""",
    ),
)
def triggered_success(t: Tables):
    test = X.vectors(t).where("split = 'test'").select("vec_id", F.col("class").alias("label"), "vector")
    eligible = selection.triggered_set(test, values={}, target=TARGET)
    marked = eligible.withColumn(
        "vector", F.concat(F.array_repeat(F.lit(0.4), 4), F.slice("vector", 5, X.WIDTH - 4))
    )
    scored = P.nearest_per_model(marked, client_models(t), "vector")
    rates = M.success_rate(scored, "nearest_class", TARGET, ["model_id"])
    base = rates.where("model_id = 'base'").select("success_rate").scalar()
    return rates.where("model_id <> 'base'").select(
        "model_id",
        "triggered_rows",
        "success_count",
        F.round("success_rate", 8).alias("success_rate"),
        F.round(F.col("success_rate") - base, 8).alias("success_rate_lift"),
    )


X.define(
    "hpc",
    """SELECT client_id, class, kind, sum(s) AS support, CASE WHEN sum(s)+sum(q)=0 THEN 0.0 ELSE 2*sum(t)/(sum(s)+sum(q)) END AS f1 FROM
  (SELECT client_id, kind, actual AS class, 1 AS s, CASE WHEN actual=p THEN 1 ELSE 0 END AS t, 0 AS q FROM ev UNION ALL SELECT client_id, kind, p, 0, 0, 1 FROM ev) GROUP BY 1,2,3""",
    "ev",
)
X.define(
    "ev",
    "SELECT client_id, actual, 'near' AS kind, predicted AS p FROM head UNION ALL SELECT client_id, actual, 'head', head FROM head UNION ALL SELECT client_id, actual, 'second', second_class FROM head",
    "head",
)


@query(
    "f24_client_class_analysis",
    "F24 J8 B13",
    with_parts(
        "hpc vec",
        """SELECT g.client_id, g.class, g.n AS training_support, CASE WHEN n=0 THEN 'absent' WHEN n<5 THEN 'rare' ELSE 'supported' END AS support_category,
      round(coalesce(a.f1,0),8) AS candidate_f1, round(coalesce(h.f1,0),8) AS head_f1, round(coalesce(b.f1,0),8) AS baseline_f1,
      round(coalesce(a.f1,0)-coalesce(b.f1,0),8) AS candidate_delta, round(coalesce(h.f1,0)-coalesce(b.f1,0),8) AS head_delta
    FROM (SELECT c.client_id, k.class, count(vec.vec_id) AS n FROM (SELECT DISTINCT client_id FROM vec) c CROSS JOIN (SELECT unnest(range(10))::INTEGER AS class) k
        LEFT JOIN vec ON vec.client_id=c.client_id AND vec.class=k.class AND vec.split='train' GROUP BY 1,2) g
      LEFT JOIN hpc a ON a.client_id=g.client_id AND a.class=g.class AND a.kind='near' LEFT JOIN hpc h ON h.client_id=g.client_id AND h.class=g.class AND h.kind='head'
      LEFT JOIN hpc b ON b.client_id=g.client_id AND b.class=g.class AND b.kind='second'""",
    ),
)
def client_class_analysis(t: Tables):
    rows = predictions(t).withColumn("head", V.argmax(F.slice("vector", 1, 10)))
    _, supports = P.local_prototypes(
        X.vectors(t).where("split = 'train'"), "vector", X.WIDTH, 1, CLASSES
    )
    per = [
        M.class_metrics(M.confusion_matrix(rows, CLASSES, ["client_id"], "actual", c), ["client_id"])
        for c in ("predicted", "head", "second_class")
    ]
    out = R.client_class_analysis(supports, *per)
    return rounded(out, ["candidate_f1", "head_f1", "baseline_f1", "candidate_delta", "head_delta"])


@query(
    "f19_endpoint_comparison",
    "F19",
    with_parts(
        "mpc",
        """, o AS (SELECT condition, strategy, split, sum(f1)/10 AS macro_f1, sum(correct)/sum(support) AS accuracy FROM mpc GROUP BY 1,2,3)
    SELECT a.split, round(a.macro_f1,8) AS macro_f1, round(a.accuracy,8) AS accuracy, round(a.macro_f1-b.macro_f1,8) AS macro_f1_delta, round(a.accuracy-b.accuracy,8) AS accuracy_delta
    FROM o a JOIN o b USING (split) WHERE a.condition='clean' AND b.condition='clean' AND a.strategy='coordinate_median' AND b.strategy='support_weighted_mean'""",
    ),
)
def endpoint_comparison(t: Tables):
    clean = outcomes(t).where("condition = 'clean'")
    out = R.deltas(
        clean.where(F.col("strategy") == STRATEGIES[1]),
        clean.where(F.col("strategy") == STRATEGIES[0]),
        ["split"],
        ["macro_f1", "accuracy"],
    )
    return rounded(out, ["macro_f1", "accuracy", "macro_f1_delta", "accuracy_delta"])
