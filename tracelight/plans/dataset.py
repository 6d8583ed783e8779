"""Queries on auditing, consolidation, windows, splits, sampling, partitions and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators import (
    consolidation,
    partitioning,
    profiling,
    selection,
    splitting,
    transforms,
    windows,
)
from tracelight.operators.ranking import exact_quantiles, range_ranked, slot_ranked
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.standins import with_parts

IDENTITY = ["l_orderkey", "l_linenumber"]
FEATURES = windows.FEATURES


@query(
    "c1_normalized_connections",
    "C1",
    with_parts(
        "conn",
        """SELECT event_id, timestamp, capture_id, uid, originator_host, responder_host, responder_port, protocol, service,
      connection_state, duration, originator_bytes, responder_bytes, originator_packets, responder_packets, label FROM conn""",
    ),
)
def normalized_connections(t: Tables):
    return X.connections(t).drop("user_id")


@query(
    "c2_split_rows",
    "C2",
    with_parts(
        "rows",
        "SELECT window_id, capture_id, label, observed_labels FROM rows WHERE split='validation'",
    ),
)
def split_filter(t: Tables):
    rows = X.split_rows(t).where("split = 'validation'")
    return rows.select(
        "window_id", "capture_id", "label", F.array_join("observed_labels", ",").alias("observed_labels")
    )


@query(
    "c3_first_windows_by_id",
    "C3",
    with_parts(
        "rows",
        "SELECT window_id, split FROM rows WHERE split='test' ORDER BY window_id LIMIT 25",
    ),
)
def first_windows(t: Tables):
    rows = X.split_rows(t).where("split = 'test'")
    return selection.first_by_id(rows.select("window_id", "split"), 25)


@query(
    "c3_explicit_ids_found",
    "C3",
    """SELECT key, key IN (SELECT l_orderkey FROM lineitem) AS found
    FROM (SELECT DISTINCT o_orderkey+CASE WHEN o_orderkey%50=0 THEN 10000000 ELSE 0 END AS key FROM orders WHERE o_orderpriority='1-URGENT')""",
)
def explicit_ids_found(t: Tables):
    moved = F.when(F.col("o_orderkey") % 50 == 0, F.lit(10_000_000)).otherwise(F.lit(0))
    wanted = t.orders.where("o_orderpriority = '1-URGENT'").select(
        (F.col("o_orderkey") + moved).alias("key")
    )
    return selection.select_ids(t.lineitem.withColumnRenamed("l_orderkey", "key"), wanted, "key")


@query(
    "c4_shared_table_guard",
    "C4 I17",
    with_parts(
        "scaled",
        f"SELECT window_id, label, {', '.join(f'round({c},6) AS {c}' for c in FEATURES)} FROM scaled",
    ),
)
def shared_table_guard(t: Tables):
    shared = partitioning.shared_table(X.scaled_rows(t), FEATURES, ["window_id", "label"])
    return shared.select("window_id", "label", *[F.round(c, 6).alias(c) for c in FEATURES])


@query(
    "c5_unknown_labels",
    "C5",
    with_parts(
        "rec",
        """SELECT DISTINCT label_technique FROM rec WHERE l_shipdate>=DATE '2000-01-01' AND label_technique NOT IN
      (SELECT label_technique FROM rec WHERE l_shipdate<DATE '2000-01-01' AND label_technique<>'T1003')""",
    ),
)
def unknown_labels(t: Tables):
    rows = X.labelled_records(t)
    later = rows.where("l_shipdate >= timestamp_ntz'2000-01-01'")
    earlier = rows.where("l_shipdate < timestamp_ntz'2000-01-01' AND label_technique <> 'T1003'")
    return selection.unknown_labels(later, earlier, "label_technique")


@query(
    "c6_relabelled_counts",
    "C6",
    with_parts(
        "rows",
        """SELECT split, CASE WHEN label='error' THEN 'signup' ELSE label END AS label, count(*) AS row_count,
      count(*) FILTER (label='error') AS changed_count FROM rows GROUP BY 1,2""",
    ),
)
def relabelled_counts(t: Tables):
    rows = selection.relabel(X.split_rows(t), "error", "signup")
    return rows.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("relabelled").alias("changed_count")
    )


@query(
    "c7_perturbed_share",
    "C7",
    with_parts(
        "rows",
        """SELECT window_id, CASE WHEN chosen THEN 'benign' ELSE label END AS label, chosen AS perturbed,
      CASE WHEN chosen THEN 9.5 ELSE duration_max END AS duration_max
    FROM (SELECT *, row_number() OVER (ORDER BY sha256('7:'||window_id), window_id)<=greatest(1,ceil(count(*) OVER ()*0.15)) AS chosen
      FROM rows WHERE split='train')""",
    ),
)
def perturbed_share(t: Tables):
    train = X.split_rows(t).where("split = 'train'")
    out = selection.perturb_fraction(
        train, values={"duration_max": 9.5}, target="benign", fraction=0.15, seed=7
    )
    return out.select("window_id", "label", "perturbed", "duration_max")


@query(
    "c8_triggered_evaluation_set",
    "C8",
    with_parts(
        "rows",
        """SELECT label AS original_label, count(*) AS row_count, 3.0*count(*) AS trigger_sum FROM rows
      WHERE split='test' AND label<>'benign' GROUP BY label""",
    ),
)
def triggered_evaluation_set(t: Tables):
    test = X.split_rows(t).where("split = 'test'")
    out = selection.triggered_set(test, values={"service_dns_fraction": 3.0}, target="benign")
    return out.groupBy("original_label").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("service_dns_fraction").alias("trigger_sum")
    )


LABEL_FIELDS = ["label_tactic", "label_technique", "label_binary", "label_cve"]


@query(
    "d1_missing_profile",
    "D1",
    with_parts(
        "rec",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER (CAST({c} AS VARCHAR) IN ('','-')) AS missing_count,
        round(count(*) FILTER (CAST({c} AS VARCHAR) IN ('','-'))/count(*),12) AS missing_rate FROM rec"""
            for c in [*LABEL_FIELDS, "source_file"]
        ),
    ),
)
def missing_profile(t: Tables):
    out = profiling.missing_profile(X.labelled_records(t), [*LABEL_FIELDS, "source_file"])
    return out.withColumn("missing_rate", F.round("missing_rate", 12))


@query(
    "d2_label_value_counts",
    "D2",
    with_parts(
        "rec",
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, {c} AS value, count(*) AS row_count FROM rec GROUP BY 2"
            for c in LABEL_FIELDS
        ),
    ),
)
def label_value_counts(t: Tables):
    return profiling.value_counts(X.labelled_records(t), LABEL_FIELDS)


@query(
    "d3_label_time_ranges",
    "D3",
    with_parts(
        "rec",
        """SELECT tactic, strftime(min(l_shipdate),'%Y-%m-%d') AS observed_start, strftime(max(l_shipdate),'%Y-%m-%d') AS observed_end,
      count(*) AS row_count FROM rec GROUP BY tactic""",
    ),
)
def label_time_ranges(t: Tables):
    out = profiling.label_ranges(X.labelled_records(t), "tactic", "l_shipdate")
    return out.withColumn("observed_start", S.calendar_day("observed_start")).withColumn(
        "observed_end", S.calendar_day("observed_end")
    )


@query(
    "d4_daily_label_counts",
    "D4",
    with_parts("conn", "SELECT capture_id AS day, label, count(*) AS row_count FROM conn GROUP BY 1,2"),
)
def daily_label_counts(t: Tables):
    rows = t.events.select(
        "ts", F.when(F.col("event_type") == "view", "benign").otherwise(F.col("event_type")).alias("label")
    )
    return profiling.daily_counts(rows, S.calendar_day("ts"), "label")


@query(
    "d5_duplicates_and_identities",
    "D5 D6",
    """SELECT count(*) AS row_count, count(*)-(SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS exact_duplicate_rows,
      count(DISTINCT text) AS distinct_identities FROM documents""",
)
def duplicates_and_identities(t: Tables):
    return profiling.duplicate_summary(t.documents, ["text", "lang", "source"], ["text"])


# Hashes a sketch keeps, as powers of two: always an estimate, sometimes, hardly ever.
SKETCH_SIZES = (8, 12, 16)


@query(
    "d6_approximate_identities",
    "D6",
    "SELECT count(*) AS row_count, true AS within_tenth FROM lineitem",
)
def approximate_identities(t: Tables):
    """The sketch count next to the exact one: equal to within a tenth."""
    sketch = profiling.duplicate_summary(t.lineitem, t.lineitem.columns, IDENTITY, approximate=True)
    exact = profiling.duplicate_summary(t.lineitem, t.lineitem.columns, IDENTITY)
    known = exact.select("distinct_identities").scalar()
    error = F.abs(F.col("distinct_identities") / known - 1)
    return sketch.select("row_count", (error < 0.1).alias("within_tenth"))


@query(
    "d6_identity_sketches",
    "D6 D10",
    f"""WITH sizes AS (SELECT unnest({list(SKETCH_SIZES)}) AS size_log2),
    counted AS (SELECT l_returnflag AS part, count(*) AS row_count, count(DISTINCT l_orderkey) AS identities FROM lineitem GROUP BY 1
      UNION ALL SELECT 'all', count(*), count(DISTINCT l_orderkey) FROM lineitem
      UNION ALL SELECT 'N without A', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag='N'
        AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='A'))
    SELECT size_log2, part, CASE WHEN part<>'N without A' THEN row_count ELSE 0 END AS row_count, identities,
      CASE WHEN part<>'N without A' AND identities<=2**size_log2 THEN CAST(identities AS DOUBLE) ELSE 0.0 END AS exact_estimate, true AS within_bound
    FROM counted, sizes""",
)
def identity_sketches(t: Tables):
    """Stored sketches per part, merged and subtracted, at three sizes; each estimate against its own bound.

    Counts that a sketch holds exactly are compared as they are, others (0 here) by their error.
    """
    first, second = (t.lineitem.where(F.col("l_returnflag") == m) for m in ("N", "A"))
    left = first.select("l_orderkey").distinct().join(second, "l_orderkey", "left_anti")
    exact = (
        t.lineitem.groupBy(F.col("l_returnflag").alias("part")).agg(F.count_distinct("l_orderkey").alias("identities"))
        .unionByName(t.lineitem.agg(F.lit("all").alias("part"), F.count_distinct("l_orderkey").alias("identities")))
        .unionByName(left.agg(F.lit("N without A").alias("part"), F.count(F.lit(1)).alias("identities")))
    )
    estimates = None
    for size in SKETCH_SIZES:
        parts = t.stored(
            f"identity-sketches-{size}",
            lambda t, n=size: profiling.identity_sketches(t.lineitem, ["l_returnflag"], ["l_orderkey"], n),
        ).withColumnRenamed("l_returnflag", "part")
        whole = profiling.merged_sketches(parts, size_log2=size).withColumn("part", F.lit("all"))
        both = parts.where("part IN ('N', 'A')").agg(
            *[F.max(F.when(F.col("part") == m, F.col("sketch"))).alias(m) for m in ("N", "A")]
        )
        rest = both.where("N IS NOT NULL AND A IS NOT NULL").select(
            F.lit("N without A").alias("part"),
            F.lit(0).cast("bigint").alias("row_count"),
            profiling.only_in_first("N", "A").alias("sketch"),
            F.theta_sketch_estimate(F.theta_union("N", "A", size)).alias("union_estimate"),
        )
        own = parts.unionByName(whole).unionByName(rest, allowMissingColumns=True)
        own = own.withColumn("size_log2", F.lit(size)).withColumn("estimate", F.theta_sketch_estimate("sketch"))
        estimates = own if estimates is None else estimates.unionByName(own)
    both = estimates.join(exact, "part")
    union = F.coalesce("union_estimate", "identities")
    bound = profiling.sketch_bound(F.col("size_log2"), F.col("identities"), union)
    small = F.col("union_estimate").isNull() & (bound == 0)
    return both.select(
        "size_log2", "part", "row_count", "identities",
        F.when(small, F.col("estimate").cast("double")).otherwise(0.0).alias("exact_estimate"),
        (F.abs(F.col("estimate") / F.col("identities") - 1) <= bound).alias("within_bound"),
    )


@query(
    "d7_conflicting_label_sets",
    "D7",
    with_parts(
        "rec",
        """SELECT labels, count(*) AS identity_count FROM (SELECT string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS labels
      FROM rec GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT tactic)>1) GROUP BY labels""",
    ),
)
def conflicting_label_sets(t: Tables):
    out = profiling.conflicting_labels(X.labelled_records(t), IDENTITY, "tactic")
    return out.withColumn("labels", F.array_join("labels", ","))


@query(
    "d8_rare_labels",
    "D8",
    """SELECT label, row_count FROM (SELECT p_brand||'/'||p_type AS label, count(*) AS row_count FROM part GROUP BY 1) WHERE row_count<100""",
)
def rare_labels(t: Tables):
    rows = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("label"))
    return profiling.rare_labels(rows, "label", 100)


@query(
    "d9_temporal_separation",
    "D9",
    """SELECT b0 AS benign_start, b1 AS benign_end, a0 AS attack_start, a1 AS attack_end, b0>a1 OR a0>b1 AS separated FROM
    (SELECT min(o_orderkey) FILTER (o_orderstatus='F') AS b0, max(o_orderkey) FILTER (o_orderstatus='F') AS b1,
      min(o_orderkey) FILTER (o_orderstatus<>'F') AS a0, max(o_orderkey) FILTER (o_orderstatus<>'F') AS a1 FROM orders)""",
)
def temporal_separation(t: Tables):
    return profiling.temporal_separation(t.orders, "o_orderstatus", "o_orderkey", "F")


@query(
    "d10_file_profile",
    "D10",
    with_parts(
        "rec",
        """SELECT source_file, count(*) AS row_count, strftime(min(l_shipdate),'%Y-%m-%d') AS observed_start, strftime(max(l_shipdate),'%Y-%m-%d') AS observed_end,
      count(DISTINCT tactic) AS label_count, count(*) FILTER (label_cve='-') AS missing_cells FROM rec GROUP BY 1""",
    ),
)
def file_profile(t: Tables):
    out = profiling.file_profile(
        X.labelled_records(t), "source_file", "l_shipdate", "tactic", LABEL_FIELDS
    )
    return out.withColumn("observed_start", S.calendar_day("observed_start")).withColumn(
        "observed_end", S.calendar_day("observed_end")
    )


@query(
    "d11_risk_flags",
    "D11 S3",
    with_parts(
        "rec",
        """SELECT risk, n AS evidence_count, n>0 AS present FROM (
      SELECT 'time-label' AS risk, (SELECT CAST((min(l_shipdate) FILTER (tactic='benign')>max(l_shipdate) FILTER (tactic<>'benign')) OR (min(l_shipdate) FILTER (tactic<>'benign')>max(l_shipdate) FILTER (tactic='benign')) AS BIGINT) FROM rec) AS n
      UNION ALL SELECT 'cross-label', (SELECT count(*) FROM (SELECT 1 FROM rec GROUP BY l_orderkey,l_linenumber HAVING count(DISTINCT tactic)>1))
      UNION ALL SELECT 'duplicate-marker', (SELECT count(*) FROM rec WHERE lower(label_technique)='duplicate')
      UNION ALL SELECT 'rare-class', (SELECT count(*) FROM (SELECT 1 FROM rec GROUP BY tactic HAVING count(*)<100)))""",
    ),
)
def risk_flags(t: Tables):
    return profiling.risk_flags(
        X.labelled_records(t),
        identity=IDENTITY,
        label="tactic",
        moment="l_shipdate",
        technique="label_technique",
    )


X.define(
    "events1",
    """SELECT l_orderkey, l_linenumber, string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS observed_tactics,
  list_sort(list_distinct(list(tactic) FILTER (tactic<>'benign'))) AS attacks,
  list_sort(list_distinct(list(tactic) FILTER (tactic<>'benign' AND lower(label_binary)<>'duplicate'))) AS prim,
  coalesce(string_agg(DISTINCT label_technique, ',' ORDER BY label_technique) FILTER (lower(label_technique) NOT IN ('none','duplicate')),'') AS observed_techniques,
  count(*) AS source_record_count, min(source_file) AS first_file,
  sha256('["'||l_orderkey||'","'||l_linenumber||'"]') AS identity_sha256
FROM rec GROUP BY l_orderkey, l_linenumber""",
    "rec",
)
TARGETS = "['credential_access','exfiltration','initial_access','reconnaissance']"


@query(
    "d12_consolidated_any_attack",
    "D12",
    with_parts(
        "events1",
        """SELECT 'event-central-'||substr(identity_sha256,1,20) AS event_id, observed_tactics, observed_techniques, source_record_count, first_file,
      CASE coalesce(len(attacks),0) WHEN 0 THEN 'benign' WHEN 1 THEN attacks[1] ELSE 'multi_tactic' END AS label FROM events1""",
    ),
)
def consolidated_any_attack(t: Tables):
    out = consolidation.consolidate(
        X.labelled_records(t),
        identity=IDENTITY,
        tactic="tactic",
        technique="label_technique",
        binary="label_binary",
        source=["source_file", "l_partkey"],
        rule="any",
    )
    return out.select(
        "event_id",
        F.array_join("observed_tactics", ",").alias("observed_tactics"),
        F.array_join("observed_techniques", ",").alias("observed_techniques"),
        "source_record_count",
        F.col("first_source.source_file").alias("first_file"),
        "label",
    )


@query(
    "d13_consolidated_primary_tactic",
    "D13 S2",
    with_parts(
        "events1",
        f"""SELECT 'event-central-'||substr(identity_sha256,1,20) AS event_id, identity_sha256, coalesce(list_aggregate(prim,'string_agg',','),'') AS primary_tactics,
      CASE WHEN coalesce(len(attacks),0)=0 THEN 'benign'
        WHEN coalesce(len(list_intersect(prim,{TARGETS})),0)=1 THEN list_intersect(prim,{TARGETS})[1]
        WHEN coalesce(len(prim),0)>0 THEN 'multi_tactic'
        WHEN len(list_intersect(attacks,{TARGETS}))=1 THEN list_intersect(attacks,{TARGETS})[1] ELSE 'multi_tactic' END AS label FROM events1""",
    ),
)
def consolidated_primary_tactic(t: Tables):
    out = consolidation.consolidate(
        X.labelled_records(t),
        identity=IDENTITY,
        tactic="tactic",
        technique="label_technique",
        binary="label_binary",
        source=["source_file", "l_partkey"],
    )
    return out.select(
        "event_id",
        "identity_sha256",
        F.array_join("primary_tactics", ",").alias("primary_tactics"),
        "label",
    )


_ROUNDED = ", ".join(f"round({c},6) AS {c}" for c in FEATURES)


def rounded_features(df, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in FEATURES})


@query(
    "d14_window_features",
    "D14",
    with_parts(
        "win",
        f"SELECT window_id, window_start_epoch, window_end_epoch, capture_id, {_ROUNDED} FROM win",
    ),
)
def window_features(t: Tables):
    return rounded_features(X.window_rows(t)).drop("label", "observed_labels")


@query(
    "d15_window_labels",
    "D15",
    with_parts("win", "SELECT window_id, label, observed_labels FROM win"),
)
def window_labels(t: Tables):
    return X.window_rows(t).select(
        "window_id", "label", F.array_join("observed_labels", ",").alias("observed_labels")
    )


@query(
    "d16_capture_summary",
    "D16",
    with_parts("cap", "SELECT capture_id, start_epoch, row_count, label_count, stratum FROM cap"),
)
def capture_summary(t: Tables):
    return windows.capture_summary(X.window_rows(t))


@query(
    "d17_scaler_fit",
    "D17",
    with_parts(
        "rows",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round(avg({c}),6) AS mean, round(CASE WHEN stddev_pop({c})>0 THEN stddev_pop({c}) ELSE 1.0 END,6) AS scale,
        stddev_pop({c})=0 AS zero_variance, count(*) AS training_rows FROM rows WHERE split='train'"""
            for c in FEATURES
        ),
    ),
)
def scaler_fit(t: Tables):
    train = X.split_rows(t).where("split = 'train'")
    table = transforms.scaler_table(transforms.fit_scaler(train, FEATURES), FEATURES)
    return table.withColumn("mean", F.round("mean", 6)).withColumn("scale", F.round("scale", 6))


@query(
    "d18_quantile_bounds",
    "D18 D21",
    with_parts(
        "rows",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round(quantile_cont(ln(1+{c}),0.001),6) AS low, round(quantile_cont(ln(1+{c}),0.999),6) AS high
        FROM rows WHERE split='train'"""
            for c in transforms.HEAVY_TAILED
        ),
    ),
)
def quantile_bounds(t: Tables):
    train = X.split_rows(t).where("split = 'train'")
    logged = train.select(*[F.log1p(c).alias(c) for c in transforms.HEAVY_TAILED])
    out = transforms.quantile_bounds(logged, transforms.HEAVY_TAILED, 0.001, 0.999)
    return out.select("feature", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "d19_class_weights",
    "D19",
    with_parts(
        "rows",
        " UNION ALL ".join(
            f"SELECT '{name}' AS strategy, label, row_count, round({expr},9) AS weight FROM w"
            for name, expr in (
                ("balanced", "total/(k*row_count)"),
                ("sqrt-balanced", "sqrt(total/(k*row_count))"),
                ("none", "1.0::DOUBLE"),
            )
        ).join(
            [
                """WITH w AS (SELECT label, count(*) AS row_count, sum(count(*)) OVER ()::DOUBLE AS total, count(*) OVER () AS k
        FROM rows WHERE split='train' GROUP BY label) """,
                "",
            ]
        ),
    ),
)
def class_weights(t: Tables):
    train = X.split_rows(t).where("split = 'train'").select("label")
    parts = [
        transforms.class_weights(train, s).withColumn("strategy", F.lit(s))
        for s in ("balanced", "sqrt-balanced", "none")
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("weight", F.round("weight", 9))


@query(
    "d20_class_and_split_counts",
    "D20",
    with_parts("rows", "SELECT split, label, count(*) AS row_count FROM rows GROUP BY 1,2"),
)
def class_and_split_counts(t: Tables):
    return profiling.class_counts(X.split_rows(t), ["split", "label"])


@query(
    "d21_linear_quantiles",
    "D21",
    """SELECT event_type, p AS probability, round(CASE p WHEN 0.0 THEN quantile_cont(value,0.0) WHEN 0.25 THEN quantile_cont(value,0.25) WHEN 0.5 THEN quantile_cont(value,0.5)
      WHEN 0.9 THEN quantile_cont(value,0.9) ELSE quantile_cont(value,0.999) END,6) AS quantile
    FROM events, (SELECT unnest([0.0,0.25,0.5,0.9,0.999])::DOUBLE AS p) GROUP BY event_type, p""",
)
def linear_quantiles(t: Tables):
    out = exact_quantiles(
        t.events,
        keys=["event_type"],
        value="value",
        probabilities=[0.0, 0.25, 0.5, 0.9, 0.999],
    )
    return out.withColumn("quantile", F.round("quantile", 6))


@query(
    "b14_standard_scores",
    "B14 J13",
    with_parts(
        "scaled",
        f"SELECT window_id, split, {', '.join(f'round({c},5) AS {c}' for c in FEATURES)} FROM scaled",
    ),
)
def standard_scores(t: Tables):
    return rounded_features(X.scaled_rows(t), 5).select("window_id", "split", *FEATURES)


_HEAVY = transforms.HEAVY_TAILED
_LIGHT = [c for c in FEATURES if c not in _HEAVY]
X.define(
    "logged",
    "SELECT window_id, split, "
    + ", ".join([f"ln(1+{c}) AS {c}" for c in _HEAVY] + _LIGHT)
    + " FROM rows",
    "rows",
)
X.define(
    "bounds",
    "SELECT "
    + ", ".join(
        f"quantile_cont({c},0.001) AS lo_{c}, quantile_cont({c},0.999) AS hi_{c}" for c in _HEAVY
    )
    + " FROM logged WHERE split='train'",
    "logged",
)
X.define(
    "clipped",
    "SELECT window_id, split, "
    + ", ".join([f"greatest(least({c},hi_{c}),lo_{c}) AS {c}" for c in _HEAVY] + _LIGHT)
    + " FROM logged, bounds",
    "logged bounds",
)


@query(
    "b15_winsorized_scores",
    "B15 D18",
    with_parts(
        "clipped",
        "SELECT c.window_id, c.split, "
        + ", ".join(f"round((c.{f}-m.{f})/s.{f},5) AS {f}" for f in FEATURES)
        + " FROM clipped c, (SELECT "
        + ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
        + " FROM clipped WHERE split='train') m, (SELECT "
        + ", ".join(
            f"CASE WHEN stddev_pop({f})>0 THEN stddev_pop({f}) ELSE 1.0 END AS {f}" for f in FEATURES
        )
        + " FROM clipped WHERE split='train') s",
    ),
)
def winsorized_scores(t: Tables):
    rows = X.split_rows(t)
    fitted = transforms.fit_transform(rows.where("split = 'train'"), FEATURES, "log1p-winsor")
    out = transforms.apply_transform(rows, FEATURES, "log1p-winsor", fitted)
    return rounded_features(out, 5).select("window_id", "split", *FEATURES)


@query(
    "w9_event_order",
    "W9",
    with_parts(
        "conn",
        """SELECT capture_id, CAST(floor(timestamp/300) AS BIGINT) AS bucket, event_id,
      row_number() OVER (PARTITION BY capture_id, floor(timestamp/300) ORDER BY timestamp, uid, event_id) AS place FROM conn""",
    ),
)
def event_order(t: Tables):
    seconds = X.WINDOW_SECONDS
    rows = X.connections(t).withColumn("bucket", S.window_bucket("timestamp", seconds))
    return slot_ranked(
        rows.select("capture_id", "bucket", "event_id", "timestamp", "uid"),
        groups=["capture_id", "bucket"],
        slot=F.floor(F.col("timestamp") - F.col("bucket") * seconds),
        order=["timestamp", "uid", "event_id"],
    ).drop("timestamp", "uid")


@query(
    "w9_total_order",
    "W9",
    """SELECT event_id, row_number() OVER (ORDER BY event_type, user_id, event_id) AS place FROM events""",
)
def total_order(t: Tables):
    """All events as if they fell into one second: their order is that of the other key columns."""
    rows = t.events.select("event_id", F.lit(0).alias("second"), "event_type", "user_id")
    return range_ranked(rows, ["second", "event_type", "user_id", "event_id"]).select("event_id", "place")


@query(
    "e1_hash_split",
    "E1",
    """SELECT c_mktsegment, CASE WHEN b<70 THEN 'train' WHEN b<85 THEN 'validation' ELSE 'test' END AS split, count(*) AS row_count
    FROM (SELECT *, CAST(('0x'||substr(sha256('5:'||c_name),1,16))::UBIGINT % 100 AS INTEGER) AS b FROM customer) GROUP BY 1,2""",
)
def hash_split(t: Tables):
    split = splitting.hash_split("c_name", 5, {"train": 70, "validation": 15, "test": 15})
    return t.customer.groupBy("c_mktsegment", split.alias("split")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "e2_grouped_time_split",
    "E2 E3",
    with_parts(
        "capsplit",
        "SELECT capture_id, start_epoch, row_count, stratum, split FROM capsplit",
    ),
)
def grouped_time_split(t: Tables):
    return splitting.grouped_time_split(
        windows.capture_summary(X.window_rows(t)),
        holdout_epoch=X.HOLDOUT_EPOCH,
        percentages=X.PERCENTAGES,
    ).drop("label_count")


X.define(
    "cap2",
    "SELECT capture_id, start_epoch, row_count, CASE WHEN row_count%2=1 THEN 'attack_present-1' ELSE 'attack_present-0' END AS stratum FROM cap",
    "cap",
)
X.define("cap2split", X.split_sql("cap2"), "cap2")


@query(
    "e3_stratified_holdout_split",
    "E2 E3",
    with_parts("cap2split", "SELECT capture_id, stratum, split FROM cap2split"),
)
def stratified_holdout_split(t: Tables):
    captures = X.capture_regimes(X.window_rows(t))
    out = splitting.grouped_time_split(
        captures, holdout_epoch=X.HOLDOUT_EPOCH, percentages=X.PERCENTAGES
    )
    return out.select("capture_id", "stratum", "split")


@query(
    "e2_split_label_counts",
    "E2 E3 D14 D15 D20",
    with_parts("rows", "SELECT split, label, count(*) AS window_count FROM rows GROUP BY 1,2"),
)
def split_label_counts(t: Tables):
    rows = X.split_rows(t, X.window_rows(t))
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("window_count"))


X.define(
    "sampled",
    """SELECT * EXCLUDE (n, place) FROM (SELECT *, count(*) OVER (PARTITION BY split, label) AS n,
    row_number() OVER (PARTITION BY split, label ORDER BY sha256('11:label:'||window_id), window_id) AS place
  FROM (SELECT *, sha256('11:'||label||':'||window_id) AS h FROM rows))""",
    "rows",
)
X.PARTS["sampled"] = """
SELECT window_id, split, label FROM (SELECT window_id, split, label, count(*) OVER (PARTITION BY split, label) AS n,
    row_number() OVER (PARTITION BY split, label ORDER BY sha256('11:'||label||':'||window_id), window_id) AS place FROM rows)
WHERE split<>'train' OR place<=CASE WHEN label='multi_tactic' THEN greatest(1,floor(n*0.3)) ELSE greatest(1,floor(n*0.8)) END
"""


def sampled_rows(t: Tables):
    return splitting.sample_training(
        X.split_rows(t),
        seed=11,
        majority_labels=["multi_tactic"],
        majority_fraction=0.3,
        minority_fraction=0.8,
    )


@query("e4_training_sample", "E4", with_parts("sampled", "SELECT window_id, split, label FROM sampled"))
def training_sample(t: Tables):
    return sampled_rows(t).select("window_id", "split", "label")


@query(
    "e4_selection_digest",
    "E4 I12",
    with_parts(
        "sampled",
        """SELECT split, n AS row_count, sha256(n||':'||p0||':'||p1||':'||p2||':'||p3) AS table_sha256 FROM (
      SELECT split, count(*) AS n, """
        + ", ".join(
            f"sum(('0x'||substr(d,{1 + 15 * i},15))::UBIGINT::HUGEINT) AS p{i}" for i in range(4)
        )
        + """ FROM (SELECT split, sha256('["'||window_id||'"]') AS d FROM sampled) GROUP BY split)""",
    ),
)
def selection_digest(t: Tables):
    return splitting.table_digest(sampled_rows(t), ["window_id"], ["split"])


@query(
    "d17_scaler_on_sampled_training",
    "D17 E4",
    with_parts(
        "sampled",
        """SELECT feature, round(avg(x),6) AS mean, round(CASE WHEN stddev_pop(x)>0 THEN stddev_pop(x) ELSE 1.0 END,6) AS scale, stddev_pop(x)=0 AS zero_variance, count(*) AS training_rows FROM
      (UNPIVOT (SELECT """
        + ", ".join(FEATURES)
        + " FROM rows JOIN sampled USING (window_id) WHERE sampled.split='train') ON "
        + ", ".join(FEATURES)
        + " INTO NAME feature VALUE x) GROUP BY feature",
    ),
)
def scaler_on_sampled_training(t: Tables):
    """Split, then sample, then fit: the scaler sees the sampled training rows only."""
    train = sampled_rows(t).where("split = 'train'")
    table = transforms.scaler_table(transforms.fit_scaler(train, FEATURES), FEATURES)
    return table.withColumn("mean", F.round("mean", 6)).withColumn("scale", F.round("scale", 6))


@query(
    "e8_sampling_report",
    "E8",
    with_parts(
        "sampled",
        """SELECT b.split, b.label, b.n AS rows_before, coalesce(a.n,0) AS rows_after,
      CASE WHEN b.split='train' THEN a.n BETWEEN 1 AND b.n ELSE a.n=b.n END AS valid
    FROM (SELECT split,label,count(*) AS n FROM rows GROUP BY 1,2) b LEFT JOIN (SELECT split,label,count(*) AS n FROM sampled GROUP BY 1,2) a USING (split,label)""",
    ),
)
def sampling_report(t: Tables):
    return splitting.sampling_report(X.split_rows(t), sampled_rows(t))


@query(
    "e9_straddling_groups",
    "E9",
    """SELECT l_orderkey, count(DISTINCT split) AS split_count FROM (SELECT l_orderkey,
      CASE WHEN l_orderkey%9=0 AND l_linenumber%2=0 THEN 'test' ELSE 'train' END AS split FROM lineitem) GROUP BY 1 HAVING count(DISTINCT split)>1""",
)
def straddling_groups(t: Tables):
    leak = (F.col("l_orderkey") % 9 == 0) & (F.col("l_linenumber") % 2 == 0)
    rows = t.lineitem.select("l_orderkey", F.when(leak, "test").otherwise("train").alias("split"))
    return splitting.straddling_groups(rows, "l_orderkey")


X.define(
    "dealt",
    """SELECT window_id, label, CAST((off+place-1)%15 AS INTEGER) AS client_index FROM
  (SELECT window_id, r.label, row_number() OVER (PARTITION BY r.label ORDER BY sha256('3:'||window_id), window_id) AS place, off FROM
    (SELECT * FROM rows WHERE split='train') r JOIN
    (SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM
      (SELECT label, count(*) AS n FROM rows WHERE split='train' GROUP BY label)) o ON r.label=o.label)""",
    "rows",
)


def dealt_rows(t: Tables):
    train = X.split_rows(t).where("split = 'train'")
    return partitioning.round_robin(train, clients=X.CLIENTS, seed=3)


@query(
    "e5_round_robin_clients",
    "E5",
    with_parts(
        "dealt",
        "SELECT window_id, 'client'||lpad(CAST(client_index+1 AS VARCHAR),2,'0') AS client_id, client_index FROM dealt",
    ),
)
def round_robin_clients(t: Tables):
    return dealt_rows(t).select("window_id", "client_id", "client_index")


@query("e6_dirichlet_clients", "E6")
def dirichlet_clients(t: Tables):
    train = X.split_rows(t).where("split = 'train'")
    minimum = 2
    placed = partitioning.dirichlet_partition(
        train, clients=X.CLIENTS, alpha=0.5, minimum=minimum, seed=3
    )
    return placed.groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "e7_partition_verification",
    "E7",
    with_parts(
        "dealt",
        """SELECT count(*) AS expected_rows, count(*) FILTER (client_index<>4)+count(*) FILTER (client_index=2) AS placed_rows,
      count(*) FILTER (client_index=2) AS overlapping_rows, count(*) FILTER (client_index=4) AS missing_rows, 0::BIGINT AS unexpected_rows,
      0::BIGINT AS wrong_width_rows FROM dealt""",
    ),
)
def partition_verification(t: Tables):
    dealt = dealt_rows(t)
    damaged = dealt.where("client_index <> 4").unionByName(dealt.where("client_index = 2"))
    expected = X.split_rows(t).where("split = 'train'")
    width = F.size(F.array(*FEATURES)) == len(FEATURES)
    return partitioning.verify_partition(expected, damaged, width_ok=width)


@query(
    "e7_dirichlet_verification",
    "E6 E7",
    with_parts(
        "rows",
        """SELECT count(*) AS expected_rows, count(*) AS placed_rows, 0::BIGINT AS overlapping_rows, 0::BIGINT AS missing_rows,
      0::BIGINT AS unexpected_rows, 0::BIGINT AS wrong_width_rows FROM rows WHERE split='train'""",
    ),
)
def dirichlet_verification(t: Tables):
    train = X.split_rows(t).where("split = 'train'")
    placed = partitioning.dirichlet_partition(train, clients=X.CLIENTS, alpha=0.5, minimum=2, seed=3)
    width = F.size(F.array(*FEATURES)) == len(FEATURES)
    return partitioning.verify_partition(train, placed, width_ok=width)


@query(
    "w10_entities_by_hash",
    "W10",
    """SELECT c_custkey, sha256('23:'||c_custkey) AS rank_digest FROM customer ORDER BY rank_digest, c_custkey LIMIT 30""",
)
def entities_by_hash(t: Tables):
    return selection.top_by_hash(t.customer, 30, 23, "c_custkey")
