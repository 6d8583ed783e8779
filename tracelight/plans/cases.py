"""Queries on lineage, reconstruction, mappings, cases and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators import cases as C
from tracelight.operators import consolidation, lineage, scoring, windows
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.learning import FEATURES, class_mean_network, stored_scaled, training_baseline
from tracelight.plans.standins import with_parts


def order_lineage(t: Tables):
    """Orders as windows, order lines as events, line rows as source records, suppliers as files."""
    event = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = t.lineitem
    selected = t.orders.select(F.col("o_orderkey").alias("window_id"))
    edges = lines.select(F.col("l_orderkey").alias("window_id"), event.alias("event_id"))
    sources = lines.where("l_quantity < 50").select(
        event.alias("event_id"),
        F.concat(F.lit("supplier/"), "l_suppkey").alias("source_file"),
        S.canonical_digest("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_sha256"),
    )
    files = t.supplier.where("s_suppkey % 17 <> 0").select(
        F.concat(F.lit("supplier/"), "s_suppkey").alias("source_file"),
        F.sha2("s_name", 256).alias("file_sha256"),
    )
    return lineage.resolve_lineage(selected, edges, sources, files)


X.define(
    "resolved",
    """SELECT o_orderkey AS window_id, e.event_id, s.record_sha256, s.source_file, f.file_sha256,
    CASE WHEN e.event_id IS NULL THEN 'no-event' WHEN s.source_file IS NULL THEN 'no-source-record' WHEN f.file_sha256 IS NULL THEN 'no-source-file' ELSE 'resolved' END AS resolution
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS window_id, l_orderkey||'/'||l_linenumber AS event_id FROM lineitem) e ON e.window_id=o_orderkey
  LEFT JOIN (SELECT l_orderkey||'/'||l_linenumber AS event_id, 'supplier/'||l_suppkey AS source_file, sha256('["'||l_orderkey||'","'||l_linenumber||'","'||l_partkey||'","'||l_suppkey||'"]') AS record_sha256 FROM lineitem WHERE l_quantity<50) s USING (event_id)
  LEFT JOIN (SELECT 'supplier/'||s_suppkey AS source_file, sha256(s_name) AS file_sha256 FROM supplier WHERE s_suppkey%17<>0) f USING (source_file)""",
)


@query(
    "j1_lineage_resolution",
    "J1",
    with_parts(
        "resolved",
        "SELECT window_id, coalesce(event_id,'') AS event_id, coalesce(source_file,'') AS source_file, coalesce(record_sha256,'') AS record_sha256, coalesce(file_sha256,'') AS file_sha256, resolution FROM resolved",
    ),
)
def lineage_resolution(t: Tables):
    text = ("event_id", "source_file", "record_sha256", "file_sha256")
    return order_lineage(t).select("window_id", *[F.coalesce(c, F.lit("")).alias(c) for c in text], "resolution")


@query(
    "i11_window_completeness",
    "I11 J1",
    with_parts(
        "resolved",
        """SELECT window_id, count(DISTINCT event_id) AS event_count, count(*) FILTER (resolution IN ('resolved','no-source-file')) AS source_record_count,
      count(*) FILTER (resolution<>'resolved')=0 AS lineage_complete FROM resolved GROUP BY 1""",
    ),
)
def window_completeness(t: Tables):
    return lineage.window_completeness(order_lineage(t))


@query(
    "i11_completeness_counts",
    "I11",
    with_parts(
        "resolved",
        """SELECT count(*) FILTER (v=0) AS complete_window_count, count(*) FILTER (v>0) AS incomplete_window_count, sum(a)::BIGINT AS windows_without_event,
      sum(b)::BIGINT AS events_without_record, sum(c)::BIGINT AS records_without_file, sum(v)::BIGINT AS invariant_violation_count FROM
      (SELECT count(*) FILTER (resolution='no-event') AS a, count(*) FILTER (resolution='no-source-record') AS b, count(*) FILTER (resolution='no-source-file') AS c,
        count(*) FILTER (resolution<>'resolved') AS v FROM resolved GROUP BY window_id)""",
    ),
)
def completeness_counts(t: Tables):
    return lineage.completeness_counts(order_lineage(t))


@query(
    "i10_window_event_edges",
    "I10",
    with_parts(
        "conn",
        """SELECT 'window-central-'||substr(sha256(capture_id||':'||CAST(floor(timestamp/300) AS BIGINT)),1,20) AS window_id, event_id, timestamp, capture_id FROM conn""",
    ),
)
def window_event_edges(t: Tables):
    return windows.window_event_edges(X.connections(t), seconds=X.WINDOW_SECONDS)


@query(
    "i10_event_source_edges",
    "I10 D12",
    with_parts(
        "rec",
        """SELECT 'event-central-'||substr(d,1,20) AS event_id, d AS identity_sha256, source_file, l_partkey,
      sha256('["'||l_orderkey||'","'||l_linenumber||'","'||l_partkey||'","'||label_tactic||'","'||label_technique||'"]') AS source_record_sha256
    FROM (SELECT *, sha256('["'||l_orderkey||'","'||l_linenumber||'"]') AS d FROM rec)""",
    ),
)
def event_source_edges(t: Tables):
    return consolidation.source_edges(
        X.labelled_records(t),
        identity=["l_orderkey", "l_linenumber"],
        record=["l_orderkey", "l_linenumber", "l_partkey", "label_tactic", "label_technique"],
        source=["source_file", "l_partkey"],
    )


def graph_inputs(t: Tables):
    """Orders as admitted batches, order status as snapshot, line identities as windows."""
    snapshot = lambda c: F.concat(F.lit("snapshot-"), c)
    admissions = t.orders.select(
        F.concat(F.lit("batch-"), "o_orderkey").alias("batch_id"),
        F.concat(F.lit("decision-"), F.substring(S.canonical_digest("o_orderkey"), 1, 24)).alias("decision_id"),
        snapshot("o_orderstatus").alias("snapshot_id"),
    )
    snapshots = t.orders.select(snapshot("o_orderstatus").alias("snapshot_id")).distinct()
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("window-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("window_id"),
        snapshot("o_orderstatus").alias("snapshot_id"),
    ).distinct()
    return admissions, snapshots, rows


X.define(
    "graphwin",
    "SELECT DISTINCT 'window-'||l_orderkey||'-'||l_linenumber AS window_id, 'snapshot-'||o_orderstatus AS snapshot_id FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
)


@query(
    "i9_lineage_edges",
    "I9 S3",
    with_parts(
        "graphwin",
        """SELECT 'wasAdmittedBy' AS relation, 'batch-'||o_orderkey AS subject, 'decision-'||substr(sha256('["'||o_orderkey||'"]'),1,24) AS object FROM orders
    UNION ALL SELECT 'used', 'activity-build-snapshot-'||o_orderstatus, 'batch-'||o_orderkey FROM orders
    UNION ALL SELECT DISTINCT 'wasGeneratedBy', 'snapshot-'||o_orderstatus, 'activity-build-snapshot-'||o_orderstatus FROM orders
    UNION ALL SELECT 'wasDerivedFrom', window_id, snapshot_id FROM graphwin""",
    ),
)
def lineage_edges(t: Tables):
    return lineage.lineage_edges(*graph_inputs(t))


@query(
    "i9_lineage_node_counts",
    "I9",
    with_parts(
        "graphwin",
        """SELECT 'batch_bundle' AS type, count(*) AS node_count FROM orders UNION ALL SELECT 'admission_decision', count(*) FROM orders
    UNION ALL SELECT 'dataset_snapshot', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'snapshot_construction', count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'feature_window', count(DISTINCT window_id) FROM graphwin""",
    ),
)
def lineage_node_counts(t: Tables):
    nodes = lineage.lineage_nodes(*graph_inputs(t))
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("node_count"))


@query(
    "i12_snapshot_manifest",
    "I12 D20",
    with_parts(
        "rows",
        """SELECT split, count(*) AS row_count, count(DISTINCT label) AS class_count, count(DISTINCT capture_id) AS input_count,
      min(window_start_epoch) AS first_epoch, max(window_end_epoch) AS last_epoch FROM rows GROUP BY split""",
    ),
)
def snapshot_manifest(t: Tables):
    return X.split_rows(t).groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("label").alias("class_count"),
        F.count_distinct("capture_id").alias("input_count"),
        F.min("window_start_epoch").alias("first_epoch"),
        F.max("window_end_epoch").alias("last_epoch"),
    )


@query(
    "j3_artifact_coverage",
    "J3",
    """SELECT status, count(*) AS key_count FROM (SELECT o_orderkey, coalesce(nullif(concat_ws(',',
        CASE WHEN o_orderkey%71=0 THEN 'missing-attributions' END, CASE WHEN o_orderkey%73=0 THEN 'missing-distances' END,
        CASE WHEN o_orderkey%79=0 THEN 'repeated-mappings' END, CASE WHEN o_orderkey%83=0 THEN 'different-predicted_class' END),''),'covered') AS status FROM orders) GROUP BY 1""",
)
def artifact_coverage(t: Tables):
    n = F.col("prediction_id")
    base = t.orders.select(
        F.col("o_orderkey").alias("prediction_id"),
        F.col("o_orderstatus").alias("predicted_class"),
        F.col("o_custkey").alias("window_id"),
    )
    other = base.withColumn(
        "predicted_class", F.when(n % 83 == 0, "other").otherwise(F.col("predicted_class"))
    )
    tables = {
        "predictions": base,
        "attributions": base.where(n % 71 != 0),
        "distances": base.where(n % 73 != 0).drop("window_id"),
        "mappings": other.unionByName(other.where(n % 79 == 0)),
    }
    out = lineage.coverage(tables, "prediction_id", ["predicted_class", "window_id"])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("key_count"))


@query(
    "j12_row_reconstruction",
    "J12 S4",
    with_parts(
        "rows",
        """SELECT CASE WHEN b=1 THEN 'not-stored' WHEN b=0 THEN 'different' ELSE 'equal' END AS status, count(*) AS row_count FROM
      (SELECT CAST(('0x'||substr(sha256('31:'||window_id),1,16))::UBIGINT % 20 AS INTEGER) AS b FROM rows) GROUP BY 1""",
    ),
)
def row_reconstruction(t: Tables):
    scaled = X.scaled_rows(t).withColumn("digest", lineage.row_digest(FEATURES, 6))
    mark = S.hash_bucket(31, "window_id", 20)
    stored = stored_scaled(t).where(mark != 1)
    changed = stored.withColumn(
        "connection_count", F.col("connection_count") + F.when(mark == 0, 1.0).otherwise(0.0)
    )
    stored = changed.withColumn("digest", lineage.row_digest(FEATURES, 6))
    out = lineage.compare_rows(scaled, stored, "window_id", "digest")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))


# The event labels under the class names the tactic rules know.
CLASS_NAMES = {
    "benign": "benign",
    "click": "credential_access",
    "error": "exfiltration",
    "multi_tactic": "multi_tactic",
    "purchase": "initial_access",
    "signup": "reconnaissance",
}
VERSION = "17.1"
_CLASS_SQL = "CASE p.predicted " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CLASS_NAMES.items()) + " END"
X.define(
    "rules",
    "SELECT * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in C.TACTIC_RULES
    )
    + ") r(predicted_class, rule_id, mapping_status, tactic_id, tactic_name)",
)
X.define(
    "mapped",
    f"""SELECT q.*, rule_id, mapping_status, tactic_id, tactic_name, 'attack-mapping-'||substr(sha256('{{"attack_version":"{VERSION}","mapping_status":"'||mapping_status||'","predicted_class":"'||q.predicted_class
      ||'","prediction_id":"'||prediction_id||'","rule_id":"'||rule_id||'","tactic_id":'||coalesce('"'||tactic_id||'"','null')||'}}'),1,24) AS mapping_id
  FROM (SELECT p.*, s.split, s.capture_id, {_CLASS_SQL} AS predicted_class, 'prediction-'||substr(sha256('["'||p.window_id||'"]'),1,24) AS prediction_id FROM wpred p JOIN rows s USING (window_id)) q JOIN rules USING (predicted_class)""",
    "wpred rows rules",
)


def window_predictions(scaled, network):
    """Predictions with ids and the rule vocabulary's class names; labels play no part."""
    kept = ["window_id", "split", "capture_id"]
    out = scoring.score(scaled, network, FEATURES, kept)
    names = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    return out.select(
        *kept,
        S.derived_id("prediction", S.canonical_digest("window_id"), 24).alias("prediction_id"),
        F.element_at(names, F.col("predicted")).alias("predicted_class"),
        "confidence",
        "probability_margin",
    )


def mapped_predictions(t: Tables):
    scaled = stored_scaled(t)
    predictions = window_predictions(scaled, class_mean_network(scaled))
    return C.tactic_hypotheses(predictions, C.rule_table(t.spark), VERSION)


@query(
    "i13_tactic_hypotheses",
    "I13 J4",
    with_parts(
        "mapped",
        "SELECT window_id, prediction_id, predicted_class, rule_id, mapping_status, coalesce(tactic_id,'') AS tactic_id, mapping_id FROM mapped",
    ),
)
def tactic_hypotheses(t: Tables):
    return mapped_predictions(t).select(
        "window_id",
        "prediction_id",
        "predicted_class",
        "rule_id",
        "mapping_status",
        F.coalesce("tactic_id", F.lit("")).alias("tactic_id"),
        "mapping_id",
    )


@query(
    "d27_mapping_status_counts",
    "D27",
    with_parts(
        "mapped",
        """SELECT split, count(*) AS mapping_count, count(*) FILTER (mapping_status='candidate-tactic') AS candidate_tactic_count,
      count(*) FILTER (mapping_status='not-applicable') AS not_applicable_count, count(*) FILTER (mapping_status='unresolved-multi-tactic') AS unresolved_multi_tactic_count FROM mapped GROUP BY split""",
    ),
)
def mapping_status_counts(t: Tables):
    return C.status_counts(mapped_predictions(t), ["split"])


def case_table(t: Tables):
    """Cases of all evaluation windows, and the evidence they rest on.

    Events with an id divisible by 400 have no source record and days ending in 7 have no file, so that
    the report gate has something to find.
    """
    scaled = stored_scaled(t)
    network = class_mean_network(scaled)
    rows = scaled.where("split <> 'train'")
    predictions = window_predictions(rows, network)
    mappings = C.tactic_hypotheses(
        predictions.select("prediction_id", "predicted_class"), C.rule_table(t.spark), VERSION
    )
    explained = scoring.integrated_gradients(
        rows, network, FEATURES, training_baseline(scaled), ["window_id"], initial_steps=256
    )
    top = F.slice(scoring.ranked_attributions(FEATURES, "attributions"), 1, 5)
    names = F.array(*[F.lit(CLASS_NAMES[c]) for c in network.classes])
    explanations = explained.select(
        "window_id", top.alias("top_features"), F.get(names, F.col("target_index")).alias("nearest_class")
    )
    edges = windows.window_event_edges(X.connections(t), seconds=X.WINDOW_SECONDS)
    path = F.concat(F.lit("day/"), "capture_id")
    sources = edges.where("event_id % 400 <> 0").select("event_id", path.alias("source_file"))
    files = sources.select("source_file").distinct().where("source_file NOT LIKE '%7'").withColumn(
        "file_sha256", F.sha2("source_file", 256)
    )
    resolved = lineage.resolve_lineage(rows, edges, sources, files)
    return C.assemble_cases(predictions, mappings, explanations, lineage.window_completeness(resolved))


X.define(
    "evid",
    """SELECT window_id, count(DISTINCT event_id) AS event_count, count(*) FILTER (event_id%400<>0) AS source_record_count,
    count(*) FILTER (event_id%400=0 OR capture_id LIKE '%7')=0 AS lineage_complete FROM
  (SELECT 'window-central-'||substr(sha256(capture_id||':'||CAST(floor(timestamp/300) AS BIGINT)),1,20) AS window_id, event_id, capture_id FROM conn) GROUP BY 1""",
    "conn",
)
X.define(
    "casesql",
    """SELECT m.*, event_count, source_record_count, lineage_complete,
    'case-'||substr(sha256('{"event_count":'||event_count||',"mapping_id":"'||mapping_id||'","prediction_id":"'||prediction_id||'","source_record_count":'||source_record_count||'}'),1,24) AS case_id
  FROM mapped m JOIN evid USING (window_id) WHERE split<>'train'""",
    "mapped evid",
)


@query(
    "i14_investigation_cases",
    "I14 W8",
    with_parts(
        "casesql",
        """SELECT case_id, prediction_id, window_id, capture_id, predicted_class, mapping_status, event_count, source_record_count, lineage_complete,
      round(confidence,6) AS confidence, 5::INTEGER AS feature_count FROM casesql""",
    ),
)
def investigation_cases(t: Tables):
    c = F.col("case")
    return case_table(t).select(
        C.case_id("case").alias("case_id"),
        "prediction_id",
        c["identity"]["window_id"].alias("window_id"),
        c["identity"]["capture_id"].alias("capture_id"),
        c["model_measurement"]["predicted_class"].alias("predicted_class"),
        c["attack_interpretation"]["mapping_status"].alias("mapping_status"),
        c["primary_evidence"]["event_count"].alias("event_count"),
        c["primary_evidence"]["source_record_count"].alias("source_record_count"),
        c["primary_evidence"]["lineage_complete"].alias("lineage_complete"),
        F.round(c["model_measurement"]["confidence"], 6).alias("confidence"),
        F.size(c["explanation"]["top_features"]).alias("feature_count"),
    )


_TITLE = "array_to_string(list_transform(string_split(replace(predicted_class,'_',' '),' '), lambda w: upper(w[1])||w[2:]),' ')"


@query(
    "i15_analyst_summaries",
    "I15 A8",
    with_parts(
        "casesql",
        f"""SELECT prediction_id, 'Window classified as '||{_TITLE}||' with confidence '||printf('%.2f', confidence*100)||'%.'||
      CASE mapping_status WHEN 'candidate-tactic' THEN ' Tactic hypothesis: '||tactic_id||' '||tactic_name||'.' WHEN 'not-applicable' THEN ' No tactic hypothesis applies.'
        ELSE ' Several tactics are possible; none is singled out.' END AS summary,
      '## Case '||case_id||' / - Evidence: '||event_count||' events, '||source_record_count||' source records' AS heading FROM casesql""",
    ),
)
def analyst_summaries(t: Tables):
    lines = C.markdown_lines("case")
    return case_table(t).select(
        "prediction_id",
        C.analyst_summary("case").alias("summary"),
        F.concat_ws(" / ", F.get(lines, F.lit(0)), F.get(lines, F.lit(4))).alias("heading"),
    )


@query(
    "i16_report_gate",
    "I16 D27",
    with_parts(
        "casesql",
        """SELECT split, count(*) AS case_count, sum(event_count)::BIGINT AS source_event_count, sum(source_record_count)::BIGINT AS source_record_count,
      count(*) FILTER (mapping_status='candidate-tactic') AS candidate_tactic_count, count(*) FILTER (mapping_status='not-applicable') AS not_applicable_count,
      count(*) FILTER (mapping_status='unresolved-multi-tactic') AS unresolved_multi_tactic_count, count(*) FILTER (NOT lineage_complete) AS incomplete_case_count,
      0::BIGINT AS case_without_evidence_count, count(*) FILTER (NOT lineage_complete)=0 AS reportable FROM casesql GROUP BY split""",
    ),
)
def report_gate(t: Tables):
    cases = case_table(t).withColumn("split", F.col("case.identity.split"))
    return C.report_totals(cases, ["split"])
