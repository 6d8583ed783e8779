"""Tactic hypotheses, investigation cases, summaries and the report gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import scalars as S

# Predicted class, rule id, mapping status, tactic id, tactic name.
TACTIC_RULES = (
    ("benign", "m7-attack-v1-benign", "not-applicable", None, None),
    ("credential_access", "m7-attack-v1-credential-access", "candidate-tactic", "TA0006", "Credential Access"),
    ("exfiltration", "m7-attack-v1-exfiltration", "candidate-tactic", "TA0010", "Exfiltration"),
    ("initial_access", "m7-attack-v1-initial-access", "candidate-tactic", "TA0001", "Initial Access"),
    ("multi_tactic", "m7-attack-v1-multi-tactic", "unresolved-multi-tactic", None, None),
    ("reconnaissance", "m7-attack-v1-reconnaissance", "candidate-tactic", "TA0043", "Reconnaissance"),
)
STATUSES = ("candidate-tactic", "not-applicable", "unresolved-multi-tactic")


def rule_table(spark: SparkSession, rules: Sequence[tuple] = TACTIC_RULES) -> DataFrame:
    if len({r[0] for r in rules}) != len(rules):
        raise ValueError("tactic rules must be one per class")
    return spark.createDataFrame(
        list(rules),
        "predicted_class string, rule_id string, mapping_status string, tactic_id string, tactic_name string",
    )


def tactic_hypotheses(predictions: DataFrame, rules: DataFrame, version: str) -> DataFrame:
    """Mapping of every prediction by its class alone; a class without a rule stops the job."""
    joined = predictions.join(rules, "predicted_class", "left")
    known = F.when(F.col("rule_id").isNotNull(), F.col("rule_id")).otherwise(
        F.raise_error(F.concat(F.lit("no tactic rule for class "), "predicted_class")).cast("string")
    )
    core = {
        "attack_version": F.lit(version),
        "mapping_status": F.col("mapping_status"),
        "predicted_class": F.col("predicted_class"),
        "prediction_id": F.col("prediction_id"),
        "rule_id": F.col("rule_id"),
        "tactic_id": F.col("tactic_id"),
    }
    return joined.withColumn("rule_id", known).withColumn(
        "mapping_id", S.derived_id("attack-mapping", S.object_digest(core), 24)
    )


def status_counts(mappings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mappings per status in fixed columns; any other status stops the job."""
    odd = F.count_if(~F.col("mapping_status").isin(*STATUSES))
    counts = [
        F.count_if(F.col("mapping_status") == s).alias(s.replace("-", "_") + "_count") for s in STATUSES
    ]
    total = F.when(odd == 0, F.count(F.lit(1))).otherwise(
        F.raise_error(F.lit("unexpected mapping status")).cast("bigint")
    )
    return mappings.groupBy(*keys).agg(total.alias("mapping_count"), *counts)


def assemble_cases(
    predictions: DataFrame, mappings: DataFrame, explanations: DataFrame, evidence: DataFrame
) -> DataFrame:
    """One nested case per prediction.

    ``explanations`` has per window the top features and prototype geometry, ``evidence`` per window
    its event and record counts. The evidence rows themselves stay in the lineage table, keyed by
    window: a window may have any number of them.
    """
    joined = (
        predictions.join(mappings.drop("predicted_class", "window_id"), "prediction_id")
        .join(explanations, "window_id")
        .join(evidence, "window_id")
    )
    case = F.struct(
        F.struct("prediction_id", "window_id", "capture_id", "split", "mapping_id").alias("identity"),
        F.struct("predicted_class", "confidence", "probability_margin").alias("model_measurement"),
        F.struct("top_features", "nearest_class").alias("explanation"),
        F.struct("mapping_status", "rule_id", "tactic_id", "tactic_name").alias("attack_interpretation"),
        F.struct("event_count", "source_record_count", "lineage_complete").alias("primary_evidence"),
    )
    return joined.select("prediction_id", case.alias("case"))


def case_id(case: Column | str) -> Column:
    """Case id from its identity and evidence counts (whole numbers and text only)."""
    c = F.col(case) if isinstance(case, str) else case
    core = {
        "event_count": c["primary_evidence"]["event_count"],
        "mapping_id": c["identity"]["mapping_id"],
        "prediction_id": c["identity"]["prediction_id"],
        "source_record_count": c["primary_evidence"]["source_record_count"],
    }
    return S.derived_id("case", S.object_digest(core), 24)


def display_name(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def analyst_summary(case: Column | str) -> Column:
    """Plain-language paragraph of a case."""
    c = F.col(case) if isinstance(case, str) else case
    measured, shown, mapped = c["model_measurement"], c["explanation"], c["attack_interpretation"]
    predicted = measured["predicted_class"]
    first = F.format_string(
        "Window classified as %s with confidence %.2f%%.",
        display_name(predicted),
        measured["confidence"] * 100,
    )
    second = F.when(
        shown["nearest_class"] != predicted,
        F.format_string(" The nearest class mean is %s, kept as context only.", display_name(shown["nearest_class"])),
    ).otherwise(F.lit(""))
    third = (
        F.when(
            mapped["mapping_status"] == "candidate-tactic",
            F.format_string(" Tactic hypothesis: %s %s.", mapped["tactic_id"], mapped["tactic_name"]),
        )
        .when(mapped["mapping_status"] == "not-applicable", F.lit(" No tactic hypothesis applies."))
        .otherwise(F.lit(" Several tactics are possible; none is singled out."))
    )
    return F.concat(first, second, third)


def markdown_lines(case: Column | str) -> Column:
    """Array of Markdown lines of a case."""
    c = F.col(case) if isinstance(case, str) else case
    features = F.array_join(F.transform(c["explanation"]["top_features"], lambda f: f["feature"]), ", ")
    return F.array(
        F.concat(F.lit("## Case "), case_id(c)),
        F.concat(F.lit("- Window: "), c["identity"]["window_id"]),
        F.concat(F.lit("- Predicted class: "), display_name(c["model_measurement"]["predicted_class"])),
        F.concat(F.lit("- Mapping: "), c["attack_interpretation"]["mapping_status"]),
        F.concat(
            F.lit("- Evidence: "),
            c["primary_evidence"]["event_count"].cast("string"),
            F.lit(" events, "),
            c["primary_evidence"]["source_record_count"].cast("string"),
            F.lit(" source records"),
        ),
        F.concat(F.lit("- Strongest features: "), features),
    )


def report_totals(cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over the cases and whether they may be reported.

    Reportable means: cases exist, every lineage is complete, every case has evidence.
    """
    c = F.col("case")
    status = c["attack_interpretation"]["mapping_status"]
    totals = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("case_count"),
        F.sum(c["primary_evidence"]["event_count"]).alias("source_event_count"),
        F.sum(c["primary_evidence"]["source_record_count"]).alias("source_record_count"),
        *[F.count_if(status == s).alias(s.replace("-", "_") + "_count") for s in STATUSES],
        F.count_if(~c["primary_evidence"]["lineage_complete"]).alias("incomplete_case_count"),
        F.count_if(c["primary_evidence"]["event_count"] == 0).alias("case_without_evidence_count"),
    )
    return totals.withColumn(
        "reportable",
        (F.col("case_count") > 0)
        & (F.col("incomplete_case_count") == 0)
        & (F.col("case_without_evidence_count") == 0),
    )
