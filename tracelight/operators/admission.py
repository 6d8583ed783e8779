"""Admission of evidence batches and of round contributions by named checks.

Signature verdicts are input columns: this engine records and combines them, it does not verify
signatures, so a decision is only as strong as the verdicts it is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators.integrity import verify_continuity

# Attestation results that let a batch pass.
PASSING_STATUS = ("passed", "passed_with_warning")


def bind_identity(batches: DataFrame, identities: DataFrame, at: str) -> DataFrame:
    """Batches with ``registered`` and ``bound``: active, same node, valid at the time of decision."""
    known = identities.select(
        F.col("client_id").alias("_client"),
        F.col("node_id").alias("_node"),
        F.col("status").alias("_status"),
        F.col("valid_from").alias("_from"),
        F.col("valid_until").alias("_until"),
    )
    joined = batches.join(known, F.col("client_id") == F.col("_client"), "left")
    bound = (
        (F.col("_status") == "active")
        & (F.col("node_id") == F.col("_node"))
        & F.col(at).between(F.col("_from"), F.col("_until"))
    )
    return joined.withColumn("registered", F.col("_client").isNotNull()).withColumn(
        "bound", F.coalesce(bound, F.lit(False))
    ).drop("_client", "_node", "_status", "_from", "_until")


def bind_attestation(
    batches: DataFrame, attestations: DataFrame, at: str, trust_levels: Sequence[str] | None
) -> DataFrame:
    """Batches with the six verdicts on the attestation result they refer to."""
    columns = ("client_id", "node_id", "result_sha256", "status", "expires_at", "trust_level", "signature_valid")
    results = attestations.select(
        "attestation_id", *[F.col(c).alias(f"_a_{c}") for c in columns]
    ).withColumn("_a_result_sha256", S.pack_digest("_a_result_sha256"))
    joined = batches.withColumn("_sha256", S.pack_digest("attestation_sha256")).join(results, "attestation_id", "left")
    verdicts = {
        "attestation_reference": F.col("_sha256") == F.col("_a_result_sha256"),
        "attestation_signature": F.col("_a_signature_valid"),
        "attestation_identity_binding": (F.col("client_id") == F.col("_a_client_id"))
        & (F.col("node_id") == F.col("_a_node_id")),
        "attestation_status": F.col("_a_status").isin(*PASSING_STATUS),
        "attestation_freshness": F.col("_a_expires_at") >= F.col(at),
    }
    if trust_levels is not None:
        verdicts["attestation_trust_level"] = F.col("_a_trust_level").isin(*trust_levels)
    return joined.withColumns(
        {name: F.coalesce(v, F.lit(False)) for name, v in verdicts.items()}
    ).drop("_sha256", *[f"_a_{c}" for c in columns])


def decide(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds ``checks`` (name, passed), ``failed_checks`` and ``decision``; nothing is dropped."""
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))
            for name, passed in checks.items()
        ]
    )
    marked = rows.withColumn("checks", listed)
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"])
    return marked.withColumn("failed_checks", failed).withColumn(
        "decision",
        F.when(F.size("failed_checks") == 0, F.lit("accepted")).otherwise(F.lit("quarantined")),
    )


def admit_batches(
    batches: DataFrame,
    identities: DataFrame,
    attestations: DataFrame,
    *,
    at: str = "decided_at",
    trust_levels: Sequence[str] | None = None,
) -> DataFrame:
    """Decision on every batch; the batch table carries observed digests, verdicts and chain positions.

    Continuity is judged last, against the batches that passed every other check and were continuous. What a batch
    shows by itself is judged before the joins, and hashes pass them packed. Identities come second, so
    rows already lie with their client when its positions are grouped.
    """
    hashes = ("chain_hash", "previous_chain_hash")
    own = {
        "_content": F.col("observed_sha256") == F.col("content_sha256"),
        "_size": F.col("observed_size") == F.col("content_size"),
        "_link": F.col("link_valid"),
    }
    judged = batches.withColumns(own | {c: S.pack_digest(c) for c in hashes})
    referred = bind_attestation(judged, attestations, at, trust_levels)
    bound = bind_identity(referred, identities, at).withColumns({c: S.unpack_digest(c) for c in hashes})
    checks = {
        "registered_identity": F.col("registered"),
        "client_node_binding": F.col("bound"),
        "content_digest": F.col("_content"),
        "content_size": F.col("_size"),
        "canonical_chain_commitment": F.col("_link"),
        "evidence_signature": F.col("registered") & F.col("signature_valid"),
        "attestation_reference": F.col("attestation_reference"),
        "attestation_signature": F.col("attestation_signature"),
        "attestation_identity_binding": F.col("attestation_identity_binding"),
        "attestation_status": F.col("attestation_status"),
        "attestation_freshness": F.col("attestation_freshness"),
    }
    if trust_levels is not None:
        checks["attestation_trust_level"] = F.col("attestation_trust_level")
    passed = reduce(and_, [F.coalesce(c, F.lit(False)) for c in checks.values()])
    followed = verify_continuity(bound, passed)
    checks["session_sequence_continuity"] = F.col("continuity") == "continuous"
    decided = decide(followed, checks).drop(*own)
    basis = {
        "batch_id": F.col("batch_id").cast("string"),
        "checks": F.to_json("checks"),
        "content_digest": F.col("observed_sha256"),
        "status": F.col("decision"),
    }
    return decided.withColumn("decision_id", S.derived_id("decision", S.object_digest(basis), 24))


def failed_check_counts(decisions: DataFrame) -> DataFrame:
    """How many batches failed each check; only failures are exploded."""
    return decisions.select(F.explode("failed_checks").alias("check_name")).groupBy("check_name").agg(
        F.count(F.lit(1)).alias("failed_count")
    )


def revoked_as_of(enrollments: DataFrame, revocations: DataFrame, at: Column) -> DataFrame:
    """Enrollments with ``revoked``: some revocation took effect by ``at``."""
    first = revocations.groupBy("enrollment_id").agg(F.min("revoked_at").alias("_revoked_at"))
    joined = enrollments.join(first, "enrollment_id", "left")
    return joined.withColumn(
        "revoked", F.coalesce(F.col("_revoked_at") <= at, F.lit(False))
    ).drop("_revoked_at")


def unrevoked(enrollments: DataFrame, revocations: DataFrame) -> DataFrame:
    """Enrollments no revocation names at all."""
    return enrollments.join(revocations.select("enrollment_id"), "enrollment_id", "left_anti")


def round_gate(decisions: DataFrame, keys: Sequence[str], required: Column | int) -> DataFrame:
    """A round is aggregated only with exactly the required accepted contributions and no quarantine."""
    need = F.lit(required) if isinstance(required, int) else required
    counts = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("submitted_count"),
        F.count_if(F.col("decision") == "accepted").alias("accepted_count"),
        F.count_if(F.col("decision") == "quarantined").alias("quarantined_count"),
    )
    return counts.withColumn("missing_count", need - F.col("submitted_count")).withColumn(
        "aggregate_allowed", (F.col("accepted_count") == need) & (F.col("quarantined_count") == 0)
    )
