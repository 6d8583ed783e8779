"""One event per connection identity from records that repeat under several labels.

An identity may be repeated without bound, so its source records stay rows of an edge table. The event
row carries only label sets (bounded by the label vocabulary), counts and the first source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S

# Tactics the labelled data set distinguishes.
TARGET_TACTICS = ("credential_access", "exfiltration", "initial_access", "reconnaissance")
MULTI_TACTIC = "multi_tactic"
# Technique markers that name no technique.
EMPTY_TECHNIQUES = ("none", "duplicate")


def any_attack_label(tactics: Column) -> Column:
    """The only attack tactic, ``multi_tactic`` for several, ``benign`` for none."""
    attacks = F.array_remove(tactics, "benign")
    return (
        F.when(F.size(attacks) == 0, F.lit("benign"))
        .when(F.size(attacks) == 1, F.get(attacks, F.lit(0)))
        .otherwise(F.lit(MULTI_TACTIC))
    )


def primary_label(
    tactics: Column, primary: Column, targets: Sequence[str] = TARGET_TACTICS
) -> Column:
    """Label by precedence: one primary target wins; observed targets count only without any primary attack."""
    wanted = F.array(*[F.lit(t) for t in targets])
    attacks = F.array_remove(tactics, "benign")
    primary_attacks = F.array_remove(primary, "benign")
    main = F.array_intersect(primary_attacks, wanted)
    seen = F.array_intersect(attacks, wanted)
    return (
        F.when(F.size(attacks) == 0, F.lit("benign"))
        .when(F.size(main) == 1, F.get(main, F.lit(0)))
        .when(F.size(primary_attacks) > 0, F.lit(MULTI_TACTIC))
        .when(F.size(seen) == 1, F.get(seen, F.lit(0)))
        .otherwise(F.lit(MULTI_TACTIC))
    )


def consolidate(
    df: DataFrame,
    *,
    identity: Sequence[str],
    tactic: str,
    technique: str,
    binary: str,
    source: Sequence[str],
    rule: str = "primary",
    event_prefix: str = "event-central",
) -> DataFrame:
    """Events keyed by the digest of the identity columns.

    Grouping is on the identity columns themselves: copies combine before the shuffle, the digest is
    computed once per identity, and the other columns need no "first value". ``rule`` is ``any`` or
    ``primary``.
    """
    label = F.col(tactic)
    named = F.trim(F.col(technique))
    grouped = df.groupBy(*identity).agg(
        F.array_sort(F.collect_set(label)).alias("observed_tactics"),
        F.array_sort(
            F.collect_set(F.when(F.lower(F.col(binary)) != "duplicate", label))
        ).alias("_primary"),
        F.array_sort(
            F.collect_set(F.when(~F.lower(named).isin(*EMPTY_TECHNIQUES), named))
        ).alias("observed_techniques"),
        F.count(F.lit(1)).alias("source_record_count"),
        F.min(F.struct(*source)).alias("first_source"),
    )
    if rule == "any":
        resolved = any_attack_label(F.col("observed_tactics"))
    elif rule == "primary":
        resolved = primary_label(F.col("observed_tactics"), F.col("_primary"))
    else:
        raise ValueError(f"unknown consolidation rule: {rule}")
    keyed = grouped.withColumn("identity_sha256", S.canonical_digest(*identity))
    return keyed.withColumn("label", resolved).withColumn(
        "event_id", S.derived_id(event_prefix, F.col("identity_sha256"), 20)
    ).withColumn("primary_tactics", F.array_remove("_primary", "benign")).drop("_primary")


def source_edges(
    df: DataFrame,
    *,
    identity: Sequence[str],
    record: Sequence[str],
    source: Sequence[str],
    event_prefix: str = "event-central",
) -> DataFrame:
    """Event-to-record lineage, one row per source record; no shuffle."""
    digest = S.canonical_digest(*identity)
    return df.select(
        S.derived_id(event_prefix, digest, 20).alias("event_id"),
        digest.alias("identity_sha256"),
        *source,
        S.canonical_digest(*record).alias("source_record_sha256"),
    )
