"""Tumbling-window traffic features, window labels and capture summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S

# The feature schema, in order, and the categories that have a share of their own.
PROTOCOLS = ("tcp", "udp", "icmp")
SERVICES = ("dns", "http", "ssl", "ssh")
STATES = ("sf", "s0", "rej", "rsto", "rstr")
FEATURES = (
    "connection_count",
    "unique_destination_count",
    "unique_destination_port_count",
    "duration_mean",
    "duration_std",
    "duration_max",
    "originator_bytes_sum",
    "responder_bytes_sum",
    "originator_packets_sum",
    "responder_packets_sum",
    "protocol_tcp_fraction",
    "protocol_udp_fraction",
    "protocol_icmp_fraction",
    "protocol_other_fraction",
    "service_dns_fraction",
    "service_http_fraction",
    "service_ssl_fraction",
    "service_ssh_fraction",
    "service_other_fraction",
    "state_sf_fraction",
    "state_s0_fraction",
    "state_rej_fraction",
    "state_rsto_fraction",
    "state_rstr_fraction",
    "state_other_fraction",
)
BENIGN = ("benign",)
MIXED = "multi_tactic"


def shares(column: str, prefix: str, names: Sequence[str]) -> list[Column]:
    """Share of every named category and of all others together."""
    total = F.count(F.lit(1))
    hits = [F.count_if(F.col(column) == n) for n in names]
    known = sum(hits[1:], hits[0])
    shares = [(h / total).alias(f"{prefix}_{n}_fraction") for h, n in zip(hits, names, strict=True)]
    return [*shares, ((total - known) / total).alias(f"{prefix}_other_fraction")]


def window_id(capture: Column, bucket: Column, client: str) -> Column:
    return S.derived_id(
        f"window-{client}", F.sha2(F.concat_ws(":", capture, bucket.cast("string")), 256), 20
    )


WORD_BITS = 63


def label_flags(vocabulary: Sequence[str], label: str) -> Column:
    """Bit set of the labels seen: one number per 63 labels, so it stays in the hash aggregate."""
    place = S.one_of(label, vocabulary)

    def word(first: int) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place - first).cast("int"))
        inside = place.between(first, first + WORD_BITS - 1)
        return F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("bigint")))

    return F.array(*[word(first) for first in range(0, max(1, len(vocabulary)), WORD_BITS)])


def flagged_labels(vocabulary: Sequence[str], flags: Column) -> Column:
    """Sorted label array of a bit set."""
    names = [
        F.when(flags[i // WORD_BITS].bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0, F.lit(name))
        for i, name in enumerate(vocabulary)
    ]
    return F.array_sort(F.array_compact(F.array(*names)))


def choose_label(
    observed: Column, benign: Sequence[str] = BENIGN, mixed: str | None = MIXED
) -> Column:
    """First attack label in order, or ``mixed`` for several; benign rows otherwise."""
    attacks = F.array_except(observed, F.array(*[F.lit(b) for b in benign]))
    first_attack = F.get(attacks, F.lit(0))
    if mixed:
        first_attack = F.when(F.size(attacks) > 1, F.lit(mixed)).otherwise(first_attack)
    return F.coalesce(
        F.when(F.size(attacks) > 0, first_attack), F.get(observed, F.lit(0)), F.lit("unlabeled")
    )


def window_features(
    events: DataFrame,
    *,
    seconds: int,
    vocabulary: Sequence[str],
    client: str = "central",
    benign: Sequence[str] = BENIGN,
    mixed: str | None = MIXED,
    approximate_distinct: bool = False,
) -> DataFrame:
    """The 25 features, label and bounds of every (capture, bucket) window.

    ``vocabulary`` is the sorted list of event labels. A minute of flood traffic can hold
    much of a capture, so nothing is collected per window: sums combine before the shuffle, and the
    exact distinct counts are shuffled by (window, value). Event ids of a window are the edge table of
    :func:`window_event_edges`.
    """
    if list(vocabulary) != sorted(set(vocabulary)):
        raise ValueError("the label vocabulary must be sorted and unique")
    distinct = F.approx_count_distinct if approximate_distinct else F.count_distinct
    host = F.when(F.col("responder_host") != "", F.col("responder_host"))
    port = F.when(F.col("responder_port") != 0, F.col("responder_port"))
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_pop("duration")).otherwise(F.lit(0.0))
    sums = [
        F.sum(c).cast("double").alias(f"{c}_sum")
        for c in (
            "originator_bytes",
            "responder_bytes",
            "originator_packets",
            "responder_packets",
        )
    ]
    grouped = events.groupBy(
        "capture_id", S.window_bucket("timestamp", seconds).alias("bucket")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("connection_count"),
        distinct(host).cast("double").alias("unique_destination_count"),
        distinct(port).cast("double").alias("unique_destination_port_count"),
        F.avg("duration").alias("duration_mean"),
        spread.alias("duration_std"),
        F.max("duration").alias("duration_max"),
        *sums,
        *shares("protocol", "protocol", PROTOCOLS),
        *shares("service", "service", SERVICES),
        *shares("connection_state", "state", STATES),
        label_flags(vocabulary, "label").alias("_flags"),
    )
    observed = flagged_labels(vocabulary, F.col("_flags"))
    return grouped.select(
        window_id(F.col("capture_id"), F.col("bucket"), client).alias("window_id"),
        (F.col("bucket") * seconds).alias("window_start_epoch"),
        ((F.col("bucket") + 1) * seconds).alias("window_end_epoch"),
        "capture_id",
        choose_label(observed, benign, mixed).alias("label"),
        observed.alias("observed_labels"),
        *[F.round(c, 12).alias(c) for c in FEATURES],
    )


def window_event_edges(events: DataFrame, *, seconds: int, client: str = "central") -> DataFrame:
    """Window-to-event lineage rows; a projection, no shuffle."""
    bucket = S.window_bucket("timestamp", seconds)
    return events.select(
        window_id(F.col("capture_id"), bucket, client).alias("window_id"),
        "event_id",
        "timestamp",
        "capture_id",
    )


def feature_vector(windows: DataFrame, name: str = "features") -> DataFrame:
    return windows.withColumn(name, F.array(*[F.col(c) for c in FEATURES]))


def capture_summary(windows: DataFrame, benign: Sequence[str] = BENIGN) -> DataFrame:
    """Start, rows, label mix and traffic regime of every capture."""
    attack = F.count_if(~F.col("label").isin(*benign))
    return windows.groupBy("capture_id").agg(
        F.min("window_start_epoch").alias("start_epoch"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("label").alias("label_count"),
        F.when(attack == 0, F.lit("benign_only")).otherwise(F.lit("attack_present")).alias("stratum"),
    )
