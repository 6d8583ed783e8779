"""Raw connection records to the fixed event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S

# Event field, accepted source fields in order of preference.
TEXT_FIELDS = {
    "uid": ("uid",),
    "originator_host": ("id.orig_h", "orig_h", "src_ip_zeek"),
    "responder_host": ("id.resp_h", "resp_h", "dest_ip_zeek"),
}
CATEGORY_FIELDS = {
    "protocol": ("proto",),
    "service": ("service",),
    "connection_state": ("conn_state",),
}
COUNT_FIELDS = {
    "responder_port": ("id.resp_p", "resp_p", "dest_port_zeek"),
    "originator_bytes": ("orig_bytes",),
    "responder_bytes": ("resp_bytes",),
    "originator_packets": ("orig_pkts",),
    "responder_packets": ("resp_pkts",),
}
LIST_FIELDS = ("observed_tactics", "observed_techniques")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _first_present(df: DataFrame, names: tuple[str, ...], blank_is_absent: bool) -> Column:
    found = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    if not found:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(c, F.lit("")) if blank_is_absent else c for c in found])


def _is_typed(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """Name of the only matching source column, when it already is a number."""
    present = [n for n in names if n in df.columns]
    if len(present) == 1 and dict(df.dtypes)[present[0]] in NUMERIC:
        return present[0]
    return None


def _number(df: DataFrame, names: tuple[str, ...], clean) -> Column:
    typed = _is_typed(df, names)
    if typed:
        return clean(F.col(f"`{typed}`"), typed=True)
    return clean(_first_present(df, names, False))


def normalize_events(
    df: DataFrame,
    *,
    event_id: Column,
    capture: Column,
    label: Column,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Events in the fixed schema; columns that already are numbers skip the text parsing.

    Label lists of consolidated sources, where present, come out as sorted arrays.
    """
    text = [F.coalesce(_first_present(df, n, True), F.lit("")).alias(k) for k, n in TEXT_FIELDS.items()]
    groups = [S.category(_first_present(df, n, False)).alias(k) for k, n in CATEGORY_FIELDS.items()]
    counts = [_number(df, n, S.nonnegative_int).alias(k) for k, n in COUNT_FIELDS.items()]

    lists = [
        F.array_sort(F.from_json(F.col(n).cast("string"), "array<string>")).alias(n)
        for n in LIST_FIELDS
        if n in df.columns
    ]

    def stamp(value: Column, typed: bool = False) -> Column:
        return S.finite_double(value, -1.0, typed)

    return df.select(
        event_id.alias("event_id"),
        _number(df, ("ts",), stamp).alias("timestamp"),
        capture.alias("capture_id"),
        *text,
        *groups,
        _number(df, ("duration",), S.finite_double).alias("duration"),
        *counts,
        label.alias("label"),
        *lists,
        *extra,
    )
