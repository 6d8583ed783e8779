"""Cleaning, labelling, time and hashing functions on single values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that mean "no value" in connection logs.
MISSING_MARKERS = ("", "-")

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
HEX_DIGEST = "^[0-9a-f]{64}$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_missing(value: Column | str) -> Column:
    value = _col(value)
    return value.isNull() | value.isin(*MISSING_MARKERS)


def finite_double(value: Column | str, default: float | None = 0.0, typed: bool = False) -> Column:
    """Number in ``value``, or ``default`` for blanks, text, NaN and infinities.

    ``typed`` skips the text pattern for columns that already are numeric.
    """
    value = _col(value)
    if typed:
        number = F.nullif(value.cast("double"), F.lit(float("nan")))
    else:
        text = value.cast("string")
        number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    # nullif evaluates its operand once, so the pattern runs once per value.
    finite = F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))
    return F.coalesce(finite, F.lit(default).cast("double"))


def nonnegative_int(value: Column | str, typed: bool = False) -> Column:
    """Whole part of the number in ``value``, never below zero; blanks give zero."""
    number = F.greatest(finite_double(value, 0.0, typed), F.lit(0.0))
    return F.coalesce(number.try_cast("bigint"), F.lit(2**63 - 1))


def category(value: Column | str, missing: str = "missing") -> Column:
    """Lower-case trimmed category; the blank test looks at the untrimmed text."""
    value = _col(value)
    return F.when(is_missing(value), F.lit(missing)).otherwise(F.lower(F.trim(value)))


def first_label(*fields: Column | str) -> Column:
    """First non-blank of several label fields, trimmed and in lower case."""
    present = [F.nullif(_col(f), F.lit("")) for f in fields]
    return F.lower(F.trim(F.coalesce(*present)))


def slug(value: Column | str) -> Column:
    """Lower-case words joined by single underscores, ``unknown`` when nothing is left."""
    words = F.regexp_replace(F.lower(F.trim(_col(value))), "[^a-z0-9]+", "_")
    bare = F.regexp_replace(words, "^_+|_+$", "")
    return F.when(bare == "", F.lit("unknown")).otherwise(bare)


def tactic(value: Column | str) -> Column:
    """Tactic label of a source value: the marker ``none`` means benign traffic."""
    value = _col(value)
    return F.when(F.lower(F.trim(value)) == "none", F.lit("benign")).otherwise(slug(value))


def parse_utc(text: Column | str) -> Column:
    """Timestamp of an ISO text that states its UTC offset; null for any other text."""
    text = _col(text)
    return F.when(text.rlike(_OFFSET_TIME), text.try_cast("timestamp"))


def iso_utc(epoch_seconds: Column | str) -> Column:
    """ISO text with a trailing ``Z`` for epoch seconds (session zone is UTC)."""
    moment = F.timestamp_seconds(_col(epoch_seconds))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_seconds(moment: Column | str) -> Column:
    """Epoch seconds with microseconds as a double."""
    return F.unix_micros(_col(moment).cast("timestamp")) / F.lit(1e6)


def calendar_day(moment: Column | str) -> Column:
    return F.date_format(_col(moment), "yyyy-MM-dd")


def window_bucket(epoch: Column | str, seconds: int) -> Column:
    return F.floor(_col(epoch) / F.lit(float(seconds))).cast("bigint")


def canonical_digest(*values: Column | str) -> Column:
    """SHA-256 of the compact JSON list of the values as text; nulls count as blanks."""
    texts = [F.coalesce(_col(v).cast("string"), F.lit("")) for v in values]
    return F.sha2(F.to_json(F.array(*texts)), 256)


def object_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON object: sorted names, no spaces, nulls kept.

    Callers pass text, whole numbers and booleans only. Fractions have no single text form, so they
    go in as rounded decimal strings.
    """
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def derived_id(prefix: str, digest: Column, length: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest, 1, length))


def seeded_digest(seed: int | str, *parts: Column | str) -> Column:
    """SHA-256 of ``seed:part:part`` for label-blind, repeatable ordering."""
    pieces = [F.lit(str(seed))] + [_col(p).cast("string") for p in parts]
    return F.sha2(F.concat_ws(":", *pieces), 256)


def hash_bucket(seed: int | str, identity: Column | str, modulus: int = 100) -> Column:
    """Bucket of the first eight digest bytes, read as an unsigned big-endian number."""
    head = F.substring(seeded_digest(seed, identity), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(modulus)).cast("int")


# Bounds and names of the event-count ranges.
EVENT_COUNT_RANGES = (("1", 1), ("2-5", 5), ("6-20", 20), ("21-100", 100), (">100", None))


def event_count_range(count: Column | str) -> Column:
    count = _col(count)
    chain = F
    for name, upper in EVENT_COUNT_RANGES:
        if upper is None:
            return chain.otherwise(F.lit(name))
        chain = chain.when(count <= upper, F.lit(name))
    raise AssertionError("the last range has no upper bound")


def support_category(count: Column | str, rare_below: int = 5) -> Column:
    count = _col(count)
    return (
        F.when(count == 0, F.lit("absent"))
        .when(count < rare_below, F.lit("rare"))
        .otherwise(F.lit("supported"))
    )


def is_hex_digest(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(HEX_DIGEST), F.lit(False))


def direction(value: Column | str) -> Column:
    """Whether an attribution raises or lowers the explained score."""
    value = _col(value)
    return (
        F.when(value > 0, F.lit("supports-target"))
        .when(value < 0, F.lit("opposes-target"))
        .otherwise(F.lit("neutral"))
    )


def ratio(part: Column | str, whole: Column | str, empty: float | None = 0.0) -> Column:
    """Quotient with a stated value for an empty denominator."""
    whole = _col(whole)
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(
        _col(part).cast("double") / whole.cast("double")
    )


def scale_token(value: Column | str, digits: int = 6) -> Column:
    """File-name form of a decimal setting: ``1.5`` becomes ``1p5``, ``2`` becomes ``2p0``."""
    text = _col(value).cast(f"decimal(20,{digits})").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")
    return F.translate(trimmed, "-.", "mp")


def one_of(value: Column | str, names: Sequence[str]) -> Column:
    """Zero-based position of a label in a fixed vocabulary; unknown labels stop the job."""
    value = _col(value)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(place > 0, (place - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("label outside the vocabulary: "), F.coalesce(value, F.lit("null"))))
        .cast("int")
    )


def pack_digest(digest: Column | str) -> Column:
    """A hexadecimal SHA-256 as its 32 bytes, any other text in longer bytes: half the size, and nothing is lost.

    Packed digests are equal, and sort, as their texts do; other texts come before them.
    """
    digest = F.col(digest) if isinstance(digest, str) else digest
    other = F.concat(F.lit(bytes(33)), F.encode(digest, "UTF-8"))
    return F.when(digest.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(digest)).otherwise(other)


def unpack_digest(packed: Column | str) -> Column:
    """Inverse of :func:`pack_digest`."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    other = F.decode(F.substring(packed, 34, 2**31 - 1), "UTF-8")
    return F.when(F.octet_length(packed) == 32, F.lower(F.hex(packed))).otherwise(other)
