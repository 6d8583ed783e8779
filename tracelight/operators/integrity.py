"""Hash chains, custody and round sequences, measurement logs, replays.

Verifying is parallel: the predecessor of a record is found by an equi-join on its position, not by a
window over a whole (possibly hot) chain. Building a chain and following what was accepted of it are
sequential by nature; they stream over sorted rows and keep only the heads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import scalars as S
from tracelight.operators.ranking import same_keys

GENESIS = "0" * 64


def chain_hash(previous: Column | str, content: Column | str, core_digest: Column | str) -> Column:
    """SHA-256 over the three binary digests of predecessor, content and manifest core."""
    parts = [F.unhex(F.col(p) if isinstance(p, str) else p) for p in (previous, content, core_digest)]
    return F.sha2(F.concat(*parts), 256)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[bytes, Sequence[bytes]], bytes],
    digests: Sequence[str],
    output: str,
    late: Callable[[DataFrame], DataFrame] | None = None,
    previous: str | None = None,
) -> DataFrame:
    """Running digest per key in order: every row gets ``step(previous, its digests)`` as hex.

    Rows stream through sorted partitions batch by batch and only the last digest is carried on, so a
    long chain needs time, not memory. ``late`` adds columns (digests) to rows that are already placed, so that
    these are neither shuffled nor sorted; it must keep rows, their order and the keys. ``previous`` names a column
    for the digest of the row before, 32 zero bytes for the first.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    placed = late(placed) if late else placed
    added = [output, *([previous] if previous else [])]
    schema = T.StructType([*placed.schema.fields, *[T.StructField(name, T.StringType()) for name in added]])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, value = None, b""
        for batch in batches:
            results, earlier = [], []
            key_rows = zip(*[batch[k] for k in keys], strict=True)
            digest_rows = zip(*[batch[d] for d in digests], strict=True)
            for key, row in zip(key_rows, digest_rows, strict=True):
                if key != current:
                    current, value = key, bytes(32)
                earlier.append(value.hex())
                value = step(value, [bytes.fromhex(d) for d in row])
                results.append(value.hex())
            yield batch.assign(**dict(zip(added, (results, earlier))))

    return placed.mapInPandas(run, schema)


def build_chain(
    batches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    content: str = "content_sha256",
    core: str = "core_sha256",
    late: Callable[[DataFrame], DataFrame] | None = None,
    previous: str | None = None,
) -> DataFrame:
    """Adds ``chain_hash`` to batches that are to be linked per key; ``late`` and ``previous`` as in :func:`ordered_fold`."""
    return ordered_fold(
        batches,
        keys,
        order,
        lambda previous, row: hashlib.sha256(previous + row[0] + row[1]).digest(),
        [content, core],
        "chain_hash",
        late,
        previous,
    )


def replay_registers(
    log: DataFrame, register: str, sequence: str, measurement: str
) -> DataFrame:
    """Final value of every register after extending it with its measurements in order."""
    folded = ordered_fold(
        log.select(register, sequence, measurement),
        [register],
        [sequence],
        lambda value, row: hashlib.sha256(value + row[0]).digest(),
        [measurement],
        "_value",
    )
    return folded.groupBy(register).agg(
        F.max_by("_value", sequence).alias("register_value"),
        F.count(F.lit(1)).alias("event_count"),
        (
            (F.min(sequence) == 0)
            & (F.max(sequence) == F.count(F.lit(1)) - 1)
            & (F.count_distinct(sequence) == F.count(F.lit(1)))
        ).alias("contiguous"),
    )


def predecessor(
    df: DataFrame, keys: Sequence[str], sequence: str, columns: Sequence[str], prefix: str = "previous_"
) -> DataFrame:
    """Values of the record one position earlier, null for the first; positions are unique per key."""
    shifted = df.select(
        *keys,
        (F.col(sequence) + 1).alias(sequence),
        *[F.col(c).alias(f"{prefix}{c}") for c in columns],
    )
    return same_keys(df, shifted, [*keys, sequence], "left")


def verify_links(batches: DataFrame) -> DataFrame:
    """Whether the recorded chain hash is the one the recorded parts give."""
    expected = chain_hash("previous_chain_hash", "content_sha256", "core_sha256")
    return batches.withColumn("link_valid", F.col("chain_hash") == expected)


class ChainHeads:
    """What a client has had accepted: its latest commitment, and position and commitment per session."""

    def __init__(self, head: str | bytes = GENESIS, sessions: dict[str, tuple[int, str | bytes]] | None = None) -> None:
        self.head, self.sessions = head, sessions or {}

    def receive(self, session: str, position: int, previous: str | bytes, commitment: str | bytes, eligible: bool) -> str:
        """Verdict on the next batch. Only an eligible batch that fits moves the heads on."""
        place, link = self.sessions.get(session, (-1, self.head))
        if position != place + 1:
            return "sequence-gap"
        if previous != link:
            return "wrong-predecessor"
        if eligible:
            self.sessions[session] = (position, commitment)
            self.head = commitment
        return "continuous"


POSITION = ("client_id", "session_id", "sequence_number")


def verify_continuity(batches: DataFrame, eligible: Column | None = None, arrival: str = "acquired_at") -> DataFrame:
    """Adds ``continuity``: whether a batch follows what had been *accepted* of its client before it.

    A batch is accepted if it is continuous and ``eligible`` (its other checks passed; by default all
    are). A session starts at position 0 with the client's last accepted commitment, or the genesis
    value, as predecessor; later batches follow the session's last accepted one. So whatever comes
    after a missing, altered or refused batch is refused until it links to the accepted state again.

    The first delivery of a position counts. Equal later ones share its verdict, other commitments for
    the position conflict, and neither adds rows or moves the state. Acceptance is sequential per client:
    one row per position streams through sorted partitions, and a task holds one client's open heads. Hashes travel
    packed.
    """
    judged = F.coalesce(F.lit(True) if eligible is None else eligible, F.lit(False))
    hashes = [S.pack_digest(c).alias(c) for c in ("chain_hash", "previous_chain_hash")]
    parts = [F.col(arrival).alias("at"), *hashes, judged.alias("eligible")]
    firsts = batches.groupBy(*POSITION).agg(F.min(F.struct(*parts)).alias("_f"))
    placed = firsts.select(*POSITION, "_f.*").repartition("client_id")
    placed = placed.sortWithinPartitions("client_id", "at", "session_id", "sequence_number")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, heads = None, ChainHeads(bytes.fromhex(GENESIS))
        names = ("client_id", "session_id", "sequence_number", "previous_chain_hash", "chain_hash", "eligible")
        for frame in frames:
            verdicts = []
            for own, *rest in zip(*[frame[n] for n in names], strict=True):
                if own != client:
                    client, heads = own, ChainHeads(bytes.fromhex(GENESIS))
                verdicts.append(heads.receive(*rest))
            yield frame[list(POSITION)].assign(_first=frame["chain_hash"], _verdict=verdicts)

    fields = [batches.schema[c] for c in POSITION]
    schema = T.StructType([*fields, T.StructField("_first", T.BinaryType()), T.StructField("_verdict", T.StringType())])
    marked = batches.withColumn("_chain", S.pack_digest("chain_hash"))
    joined = same_keys(marked, placed.mapInPandas(run, schema), POSITION)
    verdict = F.when(F.col("_chain").eqNullSafe(F.col("_first")), F.col("_verdict")).otherwise("conflicting-commitment")
    return joined.withColumn("continuity", verdict).drop("_chain", "_first", "_verdict")


def verify_custody(
    events: DataFrame, core: dict[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Sequence, predecessor and digest errors of custody chains, per event."""
    linked = predecessor(events, keys, "sequence_number", ["event_hash"], "_before_")
    first = F.col("sequence_number") == 0
    expected = F.when(first, F.lit(GENESIS)).otherwise(F.col("_before_event_hash"))
    return linked.select(
        *keys,
        "sequence_number",
        (first | F.col("_before_event_hash").isNotNull()).alias("sequence_valid"),
        F.coalesce(F.col("previous_event_hash") == expected, F.lit(False)).alias("predecessor_valid"),
        (F.col("event_hash") == S.object_digest(core)).alias("digest_valid"),
    )


def verify_rounds(rounds: DataFrame) -> DataFrame:
    """Round by round: contiguous number, hash of the record before, model of the round before."""
    linked = predecessor(rounds, [], "round", ["record_sha256", "model_sha256"], "_before_")
    first = F.col("round") == 1
    return linked.select(
        "round",
        (first | F.col("_before_record_sha256").isNotNull()).alias("contiguous"),
        F.coalesce(
            F.col("previous_round_sha256")
            == F.when(first, F.lit(GENESIS)).otherwise(F.col("_before_record_sha256")),
            F.lit(False),
        ).alias("hash_chain_valid"),
        F.coalesce(
            first | (F.col("base_model_sha256") == F.col("_before_model_sha256")), F.lit(False)
        ).alias("base_model_valid"),
    )


def classify_replays(
    submissions: DataFrame, keys: Sequence[str], commitment: str, arrival: str
) -> DataFrame:
    """Per position and commitment: the first to arrive wins, equal ones are replays, others conflict.

    Copies are counted, not listed, so a position that is replayed without end stays one row. The winner
    is a grouped minimum that is joined back, so many conflicting commitments never meet in one sort.
    """
    variants = submissions.groupBy(*keys, commitment).agg(
        F.count(F.lit(1)).alias("copies"), F.min(arrival).alias("first_arrival")
    )
    winners = variants.groupBy(*keys).agg(
        F.min(F.struct("first_arrival", F.col(commitment).alias("commitment"))).alias("_winner")
    )
    winner = F.col(commitment).eqNullSafe(F.col("_winner.commitment"))
    return same_keys(variants, winners, keys).select(
        *keys,
        commitment,
        "copies",
        "first_arrival",
        F.when(winner, F.lit("accepted")).otherwise(F.lit("conflict")).alias("status"),
        F.when(winner, F.col("copies") - 1).otherwise(F.lit(0)).alias("replay_count"),
    )
