"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints are indexed under several bit orders. In each order two of six bit bands form the top
node of the hierarchy: fingerprints at most four bits apart agree on at least two bands, so only
members of one top node can be linked by that order. Below it, members stand in the order of the Gray
rank of their other bits; runs of neighbours form nodes that carry the bits all members agree on
(mask and pattern). A search descends pairs of nodes, adds up the differing bits that each level
newly fixes, and drops a pair of whole groups once the sum passes the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import stored, with_column
from tracelight.llm.components import components

BITS = 64
FAN = 16


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text (A-Z lower-cased); 0 without words."""
    import xxhash

    parts = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(parts)
    if not n:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    take = min(n, words)
    m = n - take + 1
    first, last = starts[:m].tolist(), ends[take - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, m, 65536):
        digests = [xxhash.xxh64_intdigest(flat[s:e], 42) for s, e in zip(first[lo : lo + 65536], last[lo : lo + 65536])]
        packed = np.array(digests, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(packed, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_key, fp) of every row; texts are read whole, one Arrow batch at a time."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "text_key", "fp"]
            )

    return rows.mapInArrow(run, f"id {kind}, text_key long, fp long")


def bands(max_diff: int) -> list[int]:
    """Masks of the top nodes: every pair of max_diff + 2 bit bands."""
    edges = np.linspace(0, BITS, max_diff + 3).round().astype(int)
    parts = [((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(parts, 2)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Positions of bit patterns in the Gray sequence: the running XOR of the bits from the top."""
    for step in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(step))
    return codes


def entries(batches: Iterator[pa.RecordBatch], masks: list[int]) -> Iterator[pa.RecordBatch]:
    """(table, top, rank, fp) of every code in every bit order."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for table, mask in enumerate(np.array(masks, np.uint64)):
            cells = [(fp & mask).view(np.int64), (gray_rank(fp & ~mask) >> np.uint64(1)).view(np.int64), fp.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(fp), table, np.int32)), *map(pa.array, cells)], ["table", "top", "rank", "fp"]
            )


def tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up: (mask of the bits a group agrees on, their pattern)."""
    full = np.full(len(codes), ~np.uint64(0))
    levels = [(full, codes)]
    low, high = codes, codes
    while len(low) > 1:
        cuts = np.arange(0, len(low), FAN)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
        levels.append((~(low ^ high), low))
    return levels


def close_pairs(codes: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of codes at most ``max_diff`` bits apart, by descending pairs of nodes."""
    levels = tree(codes)
    top = len(levels) - 1
    zero = np.zeros(1, np.int64)
    stack = [(top, zero, zero, zero, levels[top][0])]
    left, right = [zero[:0]], [zero[:0]]
    kids = np.arange(FAN)
    while stack:
        depth, a, b, spent, known = stack.pop()
        if len(a) > 1024:  # bounds what one step holds
            stack += [(depth, a[i:j], b[i:j], spent[i:j], known[i:j]) for i, j in ((0, 1024), (1024, len(a)))]
            continue
        i = (a[:, None, None] * FAN + kids[None, :, None] + 0 * kids[None, None, :]).ravel()
        j = (b[:, None, None] * FAN + kids[None, None, :] + 0 * kids[None, :, None]).ravel()
        ok = (i < j if depth == 1 else i <= j) & (j < len(levels[depth - 1][0]))
        each = np.repeat(np.arange(len(a)), FAN * FAN)[ok]
        i, j = i[ok], j[ok]
        mask, pattern = levels[depth - 1]
        shared = mask[i] & mask[j]
        total = spent[each] + np.bitwise_count((pattern[i] ^ pattern[j]) & shared & ~known[each])
        near = total <= max_diff
        if depth == 1:
            left.append(i[near])
            right.append(j[near])
        elif near.any():
            stack.append((depth - 1, i[near], j[near], total[near], shared[near]))
    return np.concatenate(left), np.concatenate(right)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position each of ``n`` positions reaches through the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def search(batches: Iterator[pa.RecordBatch], max_diff: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) inside the top nodes of a sorted stream; (a, null) for members of oversized ones.

    At most one node is held. One with more than ``limit`` members is passed on member by member and
    is linked by ``midpoints`` instead.
    """

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], ["a", "b"])

    def finished(top: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.flatnonzero((top[1:] != top[:-1]).any(axis=1)) + 1, [len(fp)]))
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[group] <= FAN
        for gap in range(1, FAN):  # many small nodes at once: neighbours at each distance
            if gap >= len(fp):
                break
            near = (group[gap:] == group[:-gap]) & small[gap:] & (np.bitwise_count(fp[gap:] ^ fp[:-gap]) <= max_diff)
            if near.any():
                yield out(fp[gap:][near], fp[:-gap][near])
        for k in np.flatnonzero(sizes > FAN):
            own = fp[cuts[k] : cuts[k + 1]]
            if len(own) > limit:
                yield out(own, None)
                continue
            label = spanning(len(own), *close_pairs(own, max_diff))
            linked = label != np.arange(len(own))
            yield out(own[linked], own[label[linked]])

    top, fp, hot = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        new_top = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
        new_fp = batch.column(2).to_numpy().view(np.uint64)
        if hot is not None:
            same = (new_top == hot).all(axis=1)
            if same.any():
                yield out(new_fp[same], None)
            new_top, new_fp = new_top[~same], new_fp[~same]
        top, fp = np.concatenate([top, new_top]), np.concatenate([fp, new_fp])
        if not len(fp):
            continue
        breaks = np.flatnonzero((top[1:] != top[:-1]).any(axis=1))
        cut = breaks[-1] + 1 if len(breaks) else 0
        if cut:
            yield from finished(top[:cut], fp[:cut])
            top, fp = top[cut:], fp[cut:]
        if len(fp) > limit:
            yield out(fp, None)
            hot, top, fp = top[0], top[:0], fp[:0]
    if len(fp):
        yield from finished(top, fp)


def midpoints(codes: DataFrame, max_diff: int) -> DataFrame:
    """Links (a, b) among the codes of oversized nodes, at a cost linear in their number.

    Two codes are at most 2r bits apart exactly if some pattern is within r bits of both. Every code
    names all patterns in its ball; the members of a pattern are linked to their smallest one.
    """
    half = max_diff // 2
    flips = np.array(
        [sum(1 << i for i in bits) for r in range(half + 1) for bits in combinations(range(BITS), r)], np.uint64
    )

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(own), 64):
                part = own[lo : lo + 64]
                near = (part[:, None] ^ flips[None, :]).ravel()
                code = np.repeat(part, len(flips))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.view(np.int64)), pa.array(code.view(np.int64))], ["near", "a"]
                )

    balls = codes.mapInArrow(ball, "near long, a long")
    low = balls.groupBy("near").agg(F.min("a").alias("b"), F.max("a").alias("high")).where("b <> high")
    return balls.join(low.select("near", "b"), "near").where("a <> b").select("a", "b").distinct()


def links(codes: DataFrame, max_diff: int = 4, limit: int = 8192) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that join all within ``max_diff`` bits."""
    if max_diff % 2:
        raise ValueError("max_diff must be even")
    masks = bands(max_diff)
    spread = codes.select("fp").mapInArrow(lambda it: entries(it, masks), "table int, top long, rank long, fp long")
    ordered = spread.repartition("table", "top").sortWithinPartitions("table", "top", "rank", "fp").drop("rank")
    found = stored(ordered.mapInArrow(lambda it: search(it, max_diff, limit), "a long, b long"), "simhash-links")
    plain = found.where("b IS NOT NULL").distinct()
    hot = found.where("b IS NULL").select("a").distinct()
    return plain.union(midpoints(hot, max_diff))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_diff: int = 4, limit: int = 8192
) -> DataFrame:
    """One row per row of ``docs``: id, text_key, fp and ``component_id``.

    ``component_id`` is the smallest id that can be reached over fingerprints at most ``max_diff`` bits
    apart, the document's own included. A null or empty text has fingerprint 0 and is linked like any
    other. A null id gets a fingerprint and a component but never names one; a component of null ids
    only is null. Repeated rows each come out. An empty table gives an empty result; other columns
    are ignored. Exact copies meet in one fingerprint before any search.
    """
    own = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    first = stored(own.groupBy("fp").agg(F.min("id").alias("low")), "simhash-codes")
    nodes = components(links(first.select("fp"), max_diff, limit), "a", "b")
    inside = first.join(nodes, first.fp == nodes.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    named = inside.groupBy("root").agg(F.min("low").alias("component_id"))
    named = inside.join(named, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id_col), "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with its id stays, once.

    Rows with a null id stay if their component has no id at all.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    tagged, key = with_column(docs, "_own", F.xxhash64(text_col))
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col, F.col("text_key").alias(key))
    stay = stay.distinct().alias("stay")
    same = F.col(f"docs.{id_col}").eqNullSafe(F.col(f"stay.{id_col}")) & (F.col(f"docs.{key}") == F.col(f"stay.{key}"))
    kept = tagged.alias("docs").join(stay, same, "left_semi")
    order = Window.partitionBy(id_col).orderBy(key)
    once, number = with_column(kept.where(F.col(id_col).isNotNull()), "_n", F.row_number().over(order))
    once = once.where(F.col(number) == 1).drop(number)
    return once.union(kept.where(F.col(id_col).isNull())).drop(key)
