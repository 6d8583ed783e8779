"""Blocks of rows and pages of prototype tiles as arrays, and what the rows of a block find in a page."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distances are compared as the integers of the same bits: not known comes first, as null does in Spark, not a number last.
UNKNOWN, NAN, EMPTY = -1, int(np.array(np.nan).view(np.int64)) & ~(1 << 63), np.iinfo(np.int64).max
#: Norm up to which squares stay far from infinity, share of the squared norms that covers the rounding of a product of up to 10,000 values.
PLAIN, ROUNDING = 1e100, 1e-11
#: Values at once where distances are worked out one by one, and bytes of the vectors that make a block or a page.
PIECE, BYTES = 1 << 20, 1 << 23


def apart(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Distances of all rows to all members, added up in the order of the components as ``V.l2_distance`` does."""
    total = np.zeros((len(rows), len(members)))
    with np.errstate(all="ignore"):
        for x, m in zip(rows.T, members.T, strict=True):
            total += (x[:, None] - m[None, :]) ** 2
    return np.sqrt(total)


def _codes(distances: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(distances), NAN, np.ascontiguousarray(distances).view(np.int64))


def vectors(column: pa.ListArray) -> tuple[np.ndarray, list[bytes]]:
    """Width (-1: the vector or one of its values is null) and bytes of each vector, in four bytes a value where that loses nothing."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = column.flatten()
    gone = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (gone[ends] == gone[ends - sizes])
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype("<f8")
    values = _short(values)
    return np.where(whole, sizes, -1).astype(np.int32), [values[e - n : e].tobytes() if w else b"" for e, n, w in zip(ends, sizes, whole, strict=True)]


def unpacked(column: pa.StructArray) -> tuple[np.ndarray, list[bytes]]:
    """Widths and bytes of packed vectors, as :func:`vectors` gives them."""
    widths, values = column.flatten()
    return pc.fill_null(widths, -1).to_numpy(zero_copy_only=False), pc.fill_null(values, b"").to_pylist()


def between(one: tuple[np.ndarray, list[bytes]], other: tuple[np.ndarray, list[bytes]]) -> pa.Array:
    """Distances of pairs of vectors; null where one is missing or the widths differ."""
    known = (one[0] == other[0]) & (one[0] >= 0)
    out, b = np.zeros(len(known)), matrices(np.where(known, other[0], -1), other[1])
    for w, (at, x) in matrices(np.where(known, one[0], -1), one[1]).items():
        if w:
            with np.errstate(all="ignore"):
                out[at] = np.sqrt(np.cumsum((x - b[w][1]) ** 2, axis=1)[:, -1])
    return pa.array(out, mask=~known)


def _short(values: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        short = values.astype("<f4")
    return short if np.array_equal(short.astype("<f8"), values, equal_nan=True) else values


def matrices(widths: Sequence[int], packed: Sequence[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per width the places of the vectors that have it, and the vectors as a matrix."""
    widths = np.asarray(widths)
    out = {}
    for w in np.unique(widths[widths >= 0]).tolist():
        at = np.flatnonzero(widths == w)
        rows = [np.frombuffer(packed[i], "<f4" if len(packed[i]) == 4 * w else "<f8") for i in at] if w else []
        out[w] = at, np.array(rows, dtype="<f8").reshape(len(at), w)
    return out


def measured(parts: dict, count: int, pivot: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Norm and distance to the pivot; not a number where a vector has none."""
    norm, far = np.full(count, np.nan), np.full(count, np.nan)
    with np.errstate(all="ignore"):
        for w, (at, x) in parts.items():
            if w == len(pivot):
                norm[at], far[at] = np.sqrt((x * x).sum(axis=1)), np.sqrt(((x - np.asarray(pivot)) ** 2).sum(axis=1))
    odd = ~(np.isfinite(norm) & np.isfinite(far))
    norm[odd] = far[odd] = np.nan
    return norm, far


class Bounds:
    """Bounds of norm and distance to the pivot of all tiles, in the order of their numbers, without gaps."""

    def __init__(self, rows: Sequence, pivot: Sequence[float]) -> None:
        rows = sorted(tuple(r) for r in rows)
        self.pivot = list(pivot)
        self.tiles = np.array([r[0] for r in rows], dtype=np.int32)
        self.limits = np.array([[np.nan if x is None else x for x in r[1:]] for r in rows], dtype=float).reshape(len(rows), 4).T

    def gaps(self, norm: np.ndarray, far: np.ndarray, tiles: np.ndarray) -> np.ndarray:
        """No member of a tile is nearer to a row; a margin covers rounding. What has no distance to the pivot may be near to any."""
        norm_low, norm_high, far_low, far_high = self.limits[:, np.searchsorted(self.tiles, tiles)][:, None, :]
        n, d = norm[:, None], far[:, None]
        apart = np.fmax(np.fmax(norm_low - n, n - norm_high), np.fmax(far_low - d, d - far_high))
        return np.fmax(0.0, apart - (n + d) * 1e-9)

    def home(self, norm: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The tile that norm and distance to the pivot point to."""
        out = np.zeros(len(norm), dtype=np.int32)
        for i in range(0, len(norm) if len(self.tiles) else 0, 1024):
            gap, d = self.gaps(norm[i : i + 1024], far[i : i + 1024], self.tiles), far[i : i + 1024, None]
            middle = np.nan_to_num(np.abs(d - (self.limits[2] + self.limits[3]) / 2), nan=np.inf)
            middle[gap > gap.min(axis=1)[:, None]] = np.inf
            out[i : i + 1024] = self.tiles[np.where(np.isinf(middle).all(axis=1), gap.argmin(axis=1), middle.argmin(axis=1))]
        return out


def _earlier(a: object, b: object) -> bool:
    return b is not None and (a is None or a < b)


class Page:
    """Members of some tiles, in class order, nulls first. Equal vectors of a tile are one: the first stands for all, ``twin`` is the second."""

    def __init__(self, data: bytes | pa.Buffer) -> None:
        self.label, classes, tiles, widths, packed = pickle.loads(data)
        self.classes = np.empty(len(classes), dtype=object)
        self.classes[:] = classes
        self.tiles, self.tile_of = np.unique(tiles, return_inverse=True)
        self.widths, self.parts, self.equal = widths, {}, {}
        for i, key in enumerate(zip(self.tile_of.tolist(), widths.tolist(), packed, strict=True)):
            self.equal.setdefault(key, []).append(i)
        self.equal = {same[0]: same for same in self.equal.values()}
        self.twin, self.copies = np.full(len(classes), -1), np.zeros(len(classes), dtype=np.int64)
        for i, same in self.equal.items():
            self.copies[i] = len(same)
            if len(same) > 1:
                self.twin[i] = same[1]
        for w, (at, m) in matrices(widths, packed).items():
            first = self.copies[at] > 0
            at, m = at[first], m[first]
            with np.errstate(all="ignore"):
                squares = (m * m).sum(axis=1)
            plain = squares < PLAIN**2  # not if it is no number
            self.parts[w] = at, m, plain, np.column_stack([-2 * m, np.ones(len(m)), squares])

    def earlier(self, member: int, own: object) -> int:
        """Equal vectors whose class comes before ``own``."""
        return bisect_left(self.equal[member], True, key=lambda i: not _earlier(self.classes[i], own))


def pieces(rows: Iterator[tuple], size: int, vector: int) -> Iterator[list[tuple]]:
    """Lists of ``size`` rows, or fewer if their packed vectors (at place ``vector``) come to ``BYTES``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[vector])
        if len(held) == size or total >= BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def paged(rows: Iterator[tuple[int, object, int, bytes]], label: pa.DataType, size: int) -> Iterator[tuple[list[int], bytes]]:
    """Tiles and data of the pages that the members (tile, class, width, vector) make in the order in which they come."""
    for held in pieces(rows, size, 3):
        held.sort(key=lambda r: (r[1] is not None, *([] if r[1] is None else [r[1]])))
        tiles, classes, widths, packed = zip(*held, strict=True)
        data = label, list(classes), np.array(tiles, dtype=np.int32), np.array(widths, dtype=np.int32), list(packed)
        yield sorted(set(tiles)), pickle.dumps(data, protocol=5)


class Block:
    """Rows that meet pages together: their vectors, the distance of their own class, and the best two members they met so far."""

    def __init__(self, kind: pa.DataType, rows: Sequence[tuple]) -> None:
        ids, own, far, widths, packed, home = (list(x) for x in zip(*rows, strict=True))
        self.kind, self.ids, self.own, self.label = kind, ids, own, None
        self.has = np.array([x is not None for x in far])
        self.far = np.array([np.nan if x is None else x for x in far], dtype=float)
        self.widths, self.home = np.array(widths, dtype=np.int32), np.array(home, dtype=np.int32)
        self.parts = matrices(widths, packed)
        self.nearer = np.zeros(len(ids), dtype=np.int64)
        self.code, self.best = np.full((len(ids), 2), EMPTY), np.full((len(ids), 2), None, dtype=object)

    def dumps(self) -> bytes:
        state = self.__dict__ | {"parts": {w: (at, _short(x)) for w, (at, x) in self.parts.items()}}
        return pickle.dumps({k: v for k, v in state.items() if not k.startswith("_")}, protocol=5)

    @staticmethod
    def loads(data: bytes | pa.Buffer) -> Block:
        self = Block.__new__(Block)
        self.__dict__.update(pickle.loads(data))
        self.parts = {w: (at, x.astype("<f8")) for w, (at, x) in self.parts.items()}
        self._placed, self._sized = None, {}
        for w, (at, x) in self.parts.items():
            with np.errstate(all="ignore"):
                squares = (x * x).sum(axis=1)
            self._sized[w] = squares < PLAIN**2, np.column_stack([x, squares, np.ones(len(x))]), squares
        return self

    def reach(self) -> np.ndarray:
        """A member that is farther than this changes nothing."""
        second = self.code[:, 1]
        held = np.where((second < 0) | (second >= NAN), np.inf, second.view(np.float64))
        return np.where(self.has, np.maximum(held, np.where(np.isnan(self.far), np.inf, self.far)), held)

    def near(self, bounds: Bounds, tiles: np.ndarray) -> np.ndarray:
        """Row by tile: the tile may hold a member in reach. Unlike the home tile it was not met yet."""
        if self._placed is None:
            self._placed = measured(self.parts, len(self.ids), bounds.pivot)
        return (bounds.gaps(*self._placed, tiles) <= self.reach()[:, None]) & (self.home[:, None] != tiles)

    def needs(self, bounds: Bounds) -> list[int]:
        """Tiles in reach of a row, and the home tiles, so that every block meets a page."""
        return np.union1d(self.home, bounds.tiles[self.near(bounds, bounds.tiles).any(axis=0)]).tolist()

    def meet(self, page: Page, allowed: np.ndarray) -> None:
        """Rows meet the members of the tiles (columns, as in ``page.tiles``) that are theirs to meet."""
        self.label = page.label
        rows, tiles = np.flatnonzero(allowed.any(axis=1)), np.flatnonzero(allowed.any(axis=0))
        if not len(rows):
            return
        if allowed[np.ix_(rows, tiles)].mean() < 0.5 and len(tiles) > 1:
            for t in tiles:
                self._meet(page, np.flatnonzero(allowed[:, t]), np.flatnonzero(page.tile_of == t), allowed)
        else:
            self._meet(page, rows, np.flatnonzero(np.isin(page.tile_of, tiles)), allowed)

    def _meet(self, page: Page, rows: np.ndarray, members: np.ndarray, allowed: np.ndarray) -> None:
        inside = np.zeros(len(self.ids), dtype=bool)
        inside[rows] = True
        chosen = np.zeros(len(page.classes), dtype=bool)
        chosen[members] = True
        for w in np.unique(self.widths[rows]).tolist():
            mine = np.flatnonzero(inside & (self.widths == w))
            self._unlike(page, mine, members if w < 0 else members[page.widths[members] != w], allowed)
            if w < 0 or w not in page.parts:
                continue
            row_at, row_plain, member_at, member_plain = self.parts[w][0], self._sized[w][0], page.parts[w][0], page.parts[w][2]
            x, m = inside[row_at], chosen[member_at]
            self._alike(page, w, np.flatnonzero(x & row_plain), np.flatnonzero(m & member_plain), allowed)
            for i, j in ((x & ~row_plain, m), (x & row_plain, m & ~member_plain)):
                self._odd(page, w, np.flatnonzero(i), np.flatnonzero(j), allowed)

    def _unlike(self, page: Page, rows: np.ndarray, members: np.ndarray, allowed: np.ndarray) -> None:
        """Members without a distance to the rows."""
        if not len(rows) or not len(members):
            return
        met = allowed[np.ix_(rows, page.tile_of[members])]
        count = met.sum(axis=1)
        self.nearer[rows] += np.where(self.has[rows], count, 0)
        i, j = np.divmod(np.flatnonzero(met), len(members))
        first = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) < 2
        self._keep(page, rows[i[first]], members[j[first]], np.full(first.sum(), UNKNOWN))

    def _odd(self, page: Page, w: int, i: np.ndarray, j: np.ndarray, allowed: np.ndarray) -> None:
        """Values that are not finite, or very large ones: all distances are worked out."""
        if not len(i) or not len(j):
            return
        (row_at, x), (member_at, m) = self.parts[w], page.parts[w][:2]
        members = member_at[j]
        for at in range(0, len(i), 256):
            part = i[at : at + 256]
            rows = row_at[part]
            met = allowed[np.ix_(rows, page.tile_of[members])]
            a, b = np.nonzero(met)
            code = _codes(apart(x[part], m[j]))[a, b]
            self._count(page, rows[a], members[b], code)
            self._keep(page, rows[a], members[b], code)

    def _alike(self, page: Page, w: int, i: np.ndarray, j: np.ndarray, allowed: np.ndarray) -> None:
        if not len(i) or not len(j):
            return
        right = page.parts[w][3][j]
        for at in range(0, len(i), 256):  # a product of this size stays in a core's cache
            self._piece(page, w, i[at : at + 256], j, right, allowed)

    def _piece(self, page: Page, w: int, i: np.ndarray, j: np.ndarray, right: np.ndarray, allowed: np.ndarray) -> None:
        """A matrix product, whose rounding is bounded, leaves out what cannot matter; the others' distances are worked out."""
        (row_at, x), (member_at, m) = self.parts[w], page.parts[w][:2]
        _, left, squares = self._sized[w]
        rows, members = row_at[i], member_at[j]
        about = left[i] @ right.T
        tiles = page.tile_of[members]
        part = np.flatnonzero(~allowed[np.ix_(rows, np.unique(tiles))].all(axis=1))
        if len(part):
            about[part] = np.where(allowed[np.ix_(rows[part], tiles)], about[part], np.inf)
        margin = (squares[i] + right[:, -1].max()) * ROUNDING * max(1, w / 10_000) + 1e-290
        second = self.code[rows, 1]
        held = np.where(second >= NAN, np.inf, np.where(second < 0, -1.0, second.view(np.float64)))  # nothing comes before what is not known
        with np.errstate(all="ignore"):
            limit = np.where(held < 0, -np.inf, np.minimum(held**2 + margin, PLAIN**3))
            fresh = np.flatnonzero(limit == PLAIN**3)
            if len(fresh) and len(j) > 1:
                limit[fresh] = np.minimum(limit[fresh], np.partition(about[fresh], 1, axis=1)[:, 1] + 2 * margin[fresh])
            far = np.where(np.isnan(self.far[rows]), np.inf, self.far[rows]) ** 2
            beyond = self.has[rows] & ~(far + 2 * margin <= limit)  # members nearer than the own class that the limit leaves out
            if beyond.any():
                these = np.flatnonzero(beyond)
                a, f, e = about[these], far[these, None], margin[these, None]
                self.nearer[rows[these]] += ((a < f - e) @ page.copies[members].astype(float)).astype(np.int64)
                r, c = np.nonzero(np.abs(a - f) <= e)
                for s, t, code in _exact(x, m, i[these[r]], j[c]):
                    self._count(page, rows[these[r[s:t]]], members[c[s:t]], code)
            close = about <= limit[:, None]
        r, c = np.divmod(np.flatnonzero(close), len(j))
        for s, t, code in _exact(x, m, i[r], j[c]):
            a, b = rows[r[s:t]], members[c[s:t]]
            counted = ~beyond[r[s:t]]
            self._count(page, a[counted], b[counted], code[counted])
            self._keep(page, a, b, code)

    def _count(self, page: Page, rows: np.ndarray, members: np.ndarray, code: np.ndarray) -> None:
        """Adds the members that come before the own class of their row."""
        own = _codes(self.far)[rows]
        count = np.where(self.has[rows] & (code < own), page.copies[members], 0)
        for k in np.flatnonzero((code == own) & self.has[rows]):
            count[k] = page.earlier(members[k], self.own[rows[k]])
        np.add.at(self.nearer, rows, count)

    def _keep(self, page: Page, rows: np.ndarray, members: np.ndarray, code: np.ndarray) -> None:
        """The best two of those held and these."""
        some = code <= self.code[rows, 1]
        rows, members, code = rows[some], members[some], code[some]
        if not len(rows):
            return
        twins = page.twin[members]
        if (twins >= 0).any() and code[0] != UNKNOWN:
            some = twins >= 0
            rows, members, code = np.concatenate([rows, rows[some]]), np.concatenate([members, twins[some]]), np.concatenate([code, code[some]])
        order = np.lexsort((members, code, rows))
        rows, members, code = rows[order], members[order], code[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        at, two = rows[start], np.concatenate([rows[1:] == rows[:-1], [False]])[start]
        more = np.minimum(start + 1, len(rows) - 1)
        first, second = code[start], np.where(two, code[more], EMPTY)
        first_class, second_class = page.classes[members[start]], page.classes[members[more]]
        old, held = self.code[at], self.best[at]
        won = _before(first, first_class, old[:, 0], held[:, 0])
        rest, rest_class = np.where(won, old[:, 0], old[:, 1]), np.where(won, held[:, 0], held[:, 1])
        next_, next_class = np.where(won, second, first), np.where(won, second_class, first_class)
        also = _before(next_, next_class, rest, rest_class)
        self.code[at] = np.column_stack([np.where(won, first, old[:, 0]), np.where(also, next_, rest)])
        self.best[at, 0] = np.where(won, first_class, held[:, 0])
        self.best[at, 1] = np.where(also, next_class, rest_class)

    def found(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Identities, the best two (distance, class) and the number of nearer members."""
        there = self.code < EMPTY
        code, classes = self.code[there], self.best[there]
        distance = pa.array(np.where(code < 0, 0, code).view(np.float64), pa.float64(), mask=code < 0)
        pairs = pa.StructArray.from_arrays([distance, pa.array(list(classes), self.label)], ["distance", "class"])
        ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
        return pa.array(self.ids, self.kind), pa.ListArray.from_arrays(ends, pairs), pa.array(self.nearer, pa.int64(), mask=~self.has)


def _before(code: np.ndarray, classes: np.ndarray, other: np.ndarray, other_classes: np.ndarray) -> np.ndarray:
    before = code < other
    for k in np.flatnonzero((code == other) & (code < EMPTY)):
        before[k] = _earlier(classes[k], other_classes[k])
    return before


def _exact(x: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start, end and codes of pieces of the pairs; squares are added up in the order of the components."""
    step = max(1, PIECE // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        t = min(s + step, len(i))
        squares = (x[i[s:t]] - m[j[s:t]]) ** 2
        yield s, t, _codes(np.sqrt(np.cumsum(squares, axis=1)[:, -1] if x.shape[1] else np.zeros(t - s)))
