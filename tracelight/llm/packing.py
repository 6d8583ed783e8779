"""Packing documents into sequences of a fixed number of tokens, by first-fit decreasing.

A document's tokens are cut into whole sequences and one rest. The pieces are dealt at random into groups of
bounded size; every group is packed alone, in one pass over its pieces from the longest to the shortest. A
tournament tree over the bins (each inner node holds the largest room below it) finds the first bin with
enough room in a number of steps that grows with the logarithm of the bins. Then the gaps of the fuller bins
are filled from the emptiest ones, and the last bin of the group is cut into powers of two.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import stored

SEQUENCE = 2048
END_ID = 1
BATCH_BYTES = 4 << 20
#: A space or line end after a visible character always begins a new word of a byte-level vocabulary.
CUT = re.compile(r"(?<=[\w!-~])(?=[ \n])")
#: The same for Arrow, which has no assertions.
CUT_BETWEEN = r"([!-~\pL\pN])([ \n])"
#: In other texts every space and line end begins a new word: they are the only white space, and no more than two
#: of them stand together (of three, or two at the end, several are one word).
UNEVEN = r"[ \n]{3}|[ \n]{2}\z|[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=?@\[-`{}~"
#: Behind a space or line end letters, and ASCII signs behind them (no apostrophe, nor signs of control strings).
PLAIN = rf"\A[ \n][{LETTERS}]+[{SIGNS}]*\z"
#: Plain stretches that go to the model in a row.
JOINED = 100
WINDOW = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for every byte: itself, or the next free one if it is not visible."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


def joins(vocabulary: list[str]) -> bool:
    """Whether a token could reach over the border of two words where plain stretches stand in a row."""
    letters = byte_letters()
    signs = {letters[b] for b in range(128) if re.fullmatch(f"[{SIGNS}]", chr(b))}
    of_words = {letters[b] for c in map(chr, range(256)) if re.fullmatch(f"[{LETTERS}]", c) for b in c.encode()}
    space, line = letters[32], letters[10]
    every = {space, line} | signs | of_words
    over = lambda x, y: y in (space, line) and x not in (space, line) or y in of_words and x == line or y in signs and x in of_words
    return any(every.issuperset(token) and any(map(over, token, token[1:])) for token in vocabulary)


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class Words:
    """Ids of texts, as little-endian 32-bit numbers. Texts are cut into short stretches, which are remembered.

    A stretch begins with the space or line end before its word. Arrow cuts the texts of a call and numbers their
    different stretches, so that Python meets each of them once a call.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.model = Tokenizer(self.tokenizer.model)  # takes a byte-level text as one word
        self.uneven = "|".join([UNEVEN, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u2")
        self.opens = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.opens[[n for token, n in vocabulary.items() if token[:1] in (letters[32], letters[10])]] = True
        self.plain = not joins(list(vocabulary))
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes, self.calls = (np.zeros(0, kind) for kind in ("<u4", np.int64, np.int64, np.int64))

    def stretches(self, texts: pa.Array) -> pa.Array:
        """A list of stretches for every text, which must not hold the character 0."""
        uneven = pc.match_substring_regex(texts, self.uneven)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        if pc.any(uneven).as_py():
            marked = pc.replace_with_mask(marked, uneven, pc.replace_substring_regex(texts.filter(uneven), CUT_BETWEEN, "\\1\0\\2"))
        return pc.split_pattern(marked, "\0")

    def learn(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new stretches, and where those of each begin and how many they are.

        Plain ones go to the library's model in a row, as nothing is joined over their borders; each begins with
        an id that opens a word. Others need the library's pre-tokenizer, too.
        """
        plain = pc.match_substring_regex(stretches, PLAIN).to_numpy(False) & self.plain
        starts, sizes, ids = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64), np.zeros(0, "<u4")
        if plain.any():
            some = stretches.filter(pa.array(plain))
            ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
            data = np.frombuffer(some.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            letters = self.letters[data].tobytes().decode("utf-16-le")
            cuts = [*(ends[:-1:JOINED] - ends[0]).tolist(), len(letters)]
            found = self.model.encode_batch_fast([letters[x:y] for x, y in zip(cuts, cuts[1:])], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
            starts[plain] = np.flatnonzero(self.opens[ids])
            sizes[plain] = np.diff(starts[plain], append=len(ids))
        found = self.tokenizer.encode_batch_fast(stretches.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        others = [e.ids for e in found]
        sizes[~plain] = [len(x) for x in others]
        starts[~plain] = len(ids) + np.cumsum(sizes[~plain]) - sizes[~plain]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(others), "<u4")]), starts, sizes

    def found(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where those of each of the different stretches begin and how many they are."""
        keys = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(stretches)], pa.int32()), stretches), "\0")[0].as_py().split("\0")
        numbers = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        short = pc.less_equal(pc.utf8_length(stretches), self.longest).to_numpy(False)
        new = np.flatnonzero((numbers < 0) & short)
        if len(new):
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            ids, starts, sizes = self.learn(stretches.take(pa.array(new)))
            self.known.update(zip([keys[i] for i in new.tolist()], numbers[new].tolist()))
            self.starts, self.sizes = np.concatenate([self.starts, starts + len(self.pool)]), np.concatenate([self.sizes, sizes])
            self.pool, self.calls = np.concatenate([self.pool, ids]), np.concatenate([self.calls, np.zeros(len(new), np.int64)])
        self.calls[numbers[short]] += 1
        pool, starts, sizes = self.pool, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[short], sizes[short] = self.starts[numbers[short]], self.sizes[numbers[short]]
        if not short.all():
            ids, starts[~short], sizes[~short] = self.learn(stretches.filter(pa.array(~short)))
            starts[~short] += len(pool)
            pool = np.concatenate([pool, ids])
        return pool, starts, sizes

    def forget(self) -> None:
        """Keeps the stretches of more than one call, if they fill half the room at most."""
        kept = np.flatnonzero(self.calls > 1)
        kept = kept if len(kept) <= self.most // 2 else kept[:0]
        keys = list(self.known)
        self.known = {keys[n]: i for i, n in enumerate(kept.tolist())}
        self.pool, self.sizes = gathered(self.pool, self.starts[kept], self.sizes[kept]), self.sizes[kept]
        self.starts, self.calls = np.cumsum(self.sizes) - self.sizes, np.ones(len(kept), np.int64)

    def ids(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of every text."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        marked = pc.match_substring(texts, "\0")
        lists = self.stretches(pc.if_else(marked, "", texts))
        numbered = lists.flatten().dictionary_encode()
        pool, starts, sizes = self.found(numbered.dictionary)
        numbers = numbered.indices.to_numpy()
        sizes = sizes[numbers]
        ids = gathered(pool, starts[numbers], sizes)
        at = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))].tolist()
        found = [ids[x:y].tobytes() for x, y in zip(at, at[1:])]
        for i in np.flatnonzero(marked.to_numpy(False)).tolist():  # the sign that marks the cuts is in the text
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > self.most:
            self.forget()
        return found


def windows(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` letters, cut where a new word begins."""
    at = 0
    while at < len(text):
        stop = CUT.search(text, at + size)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Words(path)


def bunches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [first, stop) of texts that have ``most`` letters together, or one longer text."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes):
        yield first, len(sizes)


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``length`` tokens: (doc_id, start, ids, doc_tokens), stored with a ``piece`` number.

    Stored, because tokenising is the dear step: later losses are read again, and piece numbers stay as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(tokenizer)
        for batch in batches:
            texts, taken, starts, parts, totals, size = batch.column(1), [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(taken, pa.int64())), pa.array(starts, pa.int64())]
                columns += [pa.array(parts, pa.binary()), pa.array(totals, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids", "doc_tokens"])

            for first, stop in bunches(pc.utf8_length(texts).to_numpy(), WINDOW):
                if stop - first > 1:
                    found = known.ids(texts.slice(first, stop - first))
                else:
                    found = [b"".join(known.ids([part])[0] for part in windows(texts[first].as_py(), WINDOW))]
                for i, ids in enumerate(found, first):
                    ids = memoryview(ids + end)
                    for at in range(0, len(ids), 4 * length):
                        taken.append(i)
                        starts.append(at // 4)
                        parts.append(ids[at : at + 4 * length].tobytes())
                        totals.append(len(ids) // 4)
                        size += len(parts[-1])
                        if size >= BATCH_BYTES:
                            yield out()
                            taken, starts, parts, totals, size = [], [], [], [], 0
            if taken:
                yield out()

    pieces = rows.mapInArrow(run, f"doc_id {kind}, start long, ids binary, doc_tokens long")
    return stored(pieces.withColumn("piece", F.monotonically_increasing_id()), "packing-pieces", "zstd")


class Tournament:
    """Rooms of bins in a row; every inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """Leftmost bin with room for ``need``; there must be one."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.room[at] < need:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, amount: int) -> None:
        at = bin_ + self.leaves
        self.room[at] -= amount
        while at > 1:
            at //= 2
            now = max(self.room[2 * at], self.room[2 * at + 1])
            if self.room[at] == now:
                return
            self.room[at] = now


def first_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins, in order of opening, of positions in ``sizes``; each goes to the first bin with room for it."""
    tree, bins = Tournament(len(sizes), capacity), []
    for i, size in enumerate(sizes):
        found = tree.first(size)
        tree.take(found, size)
        if found == len(bins):
            bins.append([])
        bins[found].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, first token, tokens) without gaps, but for sequences as long as a power of two.

    The emptiest bin is taken apart, and its pieces are cut, to fill the fullest bins with a gap; what is left of
    the last one becomes sequences whose lengths are the powers of two that add up to it.
    """
    filled = [[sum(part[2] for part in parts), parts] for parts in bins]
    filled.sort(key=lambda b: -b[0])
    done, last = [], len(filled) - 1
    for at, (used, parts) in enumerate(filled):
        if at > last:
            break
        while used < capacity and last > at:
            rest = filled[last][1]
            piece, start, size = rest.pop()
            moved = min(size, capacity - used)
            parts.append((piece, start + size - moved, moved))
            used += moved
            if moved < size:
                rest.append((piece, start, size - moved))
            filled[last][0] -= moved
            last -= not rest
        if used == capacity:
            done.append(parts)
        else:  # the only bin left with a gap
            done += powers_of_two(parts, used)
    return done


def powers_of_two(parts: list[tuple[int, int, int]], used: int) -> list[list[tuple[int, int, int]]]:
    """The parts in order, cut into runs as long as the powers of two in ``used``, the longest first."""
    runs, parts = [], parts[::-1]
    for want in (1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1):
        run = []
        while want:
            piece, start, size = parts.pop()
            took = min(size, want)
            run.append((piece, start, took))
            want -= took
            if took < size:
                parts.append((piece, start + took, size - took))
        runs.append(run)
    return runs


def packed_group(rows: pa.Table, length: int, fill: bool) -> pa.Table:
    """One group, packed; ``sequence_id`` is the group's number and the sequence's place in it."""
    rows = rows.sort_by([("tokens", "descending"), ("piece", "ascending")])
    sizes = rows.column("tokens").to_pylist()
    bins = [[(i, 0, sizes[i]) for i in members] for members in first_fit(sizes, length)]
    bins = fill_gaps(bins, length) if fill else bins
    flat = [(s, *part) for s, parts in enumerate(bins) for part in parts]
    number, taken, cut, size = np.array(flat, np.int64).reshape(-1, 4).T
    ends = np.cumsum(size)
    opens = np.concatenate(([True], number[1:] != number[:-1]))
    before = (ends - size)[opens][np.cumsum(opens) - 1]
    ids = rows.column("ids").combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    own = [ids[int(i)].as_buffer() for i in taken]
    take = pa.array(taken)
    start = rows.column("start").take(take).to_numpy() + cut
    group = rows.column("group")[0].as_py()
    return pa.table(
        {
            "doc_id": rows.column("doc_id").take(take),
            "start": start,
            "length": size,
            "ids": pa.array([b[4 * c : 4 * (c + n)].to_pybytes() for b, c, n in zip(own, cut.tolist(), size.tolist())], pa.binary()),
            "doc_tokens": rows.column("doc_tokens").take(take),
            "sequence_id": group * (1 << 32) + number,
            "offset": ends - size - before,
        }
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str | None = None,
    length: int = SEQUENCE,
    end_id: int = END_ID,
    group_tokens: int = 2_000_000,
    seed: int = 12,
    fill: bool = True,
) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (little-endian, 32 bits), doc_tokens, sequence_id, offset.

    A document is its tokens and ``end_id``. Its piece [start, start + length) stands at ``offset`` of its
    sequence; the pieces of a sequence leave no gap and hold ``length`` tokens at most. With ``fill``, pieces are cut
    further so that every sequence is full or as long as a power of two, at most one of each power per group.

    A null text counts as an empty one, whose document is ``end_id`` alone. Rows with null or repeated ids are
    documents of their own. Texts of any length are read whole; a group holds pieces, not documents, so the longest
    document is spread like all others. The same files give the same sequences. An empty table has no pieces. Other columns are not read.
    """
    pieces = tokenised(docs, id_col, text_col, tokenizer or default_tokenizer(), length, end_id)
    pieces = pieces.withColumn("tokens", (F.octet_length("ids") / 4).cast("long"))
    total = pieces.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(lambda rows: packed_group(rows, length, fill), schema)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def padding(packed: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """One row: sequences, tokens and padding; sequences as long as a power of two need none."""
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    whole = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return sizes.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(whole, 0).otherwise(length - F.col("used"))), F.lit(0)).alias("padding"),
    )
