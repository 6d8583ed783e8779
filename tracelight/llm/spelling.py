"""Spelling variants: words at one edit from a far more frequent word.

The vocabulary is cut into parts of bounded size. A part holds bitsets over its words: for every position
and letter, the words with that letter there. A word is looked up by running over its letters once and keeping
four sets of words at a time: those that agree so far, and those that differ by one replaced, one additional or one
missing letter so far; the latter two read the bitsets one position further on or back. Bits stand for words
in falling order of frequency, so the lowest bit of the result is the form and the number of bits the number of near words.

A part that is too large is divided at the middle of the word: words one edit apart agree before it or behind it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import ascii_lower, stored

RUN = "[A-Za-zÀ-ÿ]"
LETTERS = 7
LIMIT = 16384


def vocabulary(docs: DataFrame, id_col: str, text_col: str, letters: int, least: int, noise: int | None) -> DataFrame:
    """(word, n) of the words with at least ``letters`` letters and ``least`` occurrences.

    With ``noise``, one run in so many, chosen by the checksum of ``id:run``, loses a letter first.
    """
    longest = f"{RUN}{{{letters},}}"  # runs that are too short can only get shorter
    runs = F.regexp_extract_all(F.col(text_col), F.lit(longest), F.lit(0))
    each = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    word = ascii_lower(F.col("run"))
    if noise:
        each = each.select(word.alias("run"), F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), word)).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    words = each.select(word.alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class Part:
    """Bitsets over words of ``short`` or ``short + 1`` letters that agree outside [low, high) of the shorter ones.

    Bit i is word i. Only pairs that differ before ``high`` are found, if ``high`` lies inside the words: the others
    agree up to there, and belong to the part of the words with that beginning.
    """

    def __init__(self, words: Sequence[str], short: int, low: int, high: int):
        self.low, self.high, self.short = low, high, short
        self.inside = high < short
        self.all = (1 << len(words)) - 1
        self.long = sum_bits(i for i, w in enumerate(words) if len(w) > short)
        members: dict[tuple[int, str], list[int]] = {}
        for i, w in enumerate(words):
            for p in range(low, min(high + 1, len(w))):
                members.setdefault((p, w[p]), []).append(i)
        self.at = {spot: sum_bits(of) for spot, of in members.items()}

    def near(self, word: str) -> int:
        """Words exactly one edit from ``word``, a member."""
        at, low, high = self.at, self.low, self.high
        same, replaced, added, missing = self.all, 0, 0, 0
        if len(word) > self.short:  # look for words without one of its letters
            for p in range(low, high + 1):
                missing = (missing & at.get((p - 1, word[p]), 0) if p > low else 0) | same
                same &= at.get((p, word[p]), 0)
                if not (same | missing):
                    break
            if self.inside:
                missing &= ~self.agree(word)
            return missing & ~self.long
        for p in range(low, high):
            here = at.get((p, word[p]), 0)
            replaced = (replaced & here) | (same & ~here)
            added = (added | same) & at.get((p + 1, word[p]), 0)
            same &= here
            if not (same | replaced | added):
                break
        if not self.inside:
            added |= same
        return (replaced & ~self.long) | (added & self.long & (~same if self.inside else -1))

    def agree(self, word: str) -> int:
        """Words with the letters of ``word`` before ``high``."""
        same = self.all
        for p in range(self.low, self.high):
            same &= self.at.get((p, word[p]), 0)
            if not same:
                break
        return same


def sum_bits(positions) -> int:
    """The number with these bits set."""
    positions = list(positions)
    if not positions:
        return 0
    bits = bytearray(max(positions) // 8 + 1)
    for p in positions:
        bits[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(bits, "little")


def search(rows: Iterator[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the most frequent, that word) from rows sorted by part, falling n and word."""
    for (short, low, high, _), members in groupby(rows, key=lambda r: r[:4]):
        found = [(word, n) for *_, word, n in members]
        if len(found) > 1:
            part = Part([word for word, _ in found], short, low, high)
            for word, _ in found:
                near = part.near(word)
                if near:
                    best, best_n = found[(near & -near).bit_length() - 1]
                    yield word, near.bit_count(), best_n, best


def parts(words: DataFrame) -> DataFrame:
    """Every word in two parts: with those as long or longer by one letter, and with those shorter by one."""
    short = F.explode(F.array(F.length("word"), F.length("word") - 1))
    return words.select("word", "n", short.alias("short"), F.lit(0).alias("low")).select(
        "short", "low", F.col("short").alias("high"), F.lit("").alias("fixed"), "word", "n"
    )


def halved(rows: DataFrame) -> DataFrame:
    """Each part as two kinds of smaller parts: equal letters before, or behind, the middle of the open range."""
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    ends = F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
    each = rows.select("short", F.explode(ends).alias("e"), "word", "n").select("short", "e.low", "e.high", "word", "n")
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    behind = F.right("word", F.col("short") - F.col("high"))
    return each.withColumn("fixed", F.concat(before, behind)).select("short", "low", "high", "fixed", "word", "n")


KEY = ("short", "low", "high", "fixed")


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best) of every stored word with near words; ``best`` = (-n, word) of the first of them.

    Parts of more than ``limit`` words are halved until none is left, or until one letter is open. A pair of near
    words meets in exactly one part, and no pair is ever a row: a part adds one row per word.
    """
    ready, rows = None, parts(words)
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        sizes = stored(sizes, "spelling-parts")
        large = (F.col("members") > limit) & (F.col("high") - F.col("low") > 1)
        small = rows.join(sizes.where(~large).select(*KEY), list(KEY))
        ready = small if ready is None else ready.unionByName(small)
        if sizes.where(large).isEmpty():
            break
        rows = stored(halved(rows.join(sizes.where(large).select(*KEY), list(KEY))), "spelling-halves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["word", "near", "best_n", "best"])

        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for row in search(flat):
            found.append(row)
            if len(found) >= 10000:
                yield out()
                found = []
        if found:
            yield out()

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.repartition(tasks, *KEY).sortWithinPartitions(*KEY, F.desc("n"), "word")
    hits = dealt.select(*KEY, "word", "n").mapInArrow(run, "word string, near long, best_n long, best string")
    order = F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))
    return hits.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(order).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last word that forms lead to.

    Forms are ever more frequent words, so no chain is a circle; each round doubles the steps followed.
    """
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if steps.where("next IS NOT NULL").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    letters: int = LETTERS,
    least: int = 2,
    ratio: int = 10,
    noise: int | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """Every word of at least ``letters`` letters and ``least`` occurrences: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters up to U+00FF with A-Z in lower case. ``form`` is the most frequent word at
    one inserted, deleted or replaced letter (ties: the smallest in code-point order) if it occurs at least ``ratio``
    times as often, else null; ``root`` is the last word that forms lead to. A null text has no words; a null id
    counts as an empty one in the checksum; repeated rows count each time. Words of any length take part. An empty table has no words.
    """
    words = stored(vocabulary(docs, id_col, text_col, letters, least, noise), "spelling-words")
    near = near_words(words, limit).select(
        "word", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.word").alias("best")
    )
    known = words.join(near, "word", "left")
    good = F.col("best_n") >= F.col("n") * ratio
    known = stored(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(known.where("form IS NOT NULL"))
    told = known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return told.select("word", "form", "root", "n", "n_near", "form_n")
