"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every active feature i has a weight and a short factor vector; all pairs interact through the dot
products of their factors. The sum over pairs is scored in linear time: half of the squared sum of
the factors minus the sum of their squares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import bounded_sample, held_out

WORD_BITS = 14
STATISTICS = (
    "length", "word_length", "upper", "digits", "symbols", "bars", "stops", "lines", "line_length",
    "same_line", "distinct", "top_word", "repeats", "symbol_words", "upper_words", "excess_chars",
)


DIGITS, UPPER = np.arange(0x30, 0x3A), np.arange(0x41, 0x5B)
SYMBOLS = np.array([c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:?!\"'()-"])
CACHED = 200_000
_words: dict[str, int] = {}


def word_code(word: str) -> int:
    """Bucket of a word, case folded, with two flags: odd last character, all capitals."""
    code = _words.get(word)
    if code is None:
        bucket = zlib.crc32(word.lower().encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)
        odd = not word[-1].isalnum() and word[-1] not in ".,;:?!\"')"
        code = bucket << 2 | odd << 1 | (len(word) > 1 and word.isupper())
        if len(_words) >= CACHED:
            _words.clear()
        _words[word] = code
    return code


def describe(text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Of a whole text: buckets of its distinct words, their damped counts at unit length, and its
    structure statistics in the order of STATISTICS; the last of these is metadata."""
    words = text.split()
    counts = Counter(words)
    codes = np.fromiter(map(word_code, counts), np.int64, len(counts))
    times = np.fromiter(counts.values(), float, len(counts))
    values = np.log1p(times)
    values /= max(1e-9, float(np.sqrt((values**2).sum())))
    raw = text.encode("utf-8", "replace")
    used = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = text.split("\n")
    n, m = max(1, len(text)), max(1, len(words))
    known = float(n_chars) if n_chars is not None and n_chars == n_chars else float(len(text))
    return codes >> 2, values, [
        float(np.log1p(len(text))), len(text) / m, used[UPPER].sum() / n, used[DIGITS].sum() / n,
        used[SYMBOLS].sum() / n, used[0x7C] / m, (used[0x2E] + used[0x2C]) / m, len(lines) / m, n / len(lines),
        1 - len(set(lines)) / len(lines), len(counts) / m, times.max(initial=0) / m,
        sum(map(eq, words, words[1:])) / m, times[codes & 2 > 0].sum() / m, times[codes & 1 > 0].sum() / m,
        abs(known - len(text)) / n,
    ]


@dataclass
class Features:
    """Sparse rows: row r owns the entries from ``ends[r-1]`` up to ``ends[r]``."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    def rows(self, lo: int, hi: int) -> Features:
        a, b = (self.ends[lo - 1] if lo else 0), self.ends[hi - 1]
        return Features(self.index[a:b], self.value[a:b], self.ends[lo:hi] - a)

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """Sum of ``entries`` per row; every row has at least its statistics."""
        return np.add.reduceat(entries, np.concatenate(([0], self.ends[:-1])))


@dataclass
class Model:
    cuts: np.ndarray  # statistics x inner bin bounds
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def raw(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        scaled = self.factors[x.index] * x.value[:, None]
        total = x.sums(scaled)
        pairs = 0.5 * ((total**2).sum(axis=1) - x.sums((scaled**2).sum(axis=1)))
        return self.bias + x.sums(self.weight[x.index] * x.value) + pairs, total

    def features(self, described: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> Features:
        stats = np.array([d[2] for d in described])
        bins, width = self.cuts.shape[1] + 1, len(STATISTICS)
        place = np.stack([np.searchsorted(c, s, side="right") for c, s in zip(self.cuts, stats.T)], axis=1)
        place += (1 << WORD_BITS) + np.arange(width) * bins
        index = np.concatenate([x for d, own in zip(described, place) for x in (d[0], own)])
        value = np.concatenate([x for d in described for x in (d[1], np.full(width, 0.5))])
        ends = np.cumsum([len(d[0]) + width for d in described])
        return Features(index, value.astype(np.float32), ends)

    def score(self, texts: list[str | None], n_chars: list[float | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo in range(0, len(texts), 256):
            some = zip(texts[lo : lo + 256], n_chars[lo : lo + 256])
            x = self.features([describe(t or "", n) for t, n in some])
            out[lo : lo + 256] = 1 / (1 + np.exp(-np.clip(self.raw(x)[0], -30, 30)))
        return out


def train(
    texts: list[str | None],
    n_chars: list[float | None],
    labels: np.ndarray,
    factors: int = 4,
    bins: int = 12,
    epochs: int = 12,
    rate: float = 0.08,
    decay: float = 2e-4,
) -> Model:
    """Adaptive-gradient descent on the log loss over sparse rows; repeats exactly."""
    described = [describe(t or "", n) for t, n in zip(texts, n_chars)]
    stats = np.array([d[2] for d in described])
    levels = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = np.quantile(stats, levels, axis=0).T if len(stats) else np.zeros((len(STATISTICS), bins - 1))
    size = (1 << WORD_BITS) + len(STATISTICS) * bins
    random = np.random.default_rng(7)
    start = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0.0
    model = Model(cuts, float(start), np.zeros(size, np.float32), random.normal(0, 0.05, (size, factors)).astype(np.float32))
    if not len(texts):
        return model
    x = model.features(described)
    y = np.asarray(labels, float)
    sq_w, sq_v, sq_b = np.full(size, 1e-4, np.float32), np.full((size, factors), 1e-4, np.float32), 1e-4
    lengths = np.diff(np.concatenate(([0], x.ends)))
    starts = x.ends - lengths
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            take = np.concatenate([np.arange(starts[r], x.ends[r]) for r in pick])
            b = Features(x.index[take], x.value[take], np.cumsum(lengths[pick]))
            raw, total = model.raw(b)
            error = (1 / (1 + np.exp(-raw)) - y[pick]) / len(pick)
            each = np.repeat(error, lengths[pick])[:, None].astype(np.float32)
            value = b.value[:, None]
            used, at = np.unique(b.index, return_inverse=True)
            spread = value * np.repeat(total, lengths[pick], axis=0) - model.factors[b.index] * value**2
            g_v = np.zeros((len(used), factors), np.float32)
            np.add.at(g_v, at, each * spread)
            g_w = np.bincount(at, (each * value)[:, 0], len(used)).astype(np.float32)
            g_w += decay * model.weight[used]
            g_v += decay * model.factors[used]
            sq_w[used] += g_w**2
            sq_v[used] += g_v**2
            model.weight[used] -= rate * g_w / np.sqrt(sq_w[used])
            model.factors[used] -= rate * g_v / np.sqrt(sq_v[used])
            g_b = error.sum()
            sq_b += g_b**2
            model.bias -= rate * g_b / np.sqrt(sq_b)
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    label_col: str = "quality",
    fit_rows: int = 2500,
    **options,
) -> Model:
    """Learns from at most ``fit_rows`` labelled rows that are not held out (smallest hashes of the id).

    A document labelled twice is learned from twice. Without labels every score is one half.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = bounded_sample(known, "id", fit_rows)  # so it may be broadcast
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(chars_col).alias("n_chars"))
    rows = own.join(F.broadcast(known), "id").orderBy("id", "label", F.xxhash64("text")).limit(fit_rows).toPandas()
    y = (rows["label"].to_numpy() == 1).astype(float)
    return train(rows["text"].tolist(), rows["n_chars"].tolist(), y, **options)


def scored(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str = "n_chars") -> Column:
    """Quality of every whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, n_chars in batches:
            yield pd.Series(shared.value.score(texts.tolist(), n_chars.tolist()))

    return score(F.col(text_col), F.col(chars_col).cast("double"))


def classify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    threshold: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (1 from ``threshold`` on).

    A null text is an empty one; empty texts are scored by their statistics. Null ids are kept, repeated
    rows each come out, an empty table gives an empty result, other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), scored(docs, model, text_col, chars_col).alias("score"))
    return own.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
