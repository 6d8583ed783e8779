"""Language identification with unigram piece models, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
is the sum over all ways to cut it into pieces, computed by a forward pass; pieces never span a word
boundary, so a text's probability is the product over its words and equal words are scored once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import held_out, sample_per_key, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
UNDETERMINED = "und"
CACHED = 300_000
TINY = 1e-150
LONG = 64


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs of the whole text; none if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return WORD.findall(text.lower())


def pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of a public vocabulary file without control symbols; byte pieces look like ``<0x41>``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]


class Lattice:
    """Finds the pieces that can end at each position of a word; unknown characters become bytes."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(len(p) for p in vocabulary if not p.startswith("<0x"))

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For every end position the (start, piece ids) that lead there."""
        text, ids = START + word, self.ids
        found: list[list[tuple[int, tuple[int, ...]]]] = []
        for end in range(1, len(text) + 1):
            here = []
            for start in range(max(0, end - self.longest), end):
                piece = ids.get(text[start:end])
                if piece is not None:
                    here.append((start, (piece,)))
            if text[end - 1] not in ids:
                spelled = tuple(self.bytes[b] for b in text[end - 1].encode("utf-8", "replace"))
                here.append((end - 1, tuple(0 if i is None else i for i in spelled)))
            found.append(here)
        return found


def forward(edges: list, p: np.ndarray) -> tuple[list[list[float]], list[float]]:
    """Forward sums per position, each with the log of the factor it was scaled by. ``p``: rows of floats."""
    alpha, scale = [[1.0] * len(p[0])], [0.0]
    for here in edges:
        base = scale[-1]
        total = [0.0] * len(p[0])
        for start, ids in here:
            before, shift = alpha[start], scale[start] - base
            factor = 1.0 if shift == 0.0 else np.exp(shift)
            for i in ids[:-1]:
                before = [a * q for a, q in zip(before, p[i])]
            if factor == 1.0:
                total = [t + a * q for t, a, q in zip(total, before, p[ids[-1]])]
            else:
                total = [t + a * q * factor for t, a, q in zip(total, before, p[ids[-1]])]
        high = max(total)
        if 0.0 < high < TINY:
            total, base = [t / high for t in total], base + log(high)
        alpha.append(total)
        scale.append(base)
    return alpha, scale


def log_probabilities(edges: list, p) -> list[float]:
    alpha, scale = forward(edges, p)
    return [log(a) + scale[-1] if a > 0.0 else -1e4 * len(edges) for a in alpha[-1]]


def expected_counts(edges: list, p: list[float]) -> dict[int, float]:
    """Expected uses of each piece in one word of one language, over all segmentations."""
    column = [[q] for q in p] if not isinstance(p[0], list) else p
    alpha, scale = forward(edges, column)
    total = alpha[-1][0]
    if total <= 0.0:
        return {}
    n = len(edges)
    beta = [0.0] * n + [1.0]
    counts: dict[int, float] = defaultdict(float)
    for end in range(n, 0, -1):
        if beta[end] == 0.0:
            continue
        for start, ids in edges[end - 1]:
            weight = beta[end] * np.exp(scale[start] - scale[end]) if scale[start] != scale[end] else beta[end]
            for i in ids:
                weight *= column[i][0]
            beta[start] += weight
            share = weight * alpha[start][0] / total
            for i in ids:
                counts[i] += share
    return counts


class Scorer:
    """Log-probabilities of many words in every language: the forward pass over all words of a length at once.

    The pieces that end at a position are looked up by rolling hashes of the substrings there.
    """

    base = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: list[str], p: np.ndarray) -> None:
        self.p = p
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        texts = [(i, v) for i, v in enumerate(vocabulary) if not re.fullmatch(r"<0x[0-9A-F]{2}>", v)]
        for length in sorted({len(v) for _, v in texts} - {1}):
            own = [(i, v) for i, v in texts if len(v) == length]
            hashes = self.hashes(self.codes([v for _, v in own], length))[:, -1]
            order = np.argsort(hashes)
            self.by_length[length] = hashes[order], np.array([i for i, _ in own])[order]
        self.ids, self.rows = {v: i for i, v in texts}, p.tolist()
        self.powers = {n: np.uint64(pow(int(self.base), n, 1 << 64)) for n in self.by_length}
        self.single = {ord(v): i for i, v in texts if len(v) == 1}
        self.bytes = {int(v[3:5], 16): i for i, v in enumerate(vocabulary) if re.fullmatch(r"<0x[0-9A-F]{2}>", v)}

    @staticmethod
    def codes(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of every prefix; the one of nothing first."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * self.base + codes[:, k]
        return out

    def characters(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of single characters; one outside the vocabulary is spelled in bytes."""
        found, at = np.unique(codes, return_inverse=True)
        rows = np.empty((len(found), self.p.shape[1]))
        for k, code in enumerate(found.tolist()):
            i = self.single.get(code)
            if i is not None:
                rows[k] = self.p[i]
            else:
                rows[k] = np.prod([self.p[self.bytes.get(b, 0)] for b in chr(code).encode("utf-8", "replace")], axis=0)
        return rows[at.reshape(codes.shape)]

    def same_length(self, words: list[str]) -> np.ndarray:
        codes = self.codes([START + w for w in words], len(words[0]) + 1)
        prefix, single = self.hashes(codes), self.characters(codes)
        # Only the sums that a piece can still start from are kept: a word may be as long as a text.
        alpha = deque([np.ones((len(words), self.p.shape[1]))], maxlen=max([1, *self.by_length]))
        shift = np.zeros((len(words), self.p.shape[1]))  # each language is scaled for itself
        for end in range(1, codes.shape[1] + 1):
            total = alpha[-1] * single[:, end - 1]
            for length, (table, ids) in self.by_length.items():
                if length > end:
                    break
                key = prefix[:, end] - prefix[:, end - length] * self.powers[length]
                place = np.minimum(np.searchsorted(table, key), len(table) - 1)
                hit = np.flatnonzero(table[place] == key)
                total[hit] += alpha[-length][hit] * self.p[ids[place[hit]]]
            if total.min() < TINY:
                grow = np.where(total < TINY, 1 / np.maximum(total, 1e-300), 1.0)
                shift -= np.log(grow)
                for before in alpha:
                    before *= grow
                total *= grow
            alpha.append(total)
        return np.log(np.maximum(alpha[-1], 1e-300)) + shift

    def long_word(self, word: str) -> list[float]:
        """The same pass over one word, character by character: linear in its length, in constant memory."""
        text, p = START + word, self.rows
        log_scale = [0.0] * self.p.shape[1]
        longest = max([1, *self.by_length])
        alpha: deque[list[float]] = deque([[1.0] * self.p.shape[1]], maxlen=longest)
        for end in range(1, len(text) + 1):
            code = ord(text[end - 1])
            own = self.single.get(code)
            row = p[own] if own is not None else self.characters(np.array([code], np.uint32))[0]
            total = [a * q for a, q in zip(alpha[-1], row)]
            for length in range(2, min(longest, end) + 1):
                i = self.ids.get(text[end - length : end])
                if i is not None:
                    total = [t + a * q for t, a, q in zip(total, alpha[-length], p[i])]
            if min(total) < TINY:
                high = [max(t, 1e-300) if t < TINY else 1.0 for t in total]
                log_scale = [x + log(h) for x, h in zip(log_scale, high)]
                for before in alpha:
                    before[:] = [a / h for a, h in zip(before, high)]
                total = [t / h for t, h in zip(total, high)]
            alpha.append(total)
        return [log(max(a, 1e-300)) + x for a, x in zip(alpha[-1], log_scale)]

    def __call__(self, words: list[str]) -> np.ndarray:
        """One row per word."""
        out = np.empty((len(words), self.p.shape[1]))
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self.long_word(word)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for some in np.split(order, cuts):
            if len(some) and sizes[some[0]] > LONG:
                continue
            step = max(1, 200_000 // (int(sizes[some[0]]) + 1))
            for lo in range(0, len(some), step):
                part = some[lo : lo + step]
                out[part] = self.same_length([words[i] for i in part])
        return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[str]
    log_prior: np.ndarray
    p: np.ndarray  # pieces x languages
    _state: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_state": {}}

    def rows(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        """Place of each word in a table of log-probabilities; short words are remembered."""
        state = self._state
        if not state:
            state |= {"scorer": Scorer(self.vocabulary, self.p), "seen": {}, "table": np.empty((0, len(self.languages)))}
        new = [w for w in words if w not in state["seen"]]
        if len(state["seen"]) + len(new) > CACHED:
            state |= {"seen": {}, "table": state["table"][:0]}
            new = list(words)
        if new:
            state["seen"] |= zip(new, range(len(state["table"]), len(state["table"]) + len(new)))
            state["table"] = np.concatenate([state["table"], state["scorer"](new)])
        return state["seen"], state["table"]

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """Most likely language and its posterior for each text."""
        langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        for lo in range(0, len(texts) if self.languages else 0, 512):
            counts = [Counter(words_of(t)) for t in texts[lo : lo + 512]]
            place, table = self.rows(set().union(*counts))
            for k, own in enumerate(counts, lo):
                if not own:
                    continue
                rows = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                total = self.log_prior + np.fromiter(own.values(), float, len(own)) @ table[rows]
                best = int(total.argmax())
                langs[k], scores[k] = self.languages[best], 1.0 / np.exp(total - total[best]).sum()
        return pd.DataFrame({"lang_pred": langs, "score": scores})


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_rows: int = 375,
    rounds: int = 2,
    vocabulary: str = VOCABULARY,
    smoothing: float = 0.01,
) -> Model:
    """Piece probabilities per language by expectation maximisation over all segmentations.

    Knows every language of the rows that are not held out, however rare, if a sampled text has a word. Each
    learns from at most ``fit_rows`` different rows of its own, those with the smallest hashes; priors are
    shares of all such rows. Sums per (language, piece) are made in Spark; only they come to the driver.
    Without such rows the model knows no language and calls every text undetermined.
    """
    spark = docs.sparkSession
    names = pieces(vocabulary)
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows, known = sample_per_key(rows, "lang", ["id", "text"], fit_rows)
    rows = rows.repartition("id", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counts = Counter(words_of(text))
                yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())})

    words = rows.mapInPandas(count, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    prior = np.log([known[lang] for lang in languages]) - np.log(sum(known[lang] for lang in languages) or 1)
    place = {lang: k for k, lang in enumerate(languages)}
    p = np.full((len(names), len(languages)), 1.0 / len(names))
    for _ in range(rounds if languages else 0):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, columns = Lattice(names), [[[q] for q in c] for c in now.value.T.tolist()]
            sums: dict[tuple[int, int], float] = defaultdict(float)
            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                    k = place[lang]
                    for i, c in expected_counts(lattice.edges(word), columns[k]).items():
                        sums[k, i] += n * c
            keys = np.array(list(sums), np.int32).reshape(-1, 2)
            yield pd.DataFrame({"k": keys[:, 0], "i": keys[:, 1], "c": list(sums.values())})

        found = words.repartition("word").mapInPandas(expect, "k int, i int, c double")
        found = found.groupBy("k", "i").agg(F.sum("c").alias("c")).toPandas()
        sums = np.full(p.shape, smoothing)
        sums[found["i"], found["k"]] += found["c"]
        p = sums / sums.sum(axis=0)
    return Model(languages, names, prior, p)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) for every text, scored whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield shared.value.score(batch.tolist())

    return score(F.col(text_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Null, empty and letterless texts are ``und`` with score 0. Null ids are kept (never held out);
    repeated rows each come out; ties go to the language first in name; an empty table gives an empty
    result; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), predicted(docs, model, text_col).alias("p"))
    return own.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "p.lang_pred", "p.score")
