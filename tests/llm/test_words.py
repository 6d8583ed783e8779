"""Whitening, packing and spelling variants against plain versions, and rows that are null, empty, long or repeated."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelight.llm import packing, queries, spelling, whitening

DOCS = "doc_id long, text string, length long, word string, n string, `group` string, piece string, tokens string"


def documents(spark, rows):
    """Documents with extra columns under names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0, "x", "y", "z", "p", "t") for i, t in rows], DOCS)


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, component int")


def plain_whitening(vecs, weights, k=4):
    x = np.floor(256 * np.array(vecs, float)).astype(int)
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(distinct), int)
    n, sums = int(w.sum()), w @ distinct
    centred = distinct - sums / n
    cov = (centred * w[:, None]).T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return n, sums, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(cov)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_matches_numpy(spark, weights):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(150, 10)) * np.arange(1, 11)).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(200 + i, base[3]) for i in range(60)] + [(None, base[5]), (7, base[7])]
    bad = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] * 10), (903, [float("-inf")] * 10)]
    got = whitening.whiten(vectors(spark, rows + bad), weights=weights).collect()
    n, sums, values, axes, trace = plain_whitening([v for _, v in rows], weights)
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r["vec_id"]), r["component"])):
        found[r["vec_id"]].append(r)
    signs = None
    for i, v in rows[:150]:
        x = np.floor(256 * np.array(v, float)).astype(int)
        want = ((x - sums / n) @ axes) / np.sqrt(values)
        have = np.array([r["whitened"] for r in found[i][:: len(found[i]) // 4]])
        signs = np.sign(want * have) if signs is None else signs
        assert np.allclose(have * signs, want, atol=1e-8)
        assert found[i][0]["deviation"] == int(((n * x - sums) ** 2).sum())
    assert np.allclose([r["explained"] for r in found[0]], values / trace)
    assert max(r["identity_error"] for r in got) < 1e-9 and len(found[None]) == 4 and len(found[7]) == 8


def test_whitening_of_lengths_ties_and_few_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5] * 6), (4, [1e30, -1e30, 0.0]), (5, [0.0, 0.0, 0.0]), (6, [])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2)] + [(3, c) for c in (1, 2, 3, 4)] + [(i, c) for i in (4, 5) for c in (1, 2, 3)]
    assert got[1, 1]["whitened"] == 0 and got[1, 1]["explained"] == 0 and got[1, 1]["deviation"] == 0
    assert abs(got[4, 1]["whitened"]) == pytest.approx(1) and got[4, 2]["whitened"] == 0 and got[4, 1]["deviation"] is None
    assert got[4, 1]["explained"] == pytest.approx(1) and got[4, 1]["identity_error"] < 1e-9
    empty = vectors(spark, [])
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(empty, weights="two")


def test_whitening_query_covers_the_table(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_whitening"](spark, folder).toPandas()
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    n, sums, values, axes, trace = plain_whitening([v for _, v in table], "one")
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    want = ((np.floor(256 * np.array([v for _, v in sorted(table)], float)) - sums / n) @ axes) / np.sqrt(values)
    assert np.allclose(np.abs(wide.to_numpy()), np.abs(want), atol=1e-6)
    assert got["identity_error"].max() < 1e-9 and len(got) == 4 * len(table)


# packing

TEXTS = ["", None, "one two  three\n\nfour's \té¿", "x" * 5000, " ".join(f"word{i * i % 977}," for i in range(9000)), "<|endoftext|> a", "中文 字 😀 .   b"]


def plain_first_fit(sizes, capacity):
    rooms, bins = [], []
    for i, size in enumerate(sizes):
        for b, room in enumerate(rooms):
            if room >= size:
                rooms[b] -= size
                bins[b].append(i)
                break
        else:
            rooms.append(capacity - size)
            bins.append([i])
    return bins


def test_tournament_finds_the_first_fit():
    random.seed(5)
    for n in (1, 2, 3, 50, 400):
        sizes = sorted((random.randint(1, 100) for _ in range(n)), reverse=True)
        assert packing.first_fit(sizes, 100) == plain_first_fit(sizes, 100)
        unsorted = [random.randint(1, 100) for _ in range(n)]
        assert packing.first_fit(unsorted, 100) == plain_first_fit(unsorted, 100)
        parts = [[(i, 0, sizes[i]) for i in b] for b in packing.first_fit(sizes, 100)]
        filled = packing.fill_gaps(parts, 100)
        seen = Counter((p, t) for b in filled for p, start, size in b for t in range(start, start + size))
        assert seen == Counter((p, t) for p, size in enumerate(sizes) for t in range(size))
        used = [sum(size for *_, size in b) for b in filled]
        assert all(u == 100 or u & (u - 1) == 0 for u in used) and len(used) <= sum(sizes) // 100 + 7


def sequences(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append(r)
    return {s: sorted(of, key=lambda r: r["offset"]) for s, of in found.items()}


@pytest.mark.parametrize("fill", [True, False])
def test_packing_is_whole_and_gapless(spark, fill):
    random.seed(6)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(random.choices(["ab", "c", "Dé", "7"], k=random.randrange(900)))) for i in range(120)]
    rows += [(None, "a b"), (2, TEXTS[2]), (2, "else")]
    got = packing.pack(documents(spark, rows), length=256, group_tokens=9000, fill=fill).collect()
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((i, tuple(encoder.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    streams = defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        if r["doc_id"] not in (2, None):
            for k, token in enumerate(ids, r["start"]):
                assert k not in streams[r["doc_id"]]
                streams[r["doc_id"]][k] = token
    assert {(i, tuple(t for _, t in sorted(of.items()))) for i, of in streams.items()} == {k for k in want if k[0] not in (2, None)}
    assert sum(r["length"] for r in got) == sum(len(ids) * c for (_, ids), c in want.items())
    found = sequences(got)
    for of in found.values():
        assert [r["offset"] for r in of] == [sum(p["length"] for p in of[:k]) for k in range(len(of))]
        used = sum(r["length"] for r in of)
        assert used <= 256 and (not fill or used == 256 or used & (used - 1) == 0)
    assert len({s >> 32 for s in found}) > 1
    row = packing.padding(spark.createDataFrame([(r["sequence_id"], r["length"]) for r in got], "sequence_id long, length long"), 256).first()
    assert row["sequences"] == len(found) and (row["padding"] == 0) == fill and row["padding"] < 0.1 * row["tokens"]


def test_packing_of_nothing_and_of_windows(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    known = packing.words(packing.default_tokenizer())
    for text in TEXTS:
        whole = known.tokenizer.encode(text or "", add_special_tokens=False).ids
        parts = b"".join(known.ids([w])[0] for w in packing.windows(text or "", 20))
        assert np.frombuffer(parts, "<u4").tolist() == whole
    assert list(packing.bunches(np.array([5, 3, 20, 1, 1]), 8)) == [(0, 2), (2, 3), (3, 5)] and not list(packing.bunches(np.array([]), 8))
    few = packing.Words(packing.default_tokenizer(), most=3)  # forgets all the time
    for text in TEXTS:
        assert np.frombuffer(few.ids([text or "", "a b c"])[0], "<u4").tolist() == known.tokenizer.encode(text or "", add_special_tokens=False).ids


class Asked:
    """Passes texts on to a tokenizer and notes them."""

    def __init__(self, tokenizer, texts):
        self.tokenizer, self.texts = tokenizer, texts

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_reach_the_library_together_and_once():
    known, asked = packing.Words(packing.default_tokenizer()), []
    encoder, known.model = known.tokenizer, Asked(known.model, asked)
    different = ["".join(random.Random(i).choices("abéstñ", k=9)) + "., "[i % 3].strip() for i in range(3000)]
    texts = pa.array([" ".join(different[i : i + 1000]) for i in range(0, 3000, 500)] + ["", "\n".join(different)])
    want = [encoder.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in known.ids(texts)] == want
    assert 0 < len(asked) <= 2 * 3000 / packing.JOINED + 1
    asked.clear()
    assert [np.frombuffer(ids, "<u4").tolist() for ids in known.ids(texts.slice(1))] == want[1:] and not asked


def test_ids_of_odd_texts_are_the_librarys():
    bits = [" ", "  ", "\n", "\n\n", " \n", "\n ", "   ", "\t", "\r\n", "\xa0", "\u3000", "\u2028", "\0", "\x85", "\u200b", "<|endoftext|>"]
    bits += ["'s", "I'm", "a", "Über", "the", "of,", "(a)", "123", "ß", "×", "ª", "中文", "😀", "e\u0301", "™:", "®,", "…\"", "x" * 70, "~", "\x01"]
    rng, alone = random.Random(9), packing.Words(packing.default_tokenizer())
    alone.plain = False  # as for a vocabulary with tokens that reach over words
    for most in (3, 50, 1_000_000):
        known = packing.Words(packing.default_tokenizer(), most=most)
        for few in (2, 5, 12, len(bits)) * 3:
            some = rng.sample(bits, few)
            texts = ["".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(40)]
            want = [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            for words in (known, alone):
                assert [np.frombuffer(ids, "<u4").tolist() for ids in words.ids(texts)] == want


def test_tokens_over_the_border_of_two_words():
    assert not packing.joins(["Ġthe", "the", "),", "ĊĊ", "Ġ(", "Ã©", "â€¦.", "the'", "12"])
    assert all(packing.joins([token]) for token in ("theĠof", ",Ġ", "Ċthe", "the,", "Ã©.", ".Ċ"))


def test_words_of_one_call_are_forgotten_first():
    known = packing.Words(packing.default_tokenizer(), most=6)
    for text in ("go on and on", "go and see it through", "go to that place"):
        assert np.frombuffer(known.ids([text])[0], "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(known.known) == {"go", " and"}
    known.ids(["go " + " ".join(map(str, range(100)))])
    assert set(known.known) == {"go"}


def test_packing_query_checksums(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_packing"](spark, folder).collect()
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {r["doc_id"]: encoder.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in got:
        part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(tokens[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, tokens.values()))


# spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, noise, letters=7, least=2, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        good = near and -near[0][0] >= ratio * n
        out[w] = [near[0][1] if good else None, n, len(near), -near[0][0] if good else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return out


@pytest.mark.parametrize("limit", [10**6, 20, 2])
def test_variants_match_brute_force(spark, limit):
    random.seed(7)
    stems = ["".join(random.choices("abcé", k=random.randint(7, 10))) for _ in range(40)] + ["aaaaaaa", "bbbbbbbb", "ÀÉÎÕÜ×ÿ", "q" * 3000]
    pool = []
    for s in stems:
        pool += [s] * random.choice([2, 30, 400])
        for _ in range(6):
            p, c = random.randrange(len(s)), random.choice("abcéZ")
            pool += [random.choice([s[:p] + s[p + 1 :], s[:p] + c + s[p:], s[:p] + c + s[p + 1 :], s + c])] * random.choice([1, 2, 3, 25])
    random.shuffle(pool)
    rows = [(i, " ".join(pool[i::50])) for i in range(50)] + [(None, pool[0] + "1" + pool[1]), (60, None), (61, ""), (3, "aaaaaaa! short"), (3, "aaaaaaa! short")]
    for noise in (None, 5):
        got = spelling.variants(documents(spark, rows), noise=noise, limit=limit).collect()
        assert {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in got} == plain_variants(rows, noise)


def test_chains_of_forms_and_hot_beginnings(spark):
    chain = [("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 200), ("abcdefghijk", 2000)]
    same = [(f"beginning{a}{b}", 2 + (a + b == "aa") * 50) for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(1, " ".join(w for w, n in chain + same for _ in range(n)))]
    got = spelling.variants(documents(spark, rows), limit=8).collect()
    assert {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in got} == plain_variants(rows, None)
    assert {r["root"] for r in got if r["word"].startswith("abc")} == {"abcdefghijk"}
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (None, "seldom words here")])).count() == 0
