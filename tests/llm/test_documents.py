"""Operators over documents: brute force on small tables, and rows that are null, empty, long or repeated."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelight.llm import common, decontaminate, language, licences, mixing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, id long"


def signed(code):
    return int(np.uint64(code).view(np.int64))


def table(spark, rows):
    """Documents with extra columns under names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 0) for i, t in rows], SCHEMA)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(codes, limit=4):
    codes = np.array(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit
    label = np.arange(len(codes))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
LONG = " ".join(WORDS[i * i % 14] + str(i % 97) for i in range(30000))
ROWS = [
    (1, " ".join(WORDS)), (2, " ".join(WORDS).upper()), (2, " ".join(WORDS).upper()), (3, None), (4, ""), (5, " \t\n"),
    (6, LONG), (7, LONG + " end"), (None, " ".join(WORDS)), (None, "a text of its own"), (9, "É ähnlich"), (10, "é ähnlich"),
]


def test_simhash_matches_brute_force(spark):
    got = simhash.near_duplicates(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    prints = [brute_fingerprint(t) for _, t in ROWS]
    label = reach(prints)
    want = sorted(
        (str(i), signed(p), str(min((j for (j, _), k in zip(ROWS, label) if k == own and j is not None), default=None)))
        for (i, _), p, own in zip(ROWS, prints, label)
    )
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in got) == want
    assert {r["fp"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}


def test_simhash_keeps_one_of_each(spark):
    docs = table(spark, ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 6, 9, 10, None])) or 7 in ids or len(ids) == len(set(ids))
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and ids.count(None) == 1
    assert simhash.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [8192, 100, 20])
def test_simhash_links_are_complete_for_hot_groups(spark, limit):
    random = np.random.default_rng(1)
    codes = {int(c) for c in random.integers(0, 2**63, 40, dtype=np.uint64)}
    centre = next(iter(codes))
    for _ in range(250):
        code = centre
        for bit in random.choice(64, random.integers(1, 6), replace=False):
            code ^= 1 << int(bit)
        codes.add(code)
    codes = sorted(codes)
    found = simhash.links(spark.createDataFrame([(signed(c),) for c in codes], "fp long"), 4, limit).collect()
    place = {signed(c): k for k, c in enumerate(codes)}
    label = simhash.spanning(len(codes), np.array([place[r["a"]] for r in found]), np.array([place[r["b"]] for r in found]))
    assert (label == reach(codes)).all()


def test_hierarchy_finds_the_same_pairs_as_all_pairs():
    random = np.random.default_rng(2)
    codes = random.integers(0, 2**16, 500, dtype=np.uint64)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.close_pairs(codes, 4)
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1))
    assert sorted(zip(a, b)) == sorted(zip(i, j))


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def brute_contamination(text, items, size=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, names = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            window = w[s : s + size]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(own)


def test_contamination_matches_brute_force(spark):
    passage = " ".join(f"w{i % 7}" for i in range(20))
    items = [(1, passage), (2, "Short Item"), (3, None), (4, ""), (5, "uno"), (10, passage), (11, " ".join(f"q{i}" for i in range(13)))]
    rows = [
        (1, f"before {passage} after"), (2, passage), (2, passage), (3, None), (4, ""), (5, "a SHORT, item here " + "x " * 90),
        (6, "w0 " * 50), (None, "uno"), (7, LONG + " " + " ".join(f"q{i}" for i in range(13))), (8, " ".join(f"q{i}" for i in range(12))),
        (9, "clean words only"), (2, "another text with the same id"),
    ]
    got = decontaminate.contamination(table(spark, rows), items_table(spark, items)).collect()
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    have = sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in got)
    assert have == sorted((str(i), *brute_contamination(t, items)) for i, t in rows)
    kept = decontaminate.remove(table(spark, rows), items_table(spark, items))
    assert len(kept.columns) == 8
    assert kept.count() == sum(not brute_contamination(t, items)[-1] for _, t in rows)


def test_contamination_of_empty_tables(spark):
    nothing = decontaminate.contamination(table(spark, []), items_table(spark, [(1, "a b")]))
    assert nothing.count() == 0
    clean = decontaminate.contamination(table(spark, ROWS), items_table(spark, []))
    assert clean.where("n_hit > 0 OR contaminated").count() == 0 and clean.count() == len(ROWS)


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba", *[f"<0x{i:02X}>" for i in range(256)]]
    lattice = language.Lattice(vocabulary)
    p = np.full(len(vocabulary), 0.02)
    p[:6] = [0.2, 0.1, 0.15, 0.3, 0.05, 0.07]

    def total(text):  # every way to cut the text
        if not text:
            return 1.0
        return sum(p[i] * total(text[len(v) :]) for i, v in enumerate(vocabulary[:6]) if text.startswith(v))

    edges = lattice.edges("abab")
    assert np.isclose(language.log_probabilities(edges, [[q] for q in p])[0], np.log(total("▁abab")))
    counts = language.expected_counts(edges, list(p))
    length = sum(counts[i] * len(vocabulary[i]) for i in counts)
    assert np.isclose(length, len("▁abab"))
    long = language.log_probabilities(lattice.edges("ab" * 3000), [[q] for q in p])[0]
    assert -20000 < long < -1000
    assert language.log_probabilities(lattice.edges("aλ"), [[q] for q in p])[0] > -30  # bytes


def test_scorer_agrees_with_the_lattice():
    vocabulary = ["▁", "a", "b", "c", "ab", "▁a", "bca", "▁abc", *[f"<0x{i:02X}>" for i in range(256)]]
    random = np.random.default_rng(4)
    p = random.dirichlet(np.ones(len(vocabulary)), 2).T
    words = ["".join(random.choice(list("abcλ"), n)) for n in (1, 2, 3, 5, 8, 13, 63, 64, 65, 66, 200, 3000) for _ in range(3)]
    lattice, scorer = language.Lattice(vocabulary), language.Scorer(vocabulary, p)
    want = [[language.log_probabilities(lattice.edges(w), [[q] for q in c])[0] for c in p.T.tolist()] for w in words]
    np.testing.assert_allclose(scorer(words), want, rtol=1e-9)


def test_a_rare_language_is_learned_and_copies_do_not_crowd_it_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-3, "qaxo zuqa xozu qazu"), (-7, "zuxo qaqa xoxo zuqa")], "doc_id long, text string")
    copies = spark.range(20000).selectExpr("NULL AS doc_id", "'the same text' AS text", "'en' AS lang")
    both = docs.unionByName(rare.selectExpr("*", "'rr' AS lang")).unionByName(copies)
    learned = both.where(~common.held_out(F.col("doc_id")))
    sample, counts = common.sample_per_key(learned, "lang", ["doc_id", "text"], 50)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert set(sizes) == set(counts) and all(n == 50 for lang, n in sizes.items() if lang != "rr")
    assert sizes["rr"] == counts["rr"] == learned.where("lang = 'rr'").count() > 0 and counts["en"] > 20000
    model = language.fit(both, fit_rows=50)
    assert "rr" in model.languages
    assert language.identify(rare, model).first()["lang_pred"] == "rr"


def test_samples_of_null_and_repeated_ids(spark):
    rows = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS id", "CAST(id AS STRING) AS text")
    for ids in ("CAST(NULL AS LONG)", "id % 3", "IF(id % 2 = 0, NULL, id)", "id"):
        some = common.bounded_sample(spark.range(5000).selectExpr(f"{ids} AS id", "CAST(id AS STRING) AS text"), "id", 300)
        assert some.count() == 300 and some.distinct().count() == 300
    assert common.bounded_sample(rows.limit(0), "id", 300).count() == 0
    assert common.bounded_sample(rows.limit(20), "id", 300).count() == 20


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    got = language.identify(docs, model).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got["lang_pred"] == got["lang"])[got["held_out"]].mean() > 0.97
    odd = language.identify(table(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "the and of"), (4, "x" * 100000)]), model)
    rows = {r["doc_id"]: r for r in odd.collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    empty = language.fit(table(spark, []))
    assert {r["lang_pred"] for r in language.identify(table(spark, ROWS), empty).collect()} == {"und"}


def test_factorisation_identity():
    random = np.random.default_rng(0)
    model = quality.Model(np.zeros((1, 1)), 0.3, random.normal(size=9), random.normal(size=(9, 4)))
    index, value = np.array([0, 3, 5, 8]), np.array([1.0, 0.5, 2.0, -1.0])
    x = quality.Features(index, value, np.array([4]))
    pairs = sum(
        value[a] * value[b] * model.factors[index[a]] @ model.factors[index[b]] for a in range(4) for b in range(a + 1, 4)
    )
    assert np.isclose(model.raw(x)[0][0], 0.3 + model.weight[index] @ value + pairs)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    test = got[got["held_out"]]
    assert (test["predicted"] == test["quality"]).mean() > 0.95
    odd = quality.classify(table(spark, ROWS), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    blank = quality.fit(table(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r["score"], 1) for r in quality.classify(table(spark, ROWS), blank).collect()} <= {0.5, 0.4, 0.6}


def test_mixing_meets_targets(spark):
    random = np.random.default_rng(5)
    rows = [(i, " ".join(random.choice(["red", "rot"] if i % 3 else ["blue", "blau"], 30))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "red rot"), (5, rows[5][1])]
    docs = table(spark, rows)
    labelled = spark.createDataFrame([(i, "warm" if i % 3 else "cold") for i in range(150)] + [(7, None), (None, "warm")], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"warm": 0.5, "cold": 0.5}).toPandas()
    assert len(got) == len(rows) - 1  # the repeated row has one rate
    weight = got["n_tokens"] * np.where(got["doc_id"] == 5, 2, 1)
    share = [(weight * got["rate"] * got[f"p_{d}"]).sum() / weight.sum() for d in ("warm", "cold")]
    assert np.allclose(share, 0.5, atol=0.01) and (got["rate"] >= 0).all()
    assert np.allclose(got["p_warm"] + got["p_cold"], 1)
    with_rates = mixing.with_rates(docs, mixing.mix(docs, labelled, {"warm": 1.0, "cold": 1.0}))
    assert with_rates.columns == [*docs.columns, "sampling_rate"] and with_rates.count() == len(rows)
    none = mixing.mix(table(spark, []), labelled, {"warm": 1.0, "cold": 1.0})
    assert none.count() == 0


def test_words_beside_signs_are_features(spark):
    texts = ["an idiot. (idiot) idiot", "idiot", "report.\tidiot!\n-- ", "", "caf\u00e9, 3%", "«idiot»"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: set(r["b"]) for r in docs.select("doc_id", mixing.word_buckets(F.col("text")).alias("b")).collect()}
    keys = ["idiot", "an", "report", "caf\u00e9", "3", " .", " )", " !", " -", " ,", " %"]
    one = spark.createDataFrame([(k,) for k in keys], "k string")
    of = {r["k"]: r["b"] for r in one.select("k", F.pmod(F.xxhash64("k"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    want = [["an", "idiot", " .", " )"], ["idiot"], ["report", " .", "idiot", " !", " -"], [], ["caf\u00e9", " ,", "3", " %"], ["idiot"]]
    assert found == {i: {of[k] for k in w} for i, w in enumerate(want)}
    # The evidence of a text is the sum over these features, each once.
    weights = spark.createDataFrame([(b, [float(2**k), -1.0]) for k, b in enumerate(of.values())], "bucket int, w array<double>")
    sums = mixing.evidence(docs, ["doc_id"], "text", weights, 2).collect()
    place = {b: k for k, b in enumerate(of.values())}
    assert {r["doc_id"]: (r["s0"], r["s1"]) for r in sums} == {
        i: (sum(2.0 ** place[b] for b in found[i]), -float(len(found[i]))) for i in found if found[i]
    }


def test_targets_out_of_reach_are_named(spark):
    posts = spark.createDataFrame([(1, 10, 1, 1.0, 0.0)], "id int, tokens long, rows long, p0 double, p1 double")
    with pytest.warns(UserWarning, match="domain shares after 5 steps"):
        assert len(mixing.fit_rates(posts, [0.5, 0.5], None, steps=5)) == 5


def test_projected_gradient_solves_the_least_squares_problem(spark):
    random = np.random.default_rng(6)
    p = random.dirichlet([0.4, 0.4, 0.4], 60)
    tokens = random.integers(1, 50, 60)
    posts = spark.createDataFrame([(i, int(t), 1, *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))], "id int, tokens long, rows long, p0 double, p1 double, p2 double")
    steps = mixing.fit_rates(posts, [0.8, 0.15, 0.05], None, steps=60)
    rates = np.array([r["r"] for r in posts.orderBy("id").select(mixing.rate(steps, 3).alias("r")).collect()])
    total = (tokens * rates) @ p / tokens.sum()
    assert (rates >= 0).all() and np.abs(total - [0.8, 0.15, 0.05]).max() < 2e-3


def test_licences(spark):
    model = licences.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [
        (1, "intro\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (None, "Licensed under the Apache License, Version 2.0."),
        (4, "the license of a dog is permitted"), (5, LONG + "\nLicensed under CC BY-NC 4.0.\n" + LONG), (1, "Released under the MIT License."),
        (6, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = licences.digest(licences.scan(table(spark, rows), model)).collect()
    assert sorted((str(r["doc_id"]), r["licences"]) for r in got) == sorted(
        zip(["1", "2", "3", "None", "4", "5", "1", "6"], ["mit", "", "", "apache", "", "cc-by-nc", "mit", "gpl"])
    )
    where = licences.scan(table(spark, rows), model).where("doc_id = 5").first()["paragraphs"][0]
    assert where["line"] == 1 and where["text"] == "Licensed under CC BY-NC 4.0." and where["confirmed"]
    assert licences.scan(table(spark, []), licences.fit(table(spark, []))).count() == 0


def test_wrapped_and_dual_licences(spark):
    model = licences.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General\n" \
        "# Public License as published by the Free Software\n# Foundation, either version 3 of the License."  # fmt: skip
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General\n" \
        "Public License as published by the Free Software\nFoundation; either version 2.1 of the License."  # fmt: skip
    bsd = "Redistribution and use in source and binary forms, with\nor without modification, are permitted provided\nthat the following conditions\nare met:"
    rows = [
        (1, f"intro\n\n{gpl}\n#\n# other"), (2, lgpl), (3, bsd), (4, "Licensed under the Apache License, Version 2.0 or the MIT license."),
        (5, "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0\nInternational License"),
        (6, "Released under the MIT License. Licensed under CC BY 4.0."), (7, "an ordinary line\nthat goes on under\nthe terms of the trade"),
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.digest(licences.scan(table(spark, rows), model)).collect()}
    assert got == {1: "gpl", 2: "lgpl", 3: "bsd", 4: "apache,mit", 5: "cc-by-nc", 6: "cc-by,mit", 7: ""}
