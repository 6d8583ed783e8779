"""Operators over embeddings, conversations and pages, and the pipeline."""

import gzip
import hashlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelight.llm import chat, extract, language, neighbours, queries, warc

FOLDER = "/root/testdata/sf0.001"


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, dim int, block int")


def brute_nearest(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i in queries:
            near = {(j, tuple(x)): q @ x / np.sqrt((q @ q) * (x @ x)) for j, x in good if j != i and len(x) == len(q)}
            out[i] = sorted(((round(-s, 9), j) for (j, _), s in near.items()))[:k]
    return out


def test_neighbours_with_ties_and_unusable_vectors(spark):
    random = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=12)]) for i in range(300)]
    same = rows[7][1]
    rows += [(i, same) for i in range(1000, 1030)]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [None] + [1.0] * 11), (404, [float("nan")] * 12)]
    rows += [(405, [float("inf")] * 12), (None, same), (406, [1.0, 2.0]), (407, [2.0, 4.5]), (3, rows[3][1]), (408, [1e30] * 12)]
    asked = {0, 7, 50, 100, 1000, 1015, 402, 403, 406, 408, 3}
    table = vectors_table(spark, rows)
    got = neighbours.search(table, table.where(F.col("vec_id").isin(list(asked))), block_rows=64, tile_queries=4).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((round(-r["score"], 9), r["vec_id"]))
    want = {i: v for i, v in brute_nearest(rows, asked, 5).items() if v}
    assert have == want
    empty = vectors_table(spark, [])
    assert neighbours.search(empty, empty).count() == 0
    assert neighbours.search(table, empty).count() == 0


def test_repeated_rows_take_no_places_of_other_neighbours(spark):
    random = np.random.default_rng(9)
    base = [float(np.float32(x)) for x in random.normal(size=12)]
    near = [[float(np.float32(b + 0.01 * k)) if j == 0 else b for j, b in enumerate(base)] for k in range(1, 5)]
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=12)]) for i in range(100, 200)]
    rows += [(0, base)] + [(1, near[0])] * 9 + [(i, near[0]) for i in (2, 3)] + [(4, near[1])] * 7 + [(5, near[2]), (6, near[3])]
    table = vectors_table(spark, rows)
    got = neighbours.search(table, table.where("vec_id IN (0, 1)")).orderBy("query_id", "rank").collect()
    want = [(q, j) for q, near in sorted(brute_nearest(rows, {0, 1}, 5).items()) for _, j in near]
    assert [(r["query_id"], r["vec_id"]) for r in got] == want and [j for q, j in want if q == 0] == [1, 2, 3, 4, 5]


def test_bounds_hold_and_recall(spark):
    random = np.random.default_rng(3)
    units = neighbours.unit(random.normal(size=(2000, 64)))
    turn, centre = neighbours.frame(64, neighbours.CODE_BITS), units.mean(axis=0)
    codes, scalars = neighbours.encode(units, centre, turn)
    assert codes.shape == (2000, neighbours.CODE_BITS // 8)
    cosine, error = neighbours.estimate(codes, scalars, units[:50], centre, turn)
    away = np.abs(cosine - units[:50] @ units.T)
    assert (away <= error).mean() > 0.99 and abs((cosine - units[:50] @ units.T).mean()) < 0.005
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.search(table, table.where("vec_id % 20 = 0")).collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = {(q, j) for q, near in brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 5).items() for _, j in near}
    assert len(got & want) / len(want) >= 0.99


def test_layouts_become_canonical_turns(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}],"id":3}': ("messages", [("user", "a"), ("assistant", "")]),
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}': ("conversations", [("user", "q"), ("assistant", "r")]),
        '{"instruction":"i","input":"x","output":"o"}': ("instruction_input_output", [("user", "i\n\nx"), ("assistant", "o")]),
        '{"instruction":"i","input":"","output":"o"}': ("instruction_input_output", [("user", "i"), ("assistant", "o")]),
        '{"instruction":"i","output":"o"}': ("instruction_output", [("user", "i"), ("assistant", "o")]),
        '{"prompt":"p","response":"r","score":1}': ("prompt_response", [("user", "p"), ("assistant", "r")]),
        '{"prompt":"p","completion":"c"}': ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        '{"system":"s","prompt":"p","response":"r"}': ("system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        '{"question":"q","answer":"a"}': ("question_answer", [("user", "q"), ("assistant", "a")]),
        '{"role":"user","text":"t"}': ("turn", [("user", "t")]), '{"role":"gpt","text":"t"}': ("turn", [("gpt", "t")]),
        '{"other":1}': (None, []), "{}": (None, []), "null": (None, []), "[]": (None, []),
    }
    table = spark.createDataFrame([(r,) for r in records], "raw string").withColumn("record", F.parse_json("raw"))
    for row in chat.canonical(table, "record").select("raw", "layout", "turns").collect():
        assert (row["layout"], [(t["role"], t["text"]) for t in row["turns"]]) == records[row["raw"]], row["raw"]


def test_format_is_reversible(spark):
    nasty = "\\ \\\\ <|turn|> <|end|>\\<|text|> </s>[INST] [/INST] <<SYS>>\n<|im_start|>😀 \\n $1"
    rows = [
        (1, 1, "assistant", nasty, "x"), (1, 0, "user", nasty, "x"), (1, 1, "assistant", nasty, "x"), (2, 0, None, None, "x"),
        (None, 0, "assistant", "", "x"), (3, None, "assistant", "b", "x"), (3, None, "assistant", "a", "x"), (4, 0, nasty, "x" * 100000, "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    samples = chat.format_rows(table)
    back = samples.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("mask")))
    got = {r["conv_id"]: r for r in back.collect()}
    pairs = {i: [(t["role"], t["text"]) for t in r["turns"]] for i, r in got.items()}
    assert pairs[1] == [("user", nasty), ("assistant", nasty), ("assistant", nasty)] and got[1]["loss"] == nasty * 2
    assert pairs[2] == [("", "")] and pairs[None] == [("assistant", "")] and got[None]["loss"] == ""
    assert pairs[3] == [("assistant", "a"), ("assistant", "b")] and pairs[4] == [(nasty, "x" * 100000)]
    assert got[1]["formatted"].count("<|turn|>") == 3 and "[INST]" not in got[1]["formatted"]
    assert chat.digest(chat.format_rows(table.where("false")), "conv_id").count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li>Home<li>About</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p><b>bold</b>ly  said<br>so<p>second\n para"
    "<div id=comments><p>first!</p></div><aside>see also</aside><form><input>send</form><p>end</p></article>"
    "<footer>&copy; x</footer></body></html>"
)
MENU = " ".join(f"menu{i}" for i in range(20))


def test_main_text(spark):
    def bare(text):
        return f"<html><body><div>{MENU}</div><div>{text}</div></body></html>"

    rows = [
        (1, "http://a.example/1", PAGE), (2, None, None), (3, "nonsense", ""), (4, "http://b.example/1", bare("one text")),
        (5, "http://b.example/2", bare("another text")), (6, "http://c.example/1", bare("alone on its host")), (4, "http://b.example/1", bare("one text")),
        (None, "http://d.example/", "<p>unclosed <i>italic"), (8, "http://d.example/2", "<article><p>" + "word " * 50000),
        (9, "http://e.example/1", bare("copied page")), (10, "http://e.example/2", bare("copied page")),
    ]
    table = spark.createDataFrame([(i, u, h, "", "") for i, u, h in rows], "page_id long, url string, html string, text string, host string")
    got = extract.extract(table).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "A & B boldly said so second para end"
    assert texts[2] == texts[3] == "" and texts[None] == "unclosed italic"
    assert texts[4] == "one text" and texts[5] == "another text"
    assert texts[6] == f"{MENU} alone on its host"  # nothing shows that this menu is boilerplate
    assert texts[9] == texts[10] == f"{MENU} copied page"  # copies do not erase each other
    assert len(texts[8].split()) == 50000
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.extract(table.where("false")).count() == 0


def test_repeated_runs_inside_articles(spark):
    random = np.random.default_rng(8)
    notice = " ".join(f"notice{i}" for i in range(14))
    texts = [" ".join(f"w{x}" for x in random.integers(0, 10**6, 60)) for _ in range(8)]
    near = texts[7].split()
    near[30] = "changed"
    rows = [(i, "http://a.example/", f"<article><p>{t}</p><div>{notice}</div><p>end{i}</p></article>") for i, t in enumerate(texts)]
    rows += [(20, "http://a.example/", f"<article><p>{' '.join(near)}</p><div>{notice}</div><p>end20</p></article>")]
    rows += [(30, "http://b.example/", f"<article><p>{texts[0]} {notice}</p></article>"), (31, "http://b.example/", f"<main>{notice.upper()}</main>")]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{t} end{i}" for i, t in enumerate(texts))
    assert got[20] == " ".join(near) + " end20"  # nearly a copy of another article, without what all have
    assert got[30] == f"{texts[0]} {notice}" and got[31] == notice.upper()  # no part of a block goes


def test_article_sentences_next_to_menus_and_quotations_stay(spark):
    footer = "<footer>© blog.example.org all rights reserved here now</footer>"
    last = "nine words that end an article on this page"
    quote = " ".join(f"quoted{i}" for i in range(15))
    random = np.random.default_rng(18)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 10**6, 40)) for _ in range(8)]
    rows = [(i, "http://a.example/", f"<article><p>{t}</p><p>{last}</p></article>{footer}") for i, t in enumerate(texts[:4])]
    rows += [(10 + i, "http://b.example/", f"<article><p>{t}</p>{f'<p>{quote}</p>' if i < 2 else ''}<p>end{i}</p></article>") for i, t in enumerate(texts[4:])]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{t} {last}" for i, t in enumerate(texts[:4]))
    assert all(got[10 + i] == f"{t} {quote} end{i}" if i < 2 else f"{t} end{i}" for i, t in enumerate(texts[4:]))


def plain_kept(parts, found, run, host_pages):
    """The rule, token by token."""
    tokens = [(b, x["kind"], w) for b, x in enumerate(parts) for w in x["text"].split(" ")]
    pages = [1] * len(tokens)
    for x in found:
        for s in range(x["first"], x["last"] + 1):
            if len({k for _, k, _ in tokens[s : s + run]}) == 1:
                for i in range(s, s + run):
                    pages[i] = max(pages[i], x["pages"])
    main = [p for p, (_, k, _) in zip(pages, tokens) if k == extract.MAIN]
    if not main:
        return " ".join(w for p, (_, k, w) in zip(pages, tokens) if k == extract.OPEN and p == 1)
    usual = sorted(main)[(len(main) - 1) // 2]
    gone = set()
    for b in {b for b, k, _ in tokens if k == extract.MAIN}:
        least = min(p for p, (c, _, _) in zip(pages, tokens) if c == b)
        if least >= 3 and 2 * least > host_pages and least > usual:
            gone.add(b)
    return " ".join(w for b, k, w in tokens if k == extract.MAIN and b not in gone)


def test_kept_matches_the_rule_token_by_token():
    random = np.random.default_rng(28)
    for _ in range(400):
        kinds = [extract.MAIN, extract.PART] if random.random() < 0.7 else [extract.OPEN, extract.PART]
        parts = [{"kind": kinds[random.integers(2)], "text": " ".join(f"t{i}" for i in range(random.integers(1, 7)))} for _ in range(random.integers(1, 9))]
        n, run = sum(len(x["text"].split(" ")) for x in parts), 3
        starts = sorted(set(random.integers(0, max(1, n - run + 1), random.integers(0, 12)).tolist())) if n >= run else []
        found = [{"first": s, "last": s, "pages": int(random.integers(2, 9))} for s in starts]
        found = [{"first": x["first"], "last": min(x["first"] + int(random.integers(0, 3)), n - run), "pages": x["pages"]} for x in found]
        host = int(random.integers(1, 12))
        assert extract.kept(parts, found, run, host) == plain_kept(parts, found, run, host)


@pytest.mark.parametrize("label", ["layout has-sidebar", "post no-comments", "sidebar", "with-header text-navy", "site-banner"])
def test_articles_in_marked_wrappers_are_text(label):
    page = f'<div class="{label}"><p>aside</p><article><h1>head</h1><p class="market-share">shares</p><p id="text-navy">blue</p>' \
        '<div class="ad-box">buy</div><div class="related-posts"><article>other</article></div></article></div><div class="site-footer">end</div>'  # fmt: skip
    found = extract.blocks(page)
    assert [t for k, t in found if k == extract.MAIN] == ["head", "shares", "blue"]
    assert {"buy", "other", "end"} <= {t for k, t in found if k == extract.PART}


@pytest.mark.parametrize("around", ['nav', 'aside', 'footer', 'form', 'div class="comments"', 'section id="post-comments"'])
def test_articles_in_other_parts_are_no_text(around):
    assert [k for k, _ in extract.blocks(f"<{around}><article><p>some words</p></article></{around.split()[0]}>")] == [extract.PART]


@pytest.mark.parametrize("odd", ["<![ x", "<![foo bar", "<![foo]", "<![1", "<![", "<![if", "<!"])
def test_text_after_unknown_declarations_stays(odd):
    found = extract.blocks(f"<article><p>before {odd}> after</p><p>last</p></article>")
    text = " ".join(t for k, t in found if k == extract.MAIN)
    assert text.startswith("before") and text.endswith("after last")
    assert extract.blocks(f"<article><p>before {odd}")[0][1].startswith("before")


def test_repeated_runs_match_brute_force(spark):
    random = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in random.integers(0, 3, 60)) for _ in range(8)]
    pages = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "host string, page long, text string")
    got = {(r["page"], r["at"]) for r in extract.repeated(pages, 6).collect()}
    words = [t.split() for t in texts]
    runs = {}
    for i, w in enumerate(words):
        for at in range(len(w) - 5):
            runs.setdefault(tuple(w[at : at + 6]), set()).add((i, at))
    assert got == {x for found in runs.values() if len({p for p, _ in found}) > 1 for x in found}


def test_byte_ranges_are_tasks(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 400) for i in range(60)], "page_id long, url string, html string").repartition(3)
    folder = queries.warc.shared_directory(spark, "warc-test")
    archives = warc.stored(warc.write(warc.classified(pages, "page_id", "url", "html"), folder), "warc-test-archives")
    size = archives.agg(F.max("bytes")).first()[0] // 9
    records = warc.read_archives(archives, size).withColumn("task", F.spark_partition_id())
    assert records.count() == 60
    tasks = records.groupBy("task").count().collect()
    assert len(tasks) >= 9 and max(r["count"] for r in tasks) <= 20


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_warc_round_trip(spark, split):
    body, evil = "<p>" + "same " * 60, "\x1f\x8b\x08 WARC/1.0 é" * 40
    rows = [(5, body), (3, body), (9, body), (1, None), (2, ""), (4, "short"), (6, "short"), (7, evil), (None, body), (3, body), (8, "x" * 300000)]
    table = spark.createDataFrame([(i, "http://a.example/é\r\nX: y", h, 0) for i, h in rows], "page_id long, url string, html string, payload int")
    got = warc.round_trip(spark, table, split_bytes=split).collect()
    want = []
    for i, h in rows:
        data = (h or "").encode()
        low = min((j for j, g in rows if g == h and j is not None), default=None) if len(data) >= 100 else None
        other = low is not None and i != low
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", str(low if other else None)))
    names = ["payload_bytes", "payload_digest", "record_type"]
    assert sorted((str(r["page_id"]), *[r[n] for n in names], str(r["refers_to"])) for r in got) == sorted(want)
    assert warc.round_trip(spark, table.where("false")).count() == 0


def test_members_are_plain_gzip():
    one = warc.record("response", 1, "http://a.example/", None, b"payload", "00")
    two = warc.record("revisit", 2, None, 1, b"payload", "00")
    whole = gzip.decompress(one + two)
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.count(b"payload\r\n\r\n") == 1
    assert [warc.parsed(x)[:3] for x in warc.scan(io.BytesIO(b"junk\x1f\x8b\x08" + one + two), 0, 10**6)] == [(1, "response", None), (2, "revisit", 1)]


@pytest.mark.parametrize("name", ["op1_neighbours", "op4_contamination", "op7_chat", "op9_warc"])
def test_queries_agree_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0

    def plain(frame):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), "-").itertuples(index=False))

    assert plain(got) == plain(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, FOLDER), f"test-{name}")
        counts.append(kept.count())
        assert kept.columns[: len(columns)] == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert counts[1] > 0.95 * counts[0]  # all documents have a language
    clash = docs.selectExpr("*", "1 AS language", "2 AS quality", "3 AS _own", "4 AS _n", "5 AS sampling_rate").union(
        spark.createDataFrame([(None, None, None, None, None, 1, 2, 3, 4, 5)], "a long, b string, c string, d string, e long, f int, g int, h int, i int, j int")
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, FOLDER)
        assert out.columns[: len(clash.columns)] == clash.columns and out.count() > 0
        assert stage(spark, clash.where("false"), FOLDER).count() == 0
    assert language.UNDETERMINED not in {r["lang"] for r in kept.collect()}
