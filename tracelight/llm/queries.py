"""Registered queries of the corpus operators, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import (
    chat,
    decontaminate,
    extract,
    language,
    licences,
    mixing,
    neighbours,
    packing,
    quality,
    simhash,
    spelling,
    warc,
    whitening,
)
from tracelight.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return register


_NEIGHBOUR_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS s
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(q.s * v.s) AS score
    FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_neighbours", _NEIGHBOUR_SQL)
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = read(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


@query("op2_quality")
def qualities(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labelled documents that are not held out."""
    docs = read(spark, folder, "documents")
    return quality.classify(docs, quality.fit(docs, read(spark, folder, "labels")))


#: Share of the tokens each domain of the labels table shall have.
TARGETS = {"good": 0.9, "poor": 0.05, "toxic": 0.05}


@query("op3_mixing")
def mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents that bring the domains of the labels table to their target shares."""
    labelled = mixing.label_domains(read(spark, folder, "labels"))
    return mixing.mix(read(spark, folder, "documents"), labelled, TARGETS).drop("key")


_CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, s, s + 12) AS v FROM
        (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, len(w) AS n, s, w, list_slice(w, s, s + 12) AS v FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d)),
full_hits AS (SELECT dw.r, dw.s, len(win.v) AS n, win.item FROM dw JOIN win ON dw.v = win.v),
short_win AS (SELECT * FROM win WHERE len(v) < 13),
short_hits AS (SELECT dw.r, dw.s, len(q.v) AS n, q.item FROM dw JOIN short_win q
        ON dw.w[dw.s] = q.v[1] AND list_slice(dw.w, dw.s, dw.s + len(q.v) - 1) = q.v),
hits AS (SELECT * FROM full_hits UNION SELECT * FROM short_hits),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@query("op4_contamination", _CONTAMINATION_SQL)
def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside benchmark windows of 13 words."""
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.drop("key")


@query("op5_licences")
def licensed(spark: SparkSession, folder: str) -> DataFrame:
    """Licence paragraphs of every document."""
    docs = read(spark, folder, "documents")
    return licences.digest(licences.scan(docs, licences.fit(docs)))


@query("op6_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = read(spark, folder, "documents")
    return language.identify(docs, language.fit(docs))


_CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g'))
    + length('<|turn|><|text|><|end|>') AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op7_chat", _CHAT_SQL)
def chats(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_rows(rows), "conv_id")


@query("op8_main_text")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(read(spark, folder, "pages"))


_WARC_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS low FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM q
"""


@query("op9_warc", _WARC_SQL)
def archived(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record and read back by byte ranges."""
    return warc.round_trip(spark, read(spark, folder, "pages"))


@query("op10_simhash_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document over 4-word SimHashes at most 4 bits apart."""
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_whitening")
def whitened(spark: SparkSession, folder: str) -> DataFrame:
    """The first four whitened coordinates of every vector, fitted on the distinct ones."""
    return whitening.whiten(read(spark, folder, "embeddings"))


@query("op12_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.digest(packing.pack(read(spark, folder, "documents")))


_SPELLING_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)),
        lambda v, i: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))),
        lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1]))) AS h FROM low, crc),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
    CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f AS last ON last.word = walk.root AND last.form IS NULL
"""


@query("op13_spelling", _SPELLING_SQL)
def spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among all words of all documents, with one run in 31 misspelt."""
    return spelling.variants(read(spark, folder, "documents"), noise=31)
