"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every window of an item is a set of positioned shingles (runs of a few words). A document that holds the
window holds all its shingles, so it is enough to join one of them, the prefix: the shingle that is
rarest in the documents. Its position in the document fixes where the window would start; windows that
would begin before the text or end after it are dropped by that bound, and the rest are compared word by
word with the item-sized window of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import ascii_lower, broadcast_if_small, stored, with_column

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_SHINGLES = 1_000_000  # rows of two numbers, at most about 50 MB in a task


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def shingle(words: Column, first: Column, size: int) -> Column:
    """Hash of ``size`` words from the 0-based position ``first`` on."""
    return F.xxhash64(F.lit(size), *[F.get(words, first + k) for k in range(size)])


def windows(items: DataFrame, id_col: str, text_col: str, size: int, run: int) -> DataFrame:
    """(window, item, words, n, size of its shingles, shingles): every window of every item.

    An item shorter than ``size`` words is one window; one without words has none.
    """
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    own = own.where(F.size("words") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    own = own.select("item", "words", F.explode(starts).alias("start"))
    own = own.select("item", F.slice("words", F.col("start"), size).alias("words"))
    return own.select(
        F.xxhash64("words").alias("window"), "item", "words", F.size("words").alias("n"),
        F.least(F.lit(run), F.size("words")).alias("run"),
    ).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and a digest of the text: rows that agree in both have the same result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def matches(docs: DataFrame, shingles: DataFrame, runs: list[int]) -> DataFrame:
    """(id, key, at, shingle) wherever a shingle of ``shingles`` occurs in a document.

    The shingles are broadcast, in as many passes as keep each part below the stated size.
    """
    parts = 1 + shingles.count() // BROADCAST_SHINGLES
    found = []
    for part in range(parts):
        some = shingles.where(F.pmod("shingle", F.lit(parts)) == part) if parts > 1 else shingles
        for run in runs:
            words = docs.select("id", "key", words_of(F.col("text")).alias("words"))
            each = words.select("id", "key", "words", F.posexplode("words").alias("at", "word"))
            each = each.where(F.col("at") <= F.size("words") - run)
            each = each.select("id", "key", "at", shingle(F.col("words"), F.col("at"), run).alias("shingle"))
            found.append(each.join(F.broadcast(some.where(F.col("run") == run).select("shingle")), "shingle"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("id", "key", "at", "shingle")


def occurrences(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, size: int, run: int
) -> DataFrame:
    """(id, key, item, start, n): every place where a window of an item stands in a document, verified."""
    own = keyed(docs, id_col, text_col)
    wins = stored(windows(items, item_id, item_text, size, run), "benchmark-windows")
    runs = sorted(r["run"] for r in wins.select("run").distinct().collect()) or [run]  # 1 to `run`
    parts = []
    for r in runs:
        at = F.explode(F.sequence(F.lit(0), F.col("n") - r)).alias("offset")
        each = wins.where(F.col("run") == r).select("window", "words", "run", at).distinct()
        parts.append(each.select("window", "run", "offset", shingle(F.col("words"), F.col("offset"), r).alias("shingle")))
    tokens = parts[0]
    for more in parts[1:]:
        tokens = tokens.union(more)
    tokens = stored(tokens, "benchmark-shingles")
    hits = stored(matches(own, tokens.select("shingle", "run").distinct(), runs), "shingle-matches")
    rarity = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    # A shingle that never occurs rules its windows out, so only found ones are ordered.
    known = tokens.join(rarity, "shingle", "left")
    order = Window.partitionBy("window").orderBy(F.coalesce("seen", F.lit(0)), "shingle", "offset")
    prefix = known.withColumn("place", F.row_number().over(order)).where("place = 1 AND seen > 0")
    texts = wins.select("window", "words", "n").distinct()
    prefix = prefix.select("window", "shingle", "offset").join(texts, "window")
    start = F.col("at") - F.col("offset")
    candidates = hits.join(prefix, "shingle").where(start >= 0)  # positional bound at the front
    candidates = candidates.select("id", "key", "window", "n", F.col("words").alias("wanted"), start.alias("start"))
    candidates = stored(candidates, "window-candidates")
    asked = stored(candidates.select(F.col("id").alias("_i"), F.col("key").alias("_k")).distinct(), "candidate-keys")
    rows = own.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "text")
    named = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))
    rows = rows.join(broadcast_if_small(asked), named, "left_semi")  # only texts with candidates move
    rows = rows.dropDuplicates(["_id", "_key"]).select("_id", "_key", words_of(F.col("text")).alias("have"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    fits = F.col("start") + F.col("n") <= F.size("have")  # length and positional bound at the end
    equal = F.slice("have", F.col("start") + 1, F.col("n")) == F.col("wanted")
    verified = candidates.join(rows, same & fits & equal).select("id", "key", "window", "start", "n").distinct()
    owners = wins.select("window", "item").distinct()
    return verified.join(owners, "window").select("id", "key", "item", "start", "n")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    run: int = 3,
    share: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: id, key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if it has a hit word
    and at least one word in ``share`` is hit. Null and empty texts have no words and are clean; items
    without words have no window; repeated items and repeated rows count alike, each row comes out;
    null ids are kept; empty tables give clean or no rows; other columns are not read.
    """
    found = stored(occurrences(docs, items, id_col, text_col, item_id, item_text, size, run), "occurrences")
    places = found.select("id", "key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at"))
    hit = places.distinct().groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = found.select("id", "key", "item").distinct().groupBy("id", "key")
    names = names.agg(F.sort_array(F.collect_list("item")).alias("items"))  # at most one per window of the text
    facts = hit.join(names, hit.id.eqNullSafe(names.id) & (hit.key == names.key)).select(
        hit.id.alias("_id"), hit.key.alias("_key"), "n_hit", "items"
    )
    own = keyed(docs, id_col, text_col).select("id", "key", F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    both = own.join(facts, own.id.eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        F.col("id").alias(id_col),
        "key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows."""
    found = contamination(docs, items, id_col, text_col, **options).where("contaminated")
    tagged, key = with_column(docs, "_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    bad = stored(found.select(id_col, F.col("key").alias(key)).distinct(), "contaminated")
    bad = broadcast_if_small(bad).alias("bad")
    same = F.col(f"docs.{id_col}").eqNullSafe(F.col(f"bad.{id_col}")) & (F.col(f"docs.{key}") == F.col(f"bad.{key}"))
    return tagged.alias("docs").join(bad, same, "left_anti").drop(key)
