"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A classifier learned from a labelled table gives every document a posterior over the domains. Rates r,
one nonnegative number per document, are then fitted so that the expected tokens of each domain,
sum(r * tokens * posterior), meet the targets: projected-gradient steps on the weighted squared error,
starting from r = 1. A step needs one number per domain from all documents, and a document's rate follows
from its own posterior and the steps so far, so no rate table is rewritten between steps.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import bounded_sample, stored, with_column

BUCKETS = 1 << 16  # so many rows the broadcast model has at most
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡。，、"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words between white space, with the signs beside them."""
    return F.split(F.translate(text, "\n\t\r\x0b\x0c", " " * 5), " ")


def features(word: Column) -> Column:
    """Array of the hashed features of a word: the word without signs at its ends, and its last sign.

    Null stands where there is none, as for the word ``--``. Only words with a sign at an end are trimmed.
    """
    first, last = F.ascii(word), F.ascii(F.right(word, F.lit(1)))
    plain = lambda c: (
        c.between(97, 122) | c.between(65, 90) | c.between(48, 57) | c.between(0xC0, 0x1FFF) | c.between(0x3040, 0xD7FF)
    )
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    bare = F.btrim(word, F.lit(SIGNS))
    bare = F.when(bare != "", bucket(bare))
    sign = F.when((last < 128) & (word != ""), bucket(F.concat(F.lit(" "), F.right(word, F.lit(1)))))
    ended = F.when(plain(first), F.array(bucket(word))).otherwise(F.array(bare))
    return F.when(plain(last), ended).otherwise(F.array(bare, sign))


def word_buckets(text: Column) -> Column:
    """Array of the distinct features of a text."""
    each = F.transform(F.array_distinct(words_of(text)), features)
    return F.array_compact(F.array_distinct(F.flatten(each)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


@dataclass
class Model:
    domains: list[str]
    bias: list[float]
    weights: DataFrame  # bucket, w: array of one weight per domain

    def posterior(self) -> list[Column]:
        """Softmax over the domains from the columns s0, s1, ... (null without known features)."""
        return softmax([F.lit(b) + F.coalesce(f"s{k}", F.lit(0.0)) for k, b in enumerate(self.bias)])


def softmax(scores: list[Column]) -> list[Column]:
    high = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - high) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def evidence(rows: DataFrame, group: list[str], text_col: str, weights: DataFrame, n: int) -> DataFrame:
    """Sum of the weights of the distinct known features of each group of rows: columns s0, s1, ..."""
    each = rows.select(*group, F.explode(words_of(F.col(text_col))).alias("word"))
    each = each.select(*group, F.explode(features(F.col("word"))).alias("bucket"))
    known = each.join(F.broadcast(weights.select("bucket")), "bucket").groupBy(*group, "bucket").agg(F.count(F.lit(1)))
    known = known.join(F.broadcast(weights), "bucket")
    return known.groupBy(*group).agg(*[F.sum(F.get("w", F.lit(k))).alias(f"s{k}") for k in range(n)])


def learn(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    id_col: str,
    text_col: str,
    domain_col: str,
    fit_rows: int = 4000,
    features: int = 256,
    penalty: float = 0.003,
) -> Model:
    """Multinomial logistic regression on the presence of hashed words.

    Learns from at most ``fit_rows`` labelled rows (smallest hashes of the id), with the ``features``
    buckets whose counts deviate most, in standard errors, from the domain shares.
    """
    n = len(domains)
    known = labelled.where(F.col(domain_col).isin(domains) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain"))
    known = bounded_sample(known, "id", fit_rows)  # so it may be broadcast
    rows = keyed(docs, id_col, text_col).join(F.broadcast(known), "id")
    rows = rows.select("domain", word_buckets(F.col("text")).alias("buckets"))
    rows = stored(rows, "mixing-labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    share = [(sizes.get(d, 0) + 1) / (total + n) for d in domains]
    counts = rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("int")).alias(f"c{k}") for k, d in enumerate(domains)]
    )
    away = [F.abs(F.col(f"c{k}") - F.col("n") * s) / F.sqrt(F.col("n") * s * (1 - s)) for k, s in enumerate(share)]
    ranked = counts.where("n >= 5").orderBy(F.desc(F.greatest(*away) if n > 1 else away[0]), "bucket").limit(features)
    chosen = sorted(r["bucket"] for r in ranked.select("bucket").collect())
    schema = "bucket int, w array<double>"
    if len(sizes) < 2 or not chosen:
        return Model(domains, [float(np.log(s)) for s in share], docs.sparkSession.createDataFrame([], schema))
    has = F.transform(F.array(*map(F.lit, chosen)), lambda b: F.array_contains("buckets", b).cast("double"))
    index = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    table = rows.select(array_to_vector(has).alias("features"), index.cast("double").alias("label"))
    fitted = LogisticRegression(
        family="multinomial", regParam=penalty, elasticNetParam=0.5, standardization=False, maxIter=40
    ).fit(table)
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = np.zeros((n, len(chosen)))
    weights[: len(matrix)] = matrix  # domains after the last one seen keep zero weights
    intercepts = np.log(share)
    intercepts[: len(bias)] = bias
    kept = [(b, [float(v) for v in w]) for b, w in zip(chosen, weights.T) if np.abs(w).max() > 0]
    return Model(domains, [float(v) for v in intercepts], docs.sparkSession.createDataFrame(kept, schema))


def posteriors(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, key, tokens, rows, p0, p1, ...), one row per distinct id and text; ``rows``: how often it occurs."""
    n = len(model.domains)
    own = keyed(docs, id_col, text_col)
    sums = evidence(own, ["id", "key"], "text", model.weights, n)
    sums = sums.select(F.col("id").alias("_id"), F.col("key").alias("_key"), *[f"s{k}" for k in range(n)])
    sizes = own.select("id", "key", tokens_of(F.col("text")).alias("tokens"))
    sizes = sizes.groupBy("id", "key", "tokens").agg(F.count(F.lit(1)).alias("rows"))
    both = sizes.join(sums, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return both.select("id", "key", "tokens", "rows", *[p.alias(f"p{k}") for k, p in enumerate(model.posterior())])


def rate(steps: list[np.ndarray], n: int) -> Column:
    """A document's rate after the given gradient steps, each a number per domain."""
    r: Column = F.lit(1.0)
    for step in steps:
        move = sum((F.lit(float(step[k])) * F.col(f"p{k}") for k in range(n)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - move)
    return r


def fit_rates(posts: DataFrame, targets: list[float], budget: float | None, steps: int = 25, close: float = 1e-4) -> list[np.ndarray]:
    """Projected-gradient steps that bring expected domain tokens to ``targets`` of the token budget.

    The squared error is weighted by the inverse of the token-weighted second moments of the
    posteriors of documents with a positive rate, so a unit step would end it if no further rate met
    zero. After a step that did not lower the error, the moments of all documents are used, for which
    the unit step is never too long. Targets that ``steps`` steps do not bring within ``close`` of the
    budget, such as those of a domain no document belongs to, are named in a warning.
    """
    n = len(targets)
    weight = F.col("tokens") * F.col("rows")
    goal = np.array(targets, float) / sum(targets)
    taken: list[np.ndarray] = []
    everyone, total, before = None, 0.0, np.inf
    while True:
        r = rate(taken, n)
        active = weight * (r > 0).cast("int")
        moments = [F.sum(active * F.col(f"p{j}") * F.col(f"p{k}")) for j in range(n) for k in range(n)]
        sums = posts.agg(F.sum(weight), *[F.sum(weight * r * F.col(f"p{k}")) for k in range(n)], *moments).first()
        total = float(sums[0] or 0)
        if total <= 0:
            return []
        error = np.array([float(v) for v in sums[1 : n + 1]]) / total - goal * (budget or total) / total
        gram = np.array([float(v) for v in sums[n + 1 :]]).reshape(n, n) / total + 1e-9 * np.eye(n)
        everyone = gram if everyone is None else everyone
        now = float(np.abs(error).max())
        if now < close:
            return taken
        if len(taken) == steps:
            missed = ", ".join(f"{g + e:.4f} for {g:.4f}" for g, e in zip(goal * (budget or total) / total, error))
            warnings.warn(f"domain shares after {steps} steps: {missed}", stacklevel=2)
            return taken
        taken.append(np.linalg.solve(gram if now < before else everyone, error))
        before = now


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    budget: float | None = None,
    **options,
) -> DataFrame:
    """One row per distinct id and text: id, key, n_tokens, p_<domain> for each domain, rate.

    ``labelled`` has ids and domains; ``targets`` the share of the budget (all tokens by default) each
    domain shall have. A rate is the expected number of times a document is read. Null and empty
    texts have no tokens and the prior as posterior; null ids are kept; repeated rows count with
    their number and get one rate; without labels all posteriors are equal; an empty table gives an
    empty result; other columns are not read.
    """
    domains = sorted(targets)
    model = learn(docs, labelled, domains, id_col, text_col, domain_col, **options)
    posts = stored(posteriors(docs, model, id_col, text_col), "mixing-posteriors")
    steps = fit_rates(posts, [targets[d] for d in domains], budget)
    return posts.select(
        F.col("id").alias(id_col), "key", F.col("tokens").alias("n_tokens"),
        *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)],
        rate(steps, len(domains)).alias("rate"),
    )


def with_rates(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their rate; documents of rate 0 go."""
    tagged, key = with_column(docs, "_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    name = with_column(docs, "sampling_rate", F.lit(0))[1]
    own = rates.where("rate > 0").select(F.col(id_col).alias("_id"), F.col("key").alias("_key"), F.col("rate").alias("_rate"))
    own = own.alias("own")
    same = F.col(f"docs.{id_col}").eqNullSafe(F.col("own._id")) & (F.col(f"docs.{key}") == F.col("own._key"))
    both = tagged.alias("docs").join(own, same)
    return both.select(*[F.col(f"docs.`{c}`") for c in docs.columns], F.col("own._rate").alias(name))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic before poor or good quality; rows without labels go."""
    toxic, quality = F.col("toxic") == 1, F.col("quality")
    domain = F.when(toxic, "toxic").when(quality == 1, "good").when(quality == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")
