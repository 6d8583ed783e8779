"""From raw documents to a training mixture, stage by stage.

Every stage gets what the one before it kept, written as Parquet and read again. Rows with null ids or
texts pass or go by the rules of the operators they meet; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import decontaminate, language, mixing, quality, simhash
from tracelight.llm.common import read, stored, with_column

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Shares of the tokens after poor documents have gone.
TARGETS = {"good": 0.95, "toxic": 0.05}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with a posterior of at least one half stay."""
    model = language.fit(docs)
    told, name = with_column(docs, "language", language.predicted(docs, model))
    sure = (F.col(f"{name}.lang_pred") != language.UNDETERMINED) & (F.col(f"{name}.score") >= 0.5)
    return told.where(sure).drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier scores 0.7 or more stay."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    told, name = with_column(docs, "quality", quality.scored(docs, model))
    return told.where(F.col(name) >= 0.7).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark stay."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate, ``sampling_rate``, that brings the domains to their target shares."""
    labelled = mixing.label_domains(read(spark, sf_dir, "labels"))
    return mixing.with_rates(docs, mixing.mix(docs, labelled, TARGETS))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("mixing", mixed),
]

#: Learned scores and reachability are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
