"""Registry of queries: Spark plan, comparison SQL and the inventory rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracelight.session import prepare, shared_directory

_STORED: dict[tuple[str, str, str], str] = {}


def forget() -> None:
    """Derived tables are built anew at their next use."""
    _STORED.clear()


class Tables:
    """Lazy access to the tables of one folder: ``tables.events`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def stored(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """A derived table, written to the shared folder at first use and read from there after.

        Tables that several steps read (windows, scaled rows, received batches) are cut off this way:
        the raw records are scanned once, and a lost executor costs a read, not the whole lineage.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = shared_directory(self.spark, name)
            build(self).write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a plan under ``name`` for the inventory ids in ``covers``."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), plan, sql)
        return plan

    return register


def load() -> dict[str, Query]:
    from tracelight.plans import (  # noqa: F401
        cases,
        dataset,
        evaluation,
        evidence,
        federation,
        learning,
        scans,
        streams,
        vectors,
    )

    return REGISTRY
