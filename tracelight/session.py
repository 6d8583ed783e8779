"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tracelight", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; a cluster's own settings stay in force."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


# Merging scalar subqueries while stages are planned adaptively gave values that changed from run to
# run in Spark 4.1.2, when the merged plan occurred more than once in a query.
UNSAFE_RULE = "org.apache.spark.sql.catalyst.optimizer.MergeScalarSubqueries"


_SHIPPED: set[str] = set()


def package_archive(folder: str) -> str:
    """This package as a zip file in ``folder``, from which Python can import it."""
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(folder, "tracelight.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(at, name)
                out.write(path, os.path.join("tracelight", os.path.relpath(path, home)))
    return archive


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    spark.sparkContext.addPyFile(package_archive(tempfile.mkdtemp(prefix="tracelight-")))  # Spark serves it from the driver


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package and sets the runtime options results depend on: UTC calendar arithmetic, no
    subquery merging."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    excluded = spark.conf.get("spark.sql.optimizer.excludedRules", None) or ""
    if UNSAFE_RULE not in excluded:
        rules = ",".join(r for r in (excluded, UNSAFE_RULE) if r)
        spark.conf.set("spark.sql.optimizer.excludedRules", rules)
    return spark


def shared_directory(spark: SparkSession, purpose: str) -> str:
    """New, unused path for intermediate tables, below the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset (local tests)
    is a machine-local folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="tracelight-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back: several readers, or a lost executor, cost a read."""
    path = shared_directory(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
