"""Connected components of a link table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; the root is the smallest node that can be reached.

    Links, labels and changes stay distributed; each round is written to the shared folder, and only
    the number of changed labels reaches the driver. A node with very many links is an ordinary group
    of a map-side combined minimum.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(pairs.union(pairs.select("other", "node")).where("node <> other").distinct(), "links")
    labels = both.groupBy("node").agg(F.min("other").alias("low"))
    labels = stored(labels.select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        ends = labels.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        low = both.join(ends, "other").groupBy("node").agg(F.min("seen").alias("low"))
        step = labels.join(low, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "low").alias("now")
        )
        up = step.select(F.col("node").alias("now"), F.col("now").alias("top"))
        moved = stored(step.join(up, "now").select("node", "was", F.col("top").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("was <> root").isEmpty():
            return labels
