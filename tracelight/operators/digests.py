"""Digest trees of tables: one digest that proves a row set, and the place where two row sets differ.

Rows are digested and dealt to buckets by the first digits of their digest, so buckets are even whatever the keys
are. Copies of a row are counted before they move. A leaf digests the sorted digests and counts of its bucket, an inner
node its up to sixteen children in order. Digests are never added up, so no rows can cancel each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.session import stored

DIGITS = 16


def row_text(columns: Sequence[str]) -> Column:
    """Text of a row that no other row has: every value with its length, nulls as a dash."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat_ws(",", *[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def tree_depth(rows: int, bucket_rows: int = 1024) -> int:
    """Digits of the leaf buckets so that a bucket holds about ``bucket_rows`` rows or fewer."""
    return max(1, math.ceil(math.log(max(rows, 1) / bucket_rows, DIGITS))) if rows > bucket_rows else 1


def digest_tree(rows: DataFrame, columns: Sequence[str], depth: int) -> DataFrame:
    """Nodes (level, bucket, row_count, digest); level 0 is the root, an empty table has no nodes.

    The order of the rows and the cut of the table do not matter; the order of ``columns`` does.
    """
    own = rows.select(F.sha2(row_text(columns), 256).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("*", "d", F.col("n").cast("string"))
    leaves = own.groupBy(F.substring("d", 1, depth).alias("bucket")).agg(
        F.sum("n").alias("row_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("digest")
    )
    level = stored(leaves, "digest-leaves")
    nodes = level.select(F.lit(depth).alias("level"), "bucket", "row_count", "digest")
    for above in range(depth - 1, -1, -1):
        parent = F.substring("bucket", 1, above) if above else F.lit("")
        entry = F.concat_ws("*", "bucket", "digest")
        level = level.groupBy(parent.alias("parent")).agg(
            F.sum("row_count").alias("row_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("digest")
        ).withColumnRenamed("parent", "bucket")
        nodes = nodes.unionByName(level.select(F.lit(above).alias("level"), "bucket", "row_count", "digest"))
    return nodes


def tree_difference(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """Leaf buckets that differ, with the rows of each side: only children of nodes that differ are compared.

    Both trees must have the depth ``depth``. A bucket that one side lacks counts no rows there.
    """

    def side(tree: DataFrame, level: int, tag: str) -> DataFrame:
        return tree.where(F.col("level") == level).select(
            "bucket", F.col("row_count").alias(f"{tag}_rows"), F.col("digest").alias(f"_{tag}")
        )

    changed = None
    for level in range(depth + 1):
        pairs = []
        for tree, tag in ((left, "left"), (right, "right")):
            nodes = side(tree, level, tag)
            if changed is not None:
                parent = F.substring("bucket", 1, level - 1) if level > 1 else F.lit("")
                nodes = nodes.withColumn("_parent", parent).join(changed.select(F.col("bucket").alias("_parent")), "_parent", "left_semi").drop("_parent")
            pairs.append(nodes)
        both = pairs[0].join(pairs[1], "bucket", "full").where(~F.col("_left").eqNullSafe(F.col("_right")))
        changed = stored(both, "digest-changes")
    return changed.select("bucket", *[F.coalesce(f"{t}_rows", F.lit(0)).alias(f"{t}_rows") for t in ("left", "right")])


def changed_rows(left: DataFrame, right: DataFrame, columns: Sequence[str], changed: DataFrame, depth: int) -> DataFrame:
    """Rows of the changed buckets that one side has more often: ``side`` and the columns."""

    def some(rows: DataFrame, sign: int) -> DataFrame:
        bucket = F.substring(F.sha2(row_text(columns), 256), 1, depth)
        near = rows.select(*columns, bucket.alias("bucket")).join(changed.select("bucket"), "bucket", "left_semi")
        return near.select(*columns, F.lit(sign).alias("_sign"))

    balance = some(left, 1).unionByName(some(right, -1)).groupBy(*columns).agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")
    return balance.select(F.when(F.col("_sign") > 0, "left").otherwise("right").alias("side"), *columns)
