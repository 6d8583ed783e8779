"""Digest trees find what changed, and total orders hold through floods of equal keys."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracelight.operators import digests
from tracelight.operators.ranking import range_ranked

COLUMNS = ["k", "v"]


def tree(df, depth=2):
    return digests.digest_tree(df, COLUMNS, depth)


def root(df):
    row = tree(df).where("level = 0").first()
    return row and (row["row_count"], row["digest"])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v")).cache()


def test_order_and_cut_do_not_matter_but_rows_do(spark, rows):
    assert root(rows) == root(rows.orderBy(F.desc("k")).repartition(5)) and root(rows)[0] == 3000
    assert root(rows.union(rows.limit(1)))[1] != root(rows)[1]
    assert root(rows.where("false")) is None
    one, two = ([("a", None)], [("a", "-")])
    schema = "k string, v string"
    assert root(spark.createDataFrame(one, schema)) != root(spark.createDataFrame(two, schema))
    assert root(spark.createDataFrame([("a,1:b", "c")], schema)) != root(spark.createDataFrame([("a", "1:b,c")], schema))


def test_leaves_match_plain_digests(rows):
    leaf = tree(rows, 1).where("level = 1 AND bucket = 'a'").first()
    own = [hashlib.sha256(f"{len(str(k))}:{k},1:{k % 7}".encode()).hexdigest() for k in range(3000)]
    mine = sorted(f"{d}*1" for d in own if d[0] == "a")
    assert leaf["row_count"] == len(mine) and leaf["digest"] == hashlib.sha256(",".join(mine).encode()).hexdigest()


def test_a_changed_row_is_located(rows):
    other = rows.withColumn("v", F.when(F.col("k") == 1234, "x").otherwise(F.col("v")))
    found = digests.tree_difference(tree(rows), tree(other), 2)
    assert 1 <= found.count() <= 2
    changed = digests.changed_rows(rows, other, COLUMNS, found, 2).collect()
    assert sorted((r["side"], r["k"], r["v"]) for r in changed) == [("left", 1234, "2"), ("right", 1234, "x")]
    assert digests.tree_difference(tree(rows), tree(rows.repartition(3)), 2).count() == 0
    gone = digests.tree_difference(tree(rows), tree(rows.where("false")), 2)
    assert gone.agg(F.sum("left_rows"), F.sum("right_rows")).first()[:] == (3000, 0)


def test_rows_that_cancel_in_a_sum_are_seen(rows):
    """Two rows exchange their values, and a row is removed while another comes twice: counts and sums stay."""
    swapped = rows.withColumn("v", F.when(F.col("k") == 8, "2").when(F.col("k") == 9, "1").otherwise(F.col("v")))
    doubled = rows.where("k <> 5").union(rows.where("k = 6"))
    assert len({root(rows)[1], root(swapped)[1], root(doubled)[1]}) == 3
    copies = rows.limit(1).crossJoin(rows.sparkSession.range(5000)).select(*COLUMNS)  # one hot row
    assert root(copies)[0] == 5000 and digests.tree_depth(3000) == 1 and digests.tree_depth(10**9) == 5


def test_total_order_of_a_flood(spark):
    flood = spark.range(40000).select(F.lit(7).alias("t"), F.xxhash64("id").alias("u"), "id").union(spark.sql("SELECT 3, 0L, -1L"))
    ranked = range_ranked(flood, ["t", "u", "id"])
    got = [r["id"] for r in ranked.orderBy("place").collect()]
    want = sorted(((r["t"], r["u"], r["id"]) for r in flood.collect()))
    assert got == [i for *_, i in want] and [r["place"] for r in ranked.orderBy("place").collect()] == list(range(1, 40002))
    assert ranked.columns == ["t", "u", "id", "place"] and range_ranked(flood.where("false"), ["t"]).count() == 0
