"""Queries on update vectors, robust aggregation and class prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import vectors as V
from tracelight.operators import prototypes as P
from tracelight.operators import robust as R
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.standins import with_parts

FAULTY = 3


@query(
    "g1_model_deltas",
    "G1",
    with_parts(
        "delta",
        "SELECT client_id, pos, round(v,9) AS delta, round(base+v,9) AS applied, num_examples FROM delta",
    ),
)
def model_deltas(t: Tables):
    updates = X.build_updates(t)
    restored = V.flatten_tensors(V.restore_tensors("delta", [32, 24, 8]))
    both = updates.select(
        "client_id",
        "num_examples",
        F.posexplode(F.arrays_zip(restored.alias("d"), V.add("base", "delta").alias("a"))).alias("pos", "x"),
    )
    return both.select(
        "client_id",
        "pos",
        F.round("x.d", 9).alias("delta"),
        F.round("x.a", 9).alias("applied"),
        "num_examples",
    )


X.define("norms", "SELECT client_id, sqrt(sum(v*v)) AS norm FROM delta GROUP BY client_id", "delta")
X.define(
    "limitv",
    "SELECT med, mad, CASE WHEN med+3*mad>0 THEN med+3*mad ELSE greatest(top,1e-12) END AS max_norm FROM (SELECT (SELECT median(norm) FROM norms) AS med, (SELECT median(abs(norm-(SELECT median(norm) FROM norms))) FROM norms) AS mad, (SELECT max(norm) FROM norms) AS top)",
    "norms",
)


@query("g2_delta_norms", "G2", with_parts("norms", "SELECT client_id, round(norm,9) AS delta_l2 FROM norms"))
def delta_norms(t: Tables):
    return X.client_updates(t).select("client_id", F.round(V.l2_norm("delta"), 9).alias("delta_l2"))


@query(
    "g3_clipped_deltas",
    "G3",
    with_parts(
        "limitv norms",
        "SELECT d.client_id, d.pos, round(CASE WHEN n.norm<=l.med OR n.norm=0 THEN 1.0 ELSE l.med/n.norm END,9) AS clip_scale, round(d.v*CASE WHEN n.norm<=l.med OR n.norm=0 THEN 1.0 ELSE l.med/n.norm END,9) AS value FROM delta d JOIN norms n USING (client_id), limitv l",
    ),
)
def clipped_deltas(t: Tables):
    updates = X.client_updates(t)
    limit = R.clip_threshold(updates, "delta").select("median_l2").scalar()
    clipped = R.clip_updates(updates, "delta", limit)
    long = V.coordinates(clipped, ["client_id", "clip_scale"], "delta")
    return long.select(
        "client_id", "pos", F.round("clip_scale", 9).alias("clip_scale"), F.round("value", 9).alias("value")
    )


@query(
    "g4_clip_threshold",
    "G4",
    with_parts(
        "limitv",
        "SELECT round(med,9) AS median_l2, round(mad,9) AS mad_l2, round(max_norm,9) AS max_norm FROM limitv",
    ),
)
def clip_threshold(t: Tables):
    out = R.clip_threshold(X.client_updates(t), "delta")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _aggregate(strategy: str, weight: str | None = None, f: int = FAULTY, keep: int | None = None):
    def plan(t: Tables):
        out = R.aggregate_updates(
            X.client_updates(t), "delta", strategy, clients=X.CLIENTS, f=f, weight=weight, keep=keep
        )
        return out.select("pos", F.round("value", 9).alias("value"))

    return plan


query(
    "g5_weighted_mean",
    "G5",
    with_parts("delta", "SELECT pos, round(sum(v*num_examples)/sum(num_examples),9)+0.0 AS value FROM delta GROUP BY pos"),
)(
    lambda t: R.aggregate_updates(
        X.client_updates(t), "delta", "fedavg", clients=X.CLIENTS, weight="num_examples"
    ).select("pos", (F.round("value", 9) + 0.0).alias("value"))
)
query(
    "g6_coordinate_median",
    "G6",
    with_parts("delta", "SELECT pos, round(median(v),9) AS value FROM delta GROUP BY pos"),
)(_aggregate("coordinate_median"))
query(
    "g7_trimmed_mean",
    "G7",
    with_parts(
        "delta",
        "SELECT pos, round(avg(v),9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY v) AS r FROM delta) WHERE r>3 AND r<=12 GROUP BY pos",
    ),
)(_aggregate("trimmed_mean"))

X.define(
    "pairs",
    "SELECT a.client_id AS a, b.client_id AS b, sum((a.v-b.v)*(a.v-b.v)) AS d FROM delta a JOIN delta b ON a.pos=b.pos AND a.client_id<>b.client_id GROUP BY 1,2",
    "delta",
)
X.define(
    "krum",
    "SELECT a AS client_id, sum(d) AS score, row_number() OVER (ORDER BY sum(d), a) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM pairs) WHERE r<=10 GROUP BY a",
    "pairs",
)


@query(
    "g8_krum_scores",
    "G8 J10 W12",
    with_parts("krum", "SELECT client_id, round(score,9) AS krum_score FROM krum"),
)
def krum_scores(t: Tables):
    out = R.krum_scores(X.client_updates(t), "delta", f=FAULTY, clients=X.CLIENTS)
    return out.withColumn("krum_score", F.round("krum_score", 9))


@query(
    "g8_krum_scores_tiled",
    "G8 J10 W12",
    with_parts("krum", "SELECT client_id, round(score,9) AS krum_score FROM krum"),
)
def krum_scores_tiled(t: Tables):
    out = R.krum_scores(X.client_updates(t), "delta", f=FAULTY, clients=X.CLIENTS, tile_rows=4)
    return out.withColumn("krum_score", F.round("krum_score", 9))


query(
    "g9_multikrum",
    "G9",
    with_parts(
        "krum",
        "SELECT pos, round(avg(v),9) AS value FROM delta JOIN krum USING (client_id) WHERE place<=10 GROUP BY pos",
    ),
)(_aggregate("multikrum"))
query(
    "g10_bulyan",
    "G10",
    with_parts(
        "krum",
        """SELECT pos, round(avg(v),9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY abs(v-m), place) AS r
      FROM (SELECT d.*, k.place, median(v) OVER (PARTITION BY pos) AS m FROM delta d JOIN krum k USING (client_id) WHERE place<=9)) WHERE r<=3 GROUP BY pos""",
    ),
)(_aggregate("bulyan"))

X.define(
    "medv",
    "SELECT *, median(abs(v-m)) OVER (PARTITION BY pos) AS mad FROM (SELECT *, median(v) OVER (PARTITION BY pos) AS m FROM delta)",
    "delta",
)


@query(
    "g11_update_indicators",
    "G11",
    with_parts(
        "medv",
        """SELECT client_id, round(n,7) AS delta_l2, round(n/median(n) OVER (),7) AS relative_norm, round(c,7) AS cosine_to_median,
      round(dist,7) AS coordinate_median_distance, round(s,7) AS mad_score FROM
      (SELECT client_id, sqrt(sum(v*v)) AS n, sum(v*m)/(sqrt(sum(v*v))*sqrt(sum(m*m))) AS c, sqrt(sum((v-m)*(v-m))) AS dist,
        median(abs(v-m)/greatest(mad,1e-12)) AS s FROM medv GROUP BY client_id)""",
    ),
)
def update_indicators(t: Tables):
    out = R.update_indicators(X.client_updates(t), "delta")
    return out.select("client_id", *[F.round(c, 7).alias(c) for c in out.columns if c != "client_id"])


def colluding_updates(t: Tables):
    """Documents as update contents: exact copies play the colluding clients."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("client_id"),
        F.transform(F.split(F.col("text"), " "), lambda w: F.length(w).cast("double")).alias("vector"),
    )


@query(
    "g12_duplicate_updates",
    "G12",
    """SELECT CAST(doc_id AS VARCHAR) AS client_id, count(*) OVER (PARTITION BY list_transform(string_split(text,' '), lambda w: length(w))) AS group_size FROM documents""",
)
def duplicate_updates(t: Tables):
    return R.duplicate_updates(colluding_updates(t), "vector").select("client_id", "group_size")


@query(
    "g12_duplicate_update_summary",
    "G12",
    """SELECT count(*) AS unique_update_count, count(*) FILTER (n>1) AS exact_duplicate_group_count, max(CASE WHEN n>1 THEN n ELSE 0 END) AS largest_group_size
    FROM (SELECT list_transform(string_split(text,' '), lambda w: length(w)) AS v, count(*) AS n FROM documents GROUP BY 1)""",
)
def duplicate_update_summary(t: Tables):
    return R.duplicate_summary(R.duplicate_updates(colluding_updates(t), "vector"))


MIN_SUPPORT = 2
X.define(
    "proto",
    "SELECT client_id, class, pos, avg(v) AS v, count(*) AS support FROM veclong GROUP BY 1,2,3 HAVING count(*)>=2",
    "veclong",
)


def local_prototypes(t: Tables):
    return P.local_prototypes(X.vectors(t), "vector", X.WIDTH, MIN_SUPPORT, X.CLASSES)


@query(
    "g13_class_prototypes",
    "G13",
    with_parts("proto", "SELECT client_id, class, support, pos, round(v,9) AS value FROM proto"),
)
def class_prototypes(t: Tables):
    protos, _ = local_prototypes(t)
    long = V.coordinates(protos, ["client_id", "class", "support"], "vector")
    return long.withColumn("value", F.round("value", 9))


@query(
    "g13_class_supports",
    "G13",
    with_parts(
        "vec",
        """SELECT c.client_id, k.class, count(vec.vec_id) AS support FROM (SELECT DISTINCT client_id FROM vec) c
      CROSS JOIN (SELECT unnest(range(10))::INTEGER AS class) k LEFT JOIN vec ON vec.client_id=c.client_id AND vec.class=k.class GROUP BY 1,2""",
    ),
)
def class_supports(t: Tables):
    return local_prototypes(t)[1].select("client_id", "class", "support")


def _aggregate_sql(value: str, quorum: int) -> str:
    return f"""SELECT k.class, CASE WHEN coalesce(n,0)>={quorum} THEN 'aggregated' ELSE 'insufficient_quorum' END AS status,
      coalesce(n,0) AS supporting_client_count, coalesce(s,0)::BIGINT AS total_support, pos, round(a,9) AS value
    FROM (SELECT unnest(range(10))::INTEGER AS class) k LEFT JOIN (SELECT class, count(*) AS n, sum(support) AS s FROM proto WHERE pos=0 GROUP BY class) c ON c.class=k.class
      LEFT JOIN (SELECT class, pos, {value} AS a FROM proto GROUP BY class, pos) v ON v.class=k.class AND n>={quorum}"""


def _dense_long(aggregated):
    """Long rows of every class; a class without a vector keeps one row with position -1."""
    cells = F.explode_outer(
        F.transform("vector", lambda x, i: F.struct(i.alias("pos"), x.alias("value")))
    )
    rows = aggregated.select(
        "class", "status", "supporting_client_count", "total_support", cells.alias("_c")
    )
    return rows.select(
        "class",
        "status",
        "supporting_client_count",
        "total_support",
        F.coalesce("_c.pos", F.lit(-1)).alias("pos"),
        F.coalesce(F.round("_c.value", 9), F.lit(0.0)).alias("value"),
    )


QUORUM = 8


@query(
    "g14_prototype_weighted_mean",
    "G14",
    with_parts(
        "proto",
        "SELECT class, status, supporting_client_count, total_support, coalesce(pos,-1)::INTEGER AS pos, coalesce(value,0.0) AS value FROM ("
        + _aggregate_sql("sum(v*support)/sum(support)", QUORUM)
        + ")",
    ),
)
def prototype_weighted_mean(t: Tables):
    protos, _ = local_prototypes(t)
    return _dense_long(
        P.aggregate_prototypes(
            protos, X.CLASSES, strategy="support_weighted_mean", quorum=QUORUM, width=X.WIDTH
        )
    )


@query(
    "g14_prototype_median",
    "G14",
    with_parts(
        "proto",
        "SELECT class, status, supporting_client_count, total_support, coalesce(pos,-1)::INTEGER AS pos, coalesce(value,0.0) AS value FROM ("
        + _aggregate_sql("median(v)", 12)
        + ")",
    ),
)
def prototype_median(t: Tables):
    protos, _ = local_prototypes(t)
    return _dense_long(
        P.aggregate_prototypes(
            protos, X.CLASSES, strategy="coordinate_median", quorum=12, width=X.WIDTH
        )
    )


@query(
    "g15_prototype_carry_forward",
    "G15",
    with_parts(
        "veclong",
        """SELECT k.class, CASE WHEN n>=14 THEN 'aggregated' WHEN p.v IS NOT NULL THEN 'retained_previous' ELSE 'unavailable' END AS status,
      coalesce(n,0) AS supporting_client_count, coalesce(s,0)::BIGINT AS total_support,
      coalesce(k.pos,-1)::INTEGER AS pos, round(CASE WHEN n>=14 THEN a.v ELSE p.v END,9) AS value
    FROM (SELECT DISTINCT class, pos FROM veclong) k
    LEFT JOIN (SELECT class, pos, count(*) AS n, sum(support) AS s, sum(v*support)/sum(support) AS v FROM
      (SELECT client_id, class, pos, avg(v) AS v, count(*) AS support FROM veclong GROUP BY 1,2,3 HAVING count(*)>=3) GROUP BY 1,2) a USING (class,pos)
    LEFT JOIN (SELECT class, pos, avg(v) AS v FROM veclong WHERE split='train' AND class<>4 GROUP BY 1,2) p USING (class,pos)
    WHERE n>=14 OR p.v IS NOT NULL
    UNION ALL SELECT k.class, 'unavailable', coalesce(n,0), coalesce(s,0)::BIGINT, -1, 0.0 FROM (SELECT 4 AS class) k
    LEFT JOIN (SELECT class, count(*) AS n, sum(support) AS s FROM (SELECT client_id, class, count(*) AS support FROM vec GROUP BY 1,2 HAVING count(*)>=3) GROUP BY 1) a USING (class)
    WHERE coalesce(n,0)<14""",
    ),
)
def prototype_carry_forward(t: Tables):
    rows = X.vectors(t)
    protos, _ = P.local_prototypes(rows, "vector", X.WIDTH, 1, X.CLASSES)
    now = P.aggregate_prototypes(
        protos,
        X.CLASSES,
        strategy="support_weighted_mean",
        quorum=14,
        width=X.WIDTH,
        minimum_support=3,
        skip_low_support=True,
    )
    old = V.mean_vector(
        rows.where("split = 'train' AND class <> 4"), ["class"], "vector", "vector", X.WIDTH
    )
    return _dense_long(P.carry_forward(now, old))


X.define(
    "protomed",
    "SELECT *, median(abs(v-m)) OVER (PARTITION BY class,pos) AS mad FROM (SELECT *, median(v) OVER (PARTITION BY class,pos) AS m FROM proto)",
    "proto",
)


@query(
    "g16_prototype_indicators",
    "G16",
    with_parts(
        "protomed",
        """SELECT client_id, class, support, round(d,7) AS distance_to_coordinate_median,
      round(d/greatest(median(d) OVER (PARTITION BY class),1e-12),7) AS relative_distance, round(s,6) AS mad_score FROM
      (SELECT client_id, class, support, sqrt(sum((v-m)*(v-m))) AS d, median(abs(v-m)/greatest(mad,1e-12)) AS s FROM protomed GROUP BY 1,2,3)""",
    ),
)
def prototype_indicators(t: Tables):
    out = P.prototype_indicators(local_prototypes(t)[0])
    return out.select(
        "client_id",
        "class",
        "support",
        F.round("distance_to_coordinate_median", 7).alias("distance_to_coordinate_median"),
        F.round("relative_distance", 7).alias("relative_distance"),
        F.round("mad_score", 6).alias("mad_score"),
    )


# Prototypes of the training rows, and the distance of every row to each of them.
X.define("cent", "SELECT class, pos, avg(v) AS c FROM veclong WHERE split='train' GROUP BY 1,2", "veclong")
X.define(
    "dist",
    "SELECT vec_id, v.client_id, v.class AS actual, v.split, c.class AS proto, sqrt(sum((v.v-c.c)*(v.v-c.c))) AS d FROM veclong v JOIN cent c USING (pos) GROUP BY 1,2,3,4,5",
    "veclong cent",
)
X.define(
    "near",
    """SELECT vec_id, client_id, actual, split, min(proto) FILTER (r=1) AS predicted, min(d) FILTER (r=1) AS nearest_distance, min(proto) FILTER (r=2) AS second_class,
    min(d) FILTER (r=2)-min(d) FILTER (r=1) AS distance_margin, min(r) FILTER (proto=actual) AS actual_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, proto) AS r FROM dist) GROUP BY 1,2,3,4""",
    "dist",
)


def train_prototypes(t: Tables):
    return V.mean_vector(
        X.vectors(t).where("split = 'train'"), ["class"], "vector", "vector", X.WIDTH
    )


def predictions(t: Tables):
    """Rows with the class of the nearest training prototype as prediction."""
    near = P.nearest_prototypes(X.vectors(t), train_prototypes(t), "vector")
    return near.withColumnRenamed("nearest_class", "predicted").withColumnRenamed("class", "actual")


NEAR_SQL = """SELECT vec_id, predicted, second_class, round(nearest_distance,8) AS nearest_distance, round(distance_margin,8) AS distance_margin FROM near"""


@query("g17_nearest_prototypes", "G17 J11", with_parts("near", NEAR_SQL))
def nearest_prototypes(t: Tables):
    return predictions(t).select(
        "vec_id",
        "predicted",
        "second_class",
        F.round("nearest_distance", 8).alias("nearest_distance"),
        F.round("distance_margin", 8).alias("distance_margin"),
    )


@query("g17_nearest_prototypes_tiled", "G17 J11", with_parts("near", NEAR_SQL))
def nearest_prototypes_tiled(t: Tables):
    near = P.nearest_indexed(X.vectors(t), train_prototypes(t), "vector", "vec_id", size=2)
    return near.select(
        "vec_id",
        F.col("nearest_class").alias("predicted"),
        "second_class",
        F.round("nearest_distance", 8).alias("nearest_distance"),
        F.round("distance_margin", 8).alias("distance_margin"),
    )


@query(
    "g18_aggregate_shift",
    "G18",
    with_parts(
        "veclong",
        """SELECT class, round(sqrt(sum((a-b)*(a-b))),9) AS shift_l2 FROM (SELECT class, pos, avg(v) FILTER (split='train') AS a, avg(v) AS b FROM veclong GROUP BY 1,2) GROUP BY class""",
    ),
)
def aggregate_shift(t: Tables):
    everything = V.mean_vector(X.vectors(t), ["class"], "vector", "vector", X.WIDTH)
    out = P.aggregate_shift(train_prototypes(t), everything)
    return out.withColumn("shift_l2", F.round("shift_l2", 9))


@query(
    "g19_baseline_vector",
    "G19",
    with_parts(
        "rows",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(median({c}),6) AS baseline FROM rows WHERE split='train'"
            for c in X.windows.FEATURES
        ),
    ),
)
def baseline_vector(t: Tables):
    from tracelight.operators.ranking import exact_quantiles

    train = X.split_rows(t).where("split = 'train'").select(*X.windows.FEATURES)
    long = train.unpivot([], list(X.windows.FEATURES), "feature", "value")
    out = exact_quantiles(long, keys=["feature"], value="value", probabilities=[0.5])
    return out.select("feature", F.round("quantile", 6).alias("baseline"))


@query(
    "w3_prototype_ranks",
    "W3",
    with_parts(
        "near",
        "SELECT vec_id, actual, CAST(actual_rank AS INTEGER) AS actual_rank, predicted=actual AS matches_nearest FROM near",
    ),
)
def prototype_ranks(t: Tables):
    return predictions(t).select(
        "vec_id",
        "actual",
        P.class_rank("distances", "actual").alias("actual_rank"),
        (F.col("predicted") == F.col("actual")).alias("matches_nearest"),
    )


@query(
    "w3_indexed_ranks",
    "W3 J11",
    with_parts(
        "veclong",
        """SELECT vec_id, nearest_class, second_class, round(margin,8) AS distance_margin, CAST(coalesce(own_rank,0) AS INTEGER) AS class_rank FROM
      (SELECT vec_id, min(p) FILTER (r=1) AS nearest_class, min(p) FILTER (r=2) AS second_class, min(d) FILTER (r=2)-min(d) FILTER (r=1) AS margin,
        min(r) FILTER (p=vec_id) AS own_rank
      FROM (SELECT a.vec_id, b.vec_id AS p, round(sqrt(sum((a.v-b.v)*(a.v-b.v))),12) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(sum((a.v-b.v)*(a.v-b.v))), b.vec_id) AS r
        FROM veclong a JOIN veclong b USING (pos) WHERE b.split='train' GROUP BY 1,2) GROUP BY 1)""",
    ),
)
def indexed_ranks(t: Tables):
    """Every training vector is a class of its own: two nearest ones, and the place of a vector among them (0: no class)."""
    rows = X.vectors(t)
    protos = rows.where("split = 'train'").select(F.col("vec_id").alias("class"), "vector")
    near = P.nearest_indexed(rows.select("vec_id", "vector", F.col("vec_id").alias("own")), protos, "vector", "vec_id", "own", size=64)
    return near.select(
        "vec_id", "nearest_class", "second_class", F.round("distance_margin", 8).alias("distance_margin"),
        F.coalesce("class_rank", F.lit(0)).alias("class_rank"),
    )
