"""Queries on scans, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.functions import vectors as V
from tracelight.operators import digests
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.session import shared_directory
from tracelight.sources import manifests, positions, scans, sinks


@query(
    "a1_strict_csv_lines",
    "A1",
    """SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority,
         sha256(o_orderkey||','||o_orderstatus||','||o_orderpriority) AS raw_line_sha256 FROM orders""",
)
def strict_csv_lines(t: Tables):
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    lines = sinks.csv_lines(t.orders, fields)
    rows = scans.parse_csv_lines(lines, ["key", "status", "priority"])
    return rows.withColumn("key", F.col("key").cast("bigint"))


@query(
    "a2_exact_parquet_text",
    "A2",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S')||
         CASE WHEN epoch_us(ts)%1000000=0 THEN '' ELSE '.'||lpad(CAST(epoch_us(ts)%1000000 AS VARCHAR),6,'0') END||'Z' AS ts,
         CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(value AS VARCHAR) AS value, props FROM events""",
)
def exact_parquet_text(t: Tables):
    columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return scans.stringify(scans.read_exact_parquet(t.spark, t.path("events"), columns))


def json_lines(t: Tables):
    """Connection log lines, some of them broken in each of the ways the scan must report."""
    raw = X.raw_connections(t)
    n = F.col("event_id")
    whole = raw.withColumn("ts", F.when(n % 83 == 0, "-").otherwise(F.col("ts").cast("string")))
    whole = whole.withColumn("label", F.when(n % 79 == 0, "").otherwise(F.col("label")))
    whole = whole.withColumn("_source_records", F.when(n % 73 == 0, "unknown"))
    sent = [c for c in whole.columns if c not in ("event_id", "user_id")]
    full = F.to_json(F.struct(*[f"`{c}`" for c in sent]))
    short = F.to_json(F.struct(*[f"`{c}`" for c in sent if c != "ts"]))
    line = (
        F.when(n % 97 == 0, F.concat(F.lit("{broken "), full))
        .when(n % 89 == 0, short)
        .otherwise(full)
    )
    return whole.select("event_id", "capture_id", line.alias("value"))


REASON_SQL = """CASE WHEN event_id%97=0 THEN 'invalid_json' WHEN event_id%89=0 THEN 'missing_timestamp'
  WHEN event_id%83=0 THEN 'invalid_timestamp' WHEN event_id%79=0 THEN 'missing_label'
  WHEN event_id%73=0 THEN 'invalid_source_lineage' ELSE 'accepted' END"""


@query(
    "a3_json_reject_reasons",
    "A3",
    f"SELECT {REASON_SQL} AS reject_reason, count(*) AS line_count FROM events GROUP BY 1",
)
def json_reject_reasons(t: Tables):
    parsed = scans.parse_json_lines(json_lines(t).drop("capture_id"))
    reason = F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")
    return parsed.groupBy(reason).agg(F.count(F.lit(1)).alias("line_count"))


@query(
    "a4_batch_inspection",
    "A4",
    f"""SELECT batch_id, count(*) FILTER (r='accepted') AS record_count, count(*) FILTER (r<>'accepted') AS bad_line_count,
      min(e) FILTER (r='accepted') AS first_epoch, max(e) FILTER (r='accepted') AS last_epoch,
      count(*) FILTER (r<>'accepted')=0 AND count(*) FILTER (r='accepted')>0 AS acceptable
    FROM (SELECT strftime(ts,'%Y-%m-%d')||'/'||(event_id%20) AS batch_id, epoch_us(ts)/1e6 AS e, {REASON_SQL} AS r FROM events)
    GROUP BY batch_id""",
)
def batch_inspection(t: Tables):
    batch = F.concat_ws("/", "capture_id", (F.col("event_id") % 20).cast("string"))
    lines = json_lines(t).select(batch.alias("batch_id"), "value")
    parsed = scans.parse_json_lines(lines).withColumn("epoch", S.finite_double("ts", None))
    return scans.inspect_batches(parsed, "batch_id", "epoch", F.col("reject_reason").isNotNull())


def page_files(t: Tables):
    """Pages as stored files, and a manifest with gaps and errors in known places."""
    n = F.col("page_id")
    facts = t.pages.select(
        "page_id",
        F.concat(F.lit("page/"), n.cast("string")).alias("relative_path"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        F.sha2("html", 256).alias("sha256"),
    )
    declared = facts.where(n % 11 != 0).select(
        "relative_path",
        F.when(n % 13 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(n % 7 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
    )
    actual = facts.where(n % 17 != 0).drop("page_id")
    return declared, actual


MANIFEST_SQL = """SELECT 'page/'||page_id AS relative_path,
  CASE WHEN page_id%17=0 THEN 'missing' WHEN page_id%11=0 THEN 'unmanifested' WHEN page_id%13=0 THEN 'size-mismatch'
    WHEN page_id%7=0 THEN 'digest-mismatch' ELSE 'verified' END AS status
FROM pages WHERE NOT (page_id%17=0 AND page_id%11=0)"""


@query("a5_manifest_verification", "A5 S1", MANIFEST_SQL)
def manifest_verification(t: Tables):
    return manifests.verify_manifest(*page_files(t)).select("relative_path", "status")


@query(
    "a9_artifact_set_errors",
    "A9",
    f"SELECT status, count(*) AS file_count FROM ({MANIFEST_SQL}) GROUP BY status",
)
def artifact_set_errors(t: Tables):
    return manifests.manifest_errors(manifests.verify_manifest(*page_files(t)))


@query(
    "a6_write_once_retry",
    "A6 S4",
    """SELECT 'identical' AS attempt, 0::BIGINT AS only_left, 0::BIGINT AS only_right
    UNION ALL SELECT 'changed', count(*) FILTER (o_orderkey%10=0), count(*) FILTER (o_orderkey%10=0) FROM orders""",
)
def write_once_retry(t: Tables):
    from tracelight.operators.selection import equal_tables

    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    stored = t.orders.select(*columns)
    changed = stored.withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")),
    )
    same = equal_tables(stored, stored, columns).withColumn("attempt", F.lit("identical"))
    other = equal_tables(stored, changed, columns).withColumn("attempt", F.lit("changed"))
    return same.unionByName(other)


@query(
    "a7_content_addressed_objects",
    "A7",
    """SELECT sha256(text) AS digest, substr(sha256(text),1,2) AS digest_prefix, count(*) AS reference_count,
         length(text)::BIGINT AS content_length FROM documents GROUP BY text""",
)
def content_addressed_objects(t: Tables):
    objects = sinks.object_table(t.documents, "text")
    return objects.select(
        "digest",
        "digest_prefix",
        "reference_count",
        F.length("content").cast("bigint").alias("content_length"),
    )


@query(
    "a8_report_lines",
    "A8",
    """SELECT n_name||','||c||','||b AS csv_line, '| '||n_name||' | '||c||' | '||b||' |' AS markdown_line
    FROM (SELECT n_name, count(*) AS c, CAST(sum(CAST(round(c_acctbal*100) AS BIGINT)) AS BIGINT) AS b
      FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY n_name)""",
)
def report_lines(t: Tables):
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("b")
    per_nation = (
        t.customer.groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("c"), cents)
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
    )
    cells = ["n_name", "c", "b"]
    return per_nation.select(
        F.to_csv(F.struct(*cells)).alias("csv_line"),
        sinks.markdown_table_line(cells).alias("markdown_line"),
    )


@query(
    "b1_numeric_cleaning",
    "B1 B2 B17",
    """SELECT event_id, round(CASE event_id%8 WHEN 0 THEN value WHEN 5 THEN value WHEN 6 THEN -value WHEN 7 THEN CAST(value||'e3' AS DOUBLE) ELSE -1 END,6) AS number,
      CAST(greatest(0,trunc(CASE event_id%8 WHEN 0 THEN value WHEN 5 THEN value WHEN 6 THEN -value WHEN 7 THEN CAST(value||'e3' AS DOUBLE) ELSE 0 END)) AS BIGINT) AS whole
    FROM events""",
)
def numeric_cleaning(t: Tables):
    text = F.col("value").cast("string")
    dirty = F.element_at(
        F.array(
            text,
            F.lit(""),
            F.lit("-"),
            F.lit("nan"),
            F.lit("inf"),
            F.concat(F.lit("  "), text, F.lit(" ")),
            F.concat(F.lit("-"), text),
            F.concat(text, F.lit("e3")),
        ),
        (F.col("event_id") % 8).cast("int") + 1,
    )
    marked = t.events.select("event_id", dirty.alias("dirty"))
    return marked.select(
        "event_id",
        F.round(S.finite_double("dirty", -1.0), 6).alias("number"),
        S.nonnegative_int("dirty").alias("whole"),
    )


@query(
    "b3_category_and_slug",
    "B3 B4 B5",
    """SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN 'missing' WHEN p_partkey%5=1 THEN '' ELSE lower(p_type) END AS category,
      lower(CASE WHEN p_partkey%3=0 THEN p_name ELSE p_brand END) AS label,
      CASE WHEN p_partkey%4=0 THEN 'benign' WHEN p_partkey%4=1 THEN 'unknown'
        ELSE trim(regexp_replace(lower(p_brand||' / '||p_name),'[^a-z0-9]+','_','g'),'_') END AS tactic
    FROM part""",
)
def category_and_slug(t: Tables):
    n = F.col("p_partkey")
    raw = F.when(n % 5 == 0, "-").when(n % 5 == 1, " ").otherwise(F.concat(F.lit(" "), "p_type"))
    first = F.when(n % 3 == 0, "").otherwise(F.col("p_brand"))
    name = (
        F.when(n % 4 == 0, " NONE ")
        .when(n % 4 == 1, "-- --")
        .otherwise(F.concat(F.lit("("), "p_brand", F.lit(" / "), "p_name", F.lit(")")))
    )
    return t.part.select(
        "p_partkey",
        S.category(raw).alias("category"),
        S.first_label(first, F.col("p_name")).alias("label"),
        S.tactic(name).alias("tactic"),
    )


@query(
    "b6_timestamps_and_days",
    "B6 B7",
    """SELECT event_id, CASE WHEN event_id%4=0 THEN -1 WHEN event_id%4=1 THEN epoch_us(ts)-7200000000 ELSE epoch_us(ts) END AS micros,
      strftime(ts,'%Y-%m-%d') AS day, strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'Z' AS iso FROM events""",
)
def timestamps_and_days(t: Tables):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.element_at(
        F.array(F.lit(""), F.lit("+02:00"), F.lit("Z"), F.lit("+00:00")),
        (F.col("event_id") % 4).cast("int") + 1,
    )
    return t.events.select(
        "event_id",
        F.coalesce(F.unix_micros(S.parse_utc(F.concat(text, zone))), F.lit(-1)).alias("micros"),
        S.calendar_day("ts").alias("day"),
        S.iso_utc(F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(26,6)") / 1000000).alias("iso"),
    )


@query(
    "b8_window_buckets",
    "B8",
    """SELECT b AS bucket, b*60 AS start_epoch, (b+1)*60 AS end_epoch, count(*) AS row_count
    FROM (SELECT CAST(floor(epoch_us(ts)/1e6/60) AS BIGINT) AS b FROM events) GROUP BY b""",
)
def window_buckets(t: Tables):
    bucket = S.window_bucket(S.epoch_seconds("ts"), 60)
    return (
        t.events.groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            "bucket",
            (F.col("bucket") * 60).alias("start_epoch"),
            ((F.col("bucket") + 1) * 60).alias("end_epoch"),
            "row_count",
        )
    )


@query(
    "b9_canonical_digests",
    "B9 B10 B11 B18",
    """SELECT o_orderkey, d AS identity_sha256, 'order-'||substr(d,1,24) AS derived_id,
      sha256('{"custkey":'||o_custkey||',"note":null,"open":'||CASE WHEN o_orderstatus='O' THEN 'true' ELSE 'false' END||',"status":"'||o_orderstatus||'"}') AS object_sha256,
      true AS is_digest, false AS is_short_digest
    FROM (SELECT *, sha256('["'||o_orderkey||'","'||o_custkey||'","'||o_orderpriority||'"]') AS d FROM orders)""",
)
def canonical_digests(t: Tables):
    digest = S.canonical_digest("o_orderkey", "o_custkey", "o_orderpriority")
    core = {
        "status": F.col("o_orderstatus"),
        "custkey": F.col("o_custkey"),
        "open": F.col("o_orderstatus") == "O",
        "note": F.lit(None).cast("string"),
    }
    return t.orders.select(
        "o_orderkey",
        digest.alias("identity_sha256"),
        S.derived_id("order", digest, 24).alias("derived_id"),
        S.object_digest(core).alias("object_sha256"),
        S.is_hex_digest(digest).alias("is_digest"),
        S.is_hex_digest(F.substring(digest, 1, 40)).alias("is_short_digest"),
    )


@query(
    "b12_hash_buckets",
    "B12",
    """SELECT CAST(('0x'||substr(sha256('42:'||c_custkey),1,16))::UBIGINT % 100 AS INTEGER) AS bucket, count(*) AS row_count
    FROM customer GROUP BY 1""",
)
def hash_buckets(t: Tables):
    return t.customer.groupBy(S.hash_bucket(42, "c_custkey").alias("bucket")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "b13_count_ranges",
    "B13",
    """SELECT l_orderkey, count(*) AS line_count,
      CASE WHEN count(*)<=1 THEN '1' WHEN count(*)<=5 THEN '2-5' WHEN count(*)<=20 THEN '6-20' WHEN count(*)<=100 THEN '21-100' ELSE '>100' END AS event_range,
      CASE WHEN count(*) FILTER (l_returnflag='R')=0 THEN 'absent' WHEN count(*) FILTER (l_returnflag='R')<5 THEN 'rare' ELSE 'supported' END AS support
    FROM lineitem GROUP BY l_orderkey""",
)
def count_ranges(t: Tables):
    grouped = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if(F.col("l_returnflag") == "R").alias("_r")
    )
    return grouped.select(
        "l_orderkey",
        "line_count",
        S.event_count_range("line_count").alias("event_range"),
        S.support_category("_r").alias("support"),
    )


@query(
    "b16_vector_guards",
    "B16 G20",
    """SELECT CASE WHEN vec_id%10=0 THEN 'short' WHEN vec_id%10=1 THEN 'not-finite' ELSE 'valid' END AS status, count(*) AS vector_count
    FROM embeddings GROUP BY 1""",
)
def vector_guards(t: Tables):
    n = F.col("vec_id")
    v = F.col("embedding").cast("array<double>")
    given = (
        F.when(n % 10 == 0, F.slice(v, 1, 63))
        .when(n % 10 == 1, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
        .otherwise(v)
    )
    rows = t.embeddings.select(given.alias("v"))
    status = (
        F.when(F.size("v") != X.WIDTH, "short")
        .when(~V.is_finite_vector("v"), "not-finite")
        .otherwise("valid")
    )
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("vector_count"))


@query(
    "b19_softmax_and_margin",
    "B19",
    """SELECT vec_id, CAST(list_position(p, list_max(p))-1 AS INTEGER) AS predicted, round(list_max(p),8) AS confidence,
      round(list_sort(p,'DESC')[1]-list_sort(p,'DESC')[2],8) AS margin
    FROM (SELECT vec_id, list_transform(e, lambda x: x/list_sum(e)) AS p FROM
      (SELECT vec_id, list_transform(v[1:10], lambda x: exp(5*x-5*list_max(v[1:10]))) AS e FROM
        (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))""",
)
def softmax_and_margin(t: Tables):
    logits = F.transform(
        F.slice(F.col("embedding").cast("array<double>"), 1, 10), lambda x: x * F.lit(5.0)
    )
    rows = t.embeddings.select("vec_id", V.softmax(logits).alias("p"))
    return rows.select(
        "vec_id",
        V.argmax("p").alias("predicted"),
        F.round(F.array_max("p"), 8).alias("confidence"),
        F.round(V.top_margin("p"), 8).alias("margin"),
    )


@query(
    "b20_directions_and_shares",
    "B20 B21",
    """SELECT c_mktsegment, direction, n AS row_count, round(100.0*n/sum(n) OVER (PARTITION BY c_mktsegment),6) AS percent
    FROM (SELECT c_mktsegment, CASE WHEN c_acctbal>5000 THEN 'supports-target' WHEN c_acctbal<0 THEN 'opposes-target' ELSE 'neutral' END AS direction,
      count(*) AS n FROM customer GROUP BY 1,2)""",
)
def directions_and_shares(t: Tables):
    from pyspark.sql import Window

    score = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") < 0, -1).otherwise(0)
    counts = t.customer.groupBy("c_mktsegment", S.direction(score).alias("direction")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    whole = F.sum("row_count").over(Window.partitionBy("c_mktsegment"))
    return counts.withColumn("percent", F.round(S.ratio("row_count", whole) * 100, 6))


@query(
    "b22_scale_tokens",
    "B22",
    """SELECT l_discount, l_quantity, CASE WHEN l_discount=0 THEN '0p0' ELSE replace(rtrim(CAST(CAST(l_discount AS DECIMAL(20,6)) AS VARCHAR),'0'),'.','p') END AS discount_token,
      CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)||'p0' AS quantity_token, count(*) AS row_count
    FROM lineitem GROUP BY ALL""",
)
def scale_tokens(t: Tables):
    counts = t.lineitem.groupBy("l_discount", "l_quantity").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.withColumn("discount_token", S.scale_token("l_discount")).withColumn(
        "quantity_token", S.scale_token("l_quantity")
    )


ORDER_FIELDS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


@query(
    "a1_strict_csv_files",
    "A1 A8",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
def strict_csv_files(t: Tables):
    """CSV report files written below the shared folder and read back with their header checked."""
    path = shared_directory(t.spark, "orders-csv")
    sinks.write_report(t.orders, path, ORDER_FIELDS)
    return scans.read_strict_csv(t.spark, path, ORDER_FIELDS).drop("source_file")


@query(
    "a5_written_files",
    "A5 A9",
    """SELECT 'verified' AS status, count(DISTINCT o_orderstatus) AS file_count FROM orders
    UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'digest-mismatch', 1 UNION ALL SELECT 'size-mismatch', 1""",
)
def written_files(t: Tables):
    """Facts of files as written against a manifest with one file altered in each way."""
    path = shared_directory(t.spark, "orders-by-status")
    keep = t.orders.select(*ORDER_FIELDS)
    extra = keep.limit(1).select("o_orderkey", F.explode(F.array(*map(F.lit, "XYZ"))).alias("o_orderstatus"), "o_orderpriority")
    keep.union(extra).repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    facts = manifests.file_facts(t.spark, path, "*.parquet")
    status = F.regexp_extract("relative_path", "o_orderstatus=([^/]*)/", 1)
    declared = facts.withColumns(
        {
            "size_bytes": F.col("size_bytes") + F.when(status == "X", 1).otherwise(0),
            "sha256": F.when(status == "Y", F.lit("0" * 64)).otherwise(F.col("sha256")),
        }
    )
    return manifests.manifest_errors(manifests.verify_manifest(declared, facts.where(status != "Z")))


@query(
    "a6_write_once_files",
    "A6 S4",
    """SELECT a AS attempt, o AS outcome, (SELECT count(*) FROM orders) AS row_count FROM (VALUES ('first','written'),('retry','unchanged'),('changed','refused')) v(a, o)""",
)
def write_once_files(t: Tables):
    """A table written, written again, and written with another value; and the rows it holds after."""
    path = shared_directory(t.spark, "orders-once")
    orders = t.orders.select(*ORDER_FIELDS)
    first = sinks.write_once(orders, path)
    retry = sinks.write_once(orders, path)
    last = orders.agg(F.max("o_orderkey")).scalar()
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == last, "X").otherwise(F.col("o_orderstatus")))
    try:
        outcome = sinks.write_once(changed, path)
    except sinks.DifferentContent:
        outcome = "refused"
    attempts = F.array(*[F.struct(F.lit(a).alias("attempt"), F.lit(o).alias("outcome")) for a, o in zip(("first", "retry", "changed"), (first, retry, outcome))])
    counted = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.inline(attempts), "row_count")


@query(
    "a7_object_store",
    "A7",
    "SELECT DISTINCT sha256(text) AS digest, substr(sha256(text),1,2) AS digest_prefix, 1::BIGINT AS stored_count FROM documents",
)
def object_store(t: Tables):
    """Objects put in two deliveries that overlap; each is stored once."""
    path = shared_directory(t.spark, "objects")
    half = t.documents.where("source <> 'src1'")
    for delivery in (half, t.documents):
        sinks.write_objects(sinks.object_table(delivery, "text"), path)
    held = t.spark.read.parquet(path).groupBy("digest", "digest_prefix")
    return held.agg(F.count(F.lit(1)).alias("stored_count"))


def written_lines(t: Tables, purpose: str, rows, file: str, order: list[str]) -> str:
    """Writes (``file``, ``order``, value) as one text file per value of ``file``; returns the folder."""
    path = shared_directory(t.spark, purpose)
    dealt = rows.repartition(file).sortWithinPartitions(file, *order)
    dealt.select(file, "value").write.partitionBy(file).text(path)
    return path


@query(
    "a1_csv_record_positions",
    "A1",
    """WITH l AS (SELECT o_orderkey//50000 AS part, o_orderkey AS k, i, CASE WHEN i=0 THEN o_orderstatus||','||o_orderpriority ELSE '' END AS value
        FROM orders, (VALUES (0),(1)) v(i) WHERE i=0 OR o_orderkey%97=0),
      p AS (SELECT *, row_number() OVER w+1 AS line_number,
        strlen('o_orderstatus,o_orderpriority')+1+coalesce(sum(strlen(value)+1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS byte_offset
        FROM l WINDOW w AS (PARTITION BY part ORDER BY k, i))
    SELECT CAST(part AS BIGINT) AS part, line_number, CAST(byte_offset AS BIGINT) AS byte_offset, sha256(value) AS raw_line_sha256,
      string_split(value,',')[1] AS o_orderstatus, string_split(value,',')[2] AS o_orderpriority FROM p WHERE i=0""",
)
def csv_record_positions(t: Tables):
    """CSV files with many equal lines and some blank ones, read back with the place of every record."""
    columns = ["o_orderstatus", "o_orderpriority"]
    part = F.floor(F.col("o_orderkey") / 50000).alias("part")
    body = t.orders.select(
        part,
        F.col("o_orderkey").alias("k"),
        F.posexplode(
            F.when(F.col("o_orderkey") % 97 == 0, F.array(F.concat_ws(",", *columns), F.lit("")))
            .otherwise(F.array(F.concat_ws(",", *columns)))
        ).alias("i", "value"),
    )
    header = t.orders.select(part).distinct().select("part", F.lit(-1).alias("k"), F.lit(0).alias("i"), F.lit(",".join(columns)).alias("value"))
    path = written_lines(t, "orders-lines", body.unionByName(header), "part", ["k", "i"])
    rows = scans.read_csv_records(t.spark, path, columns)
    return rows.select(
        F.regexp_extract("source_file", "/part=([0-9]+)/", 1).cast("bigint").alias("part"),
        "line_number", "byte_offset", "raw_line_sha256", *columns,
    )


def json_files(t: Tables) -> str:
    """The connection log as one file per capture, in the order of the events."""
    rows = json_lines(t).withColumnRenamed("capture_id", "capture")
    return written_lines(t, "json-lines", rows, "capture", ["event_id"])


POSITION_SQL = f"""(SELECT strftime(ts,'%Y-%m-%d') AS capture, row_number() OVER (PARTITION BY strftime(ts,'%Y-%m-%d') ORDER BY event_id) AS line_number,
      {REASON_SQL} AS reject_reason FROM events)"""


@query(
    "a3_json_reject_positions",
    "A3",
    f"SELECT capture, line_number, reject_reason FROM {POSITION_SQL} WHERE reject_reason <> 'accepted'",
)
def json_reject_positions(t: Tables):
    rows = scans.read_json_records(t.spark, json_files(t))
    capture = F.regexp_extract("source_file", "/capture=([^/]+)/", 1).alias("capture")
    return rows.where(F.col("reject_reason").isNotNull()).select(capture, "line_number", "reject_reason")


@query(
    "a4_first_bad_lines",
    "A4",
    f"""SELECT capture, count(*) FILTER (reject_reason='accepted') AS record_count, count(*) FILTER (reject_reason<>'accepted') AS bad_line_count,
      min(line_number) FILTER (reject_reason<>'accepted') AS first_bad_line,
      arg_min(reject_reason, line_number) FILTER (reject_reason<>'accepted') AS first_bad_reason FROM {POSITION_SQL} GROUP BY capture""",
)
def first_bad_lines(t: Tables):
    rows = scans.read_json_records(t.spark, json_files(t))
    rows = rows.withColumn("capture", F.regexp_extract("source_file", "/capture=([^/]+)/", 1))
    return positions.first_bad_lines(rows, ["capture"], F.col("reject_reason").isNotNull())


ROW_TEXT_SQL = ",".join(f"coalesce(length(CAST({{t}}{c} AS VARCHAR))||':'||CAST({{t}}{c} AS VARCHAR),'-')" for c in ORDER_FIELDS)
TREE_SQL = f"""orig AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders),
  alt AS (SELECT o_orderkey, CASE WHEN o_orderkey%4999=1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey%4993<>2
    UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey%4987=3),
  d AS (SELECT 'left' AS side, sha256(concat_ws(',', {ROW_TEXT_SQL.format(t="")})) AS d FROM orig
    UNION ALL SELECT 'right', sha256(concat_ws(',', {ROW_TEXT_SQL.format(t="")})) FROM alt),
  n AS (SELECT side, d, count(*) AS n FROM d GROUP BY 1,2),
  l3 AS (SELECT side, substr(d,1,3) AS bucket, sum(n)::BIGINT AS row_count, sha256(string_agg(d||'*'||n, ',' ORDER BY d||'*'||n)) AS digest FROM n GROUP BY 1,2),
  l2 AS (SELECT side, substr(bucket,1,2) AS bucket, sum(row_count)::BIGINT AS row_count, sha256(string_agg(bucket||'*'||digest, ',' ORDER BY bucket||'*'||digest)) AS digest FROM l3 GROUP BY ALL),
  l1 AS (SELECT side, substr(bucket,1,1) AS bucket, sum(row_count)::BIGINT AS row_count, sha256(string_agg(bucket||'*'||digest, ',' ORDER BY bucket||'*'||digest)) AS digest FROM l2 GROUP BY ALL),
  l0 AS (SELECT side, '' AS bucket, sum(row_count)::BIGINT AS row_count, sha256(string_agg(bucket||'*'||digest, ',' ORDER BY bucket||'*'||digest)) AS digest FROM l1 GROUP BY 1)"""
DEPTH = 3


def altered_orders(t: Tables):
    """Orders with some rows changed, some missing and some twice."""
    key = F.col("o_orderkey")
    keep = t.orders.select(*ORDER_FIELDS)
    changed = keep.withColumn("o_orderstatus", F.when(key % 4999 == 1, "X").otherwise(F.col("o_orderstatus")))
    return changed.where(key % 4993 != 2).unionByName(keep.where(key % 4987 == 3))


@query(
    "i12_digest_tree",
    "I12 S4",
    f"""WITH {TREE_SQL} SELECT level, bucket, row_count, digest FROM (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2
      UNION ALL SELECT 3, * FROM l3) WHERE side='left'""",
)
def order_digest_tree(t: Tables):
    return digests.digest_tree(t.orders, ORDER_FIELDS, DEPTH)


@query(
    "s4_tree_difference",
    "S4 I12",
    f"""WITH {TREE_SQL} SELECT bucket, coalesce(a.row_count,0) AS left_rows, coalesce(b.row_count,0) AS right_rows
      FROM (SELECT * FROM l3 WHERE side='left') a FULL JOIN (SELECT * FROM l3 WHERE side='right') b USING (bucket) WHERE a.digest IS DISTINCT FROM b.digest""",
)
def order_tree_difference(t: Tables):
    left, right = (digests.digest_tree(rows, ORDER_FIELDS, DEPTH) for rows in (t.orders, altered_orders(t)))
    return digests.tree_difference(left, right, DEPTH)


@query(
    "s4_changed_rows",
    "S4 I12",
    """SELECT 'left' AS side, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderkey%4999=1 OR o_orderkey%4993=2) AND NOT (o_orderkey%4987=3)
    UNION ALL SELECT 'right', o_orderkey, 'X', o_orderpriority FROM orders WHERE o_orderkey%4999=1 AND o_orderkey%4993<>2
    UNION ALL SELECT 'right', o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey%4987=3 AND o_orderkey%4999<>1 AND o_orderkey%4993<>2""",
)
def order_changed_rows(t: Tables):
    """Rows behind a difference, found in the changed buckets alone."""
    other = altered_orders(t)
    left, right = (digests.digest_tree(rows, ORDER_FIELDS, DEPTH) for rows in (t.orders, other))
    changed = digests.tree_difference(left, right, DEPTH)
    return digests.changed_rows(t.orders, other, ORDER_FIELDS, changed, DEPTH)
