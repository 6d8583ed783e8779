"""The engine's concepts on the driver's tables, as DataFrames and as SQL.

The network logs themselves are not available here, so ``events`` stands in for connections,
``lineitem`` for records that repeat under several labels, ``embeddings`` for model updates and
evaluation rows. ``with_parts`` gives the same definitions as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.functions import vectors as V
from tracelight.operators import splitting, transforms, windows
from tracelight.operators.normalization import normalize_events
from tracelight.plans.catalog import Tables

WINDOW_SECONDS = 300
EVENT_LABELS = ("benign", "click", "error", "purchase", "signup")
CLASSES = tuple(range(10))
CLIENTS = 15
WIDTH = 64
HOLDOUT_EPOCH = 1706227200  # 2024-01-26T00:00:00Z
PERCENTAGES = {"train": 60, "validation": 20, "test": 20}


def raw_connections(t: Tables) -> DataFrame:
    """``events`` in the field names, text forms and blanks of a raw connection log."""
    events = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    k = F.col("k")

    def pick(number, *names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int") + 1)

    return events.select(
        "event_id",
        S.epoch_seconds("ts").alias("ts"),
        S.calendar_day("ts").alias("capture_id"),
        F.concat(F.lit("conn-"), "event_id").alias("uid"),
        F.concat(F.lit("client-"), F.pmod("user_id", F.lit(CLIENTS))).alias("id.orig_h"),
        F.concat(F.lit("host-"), "user_id").alias("id.resp_h"),
        k.alias("id.resp_p"),
        pick(F.col("user_id"), "tcp", " UDP", "icmp", "gre", "-").alias("proto"),
        pick(k.cast("bigint"), "dns", "HTTP", "ssl", "ssh", "ftp", "-").alias("service"),
        pick(F.col("event_id"), "SF", "S0", "REJ", "RSTO", "RSTR", "OTH", "").alias("conn_state"),
        F.col("value").alias("duration"),
        F.col("value").alias("orig_bytes"),
        (F.col("value") * 3).alias("resp_bytes"),
        k.alias("orig_pkts"),
        F.floor(k.cast("bigint") / 2).alias("resp_pkts"),
        F.when(F.col("event_type") == "view", "none").otherwise(F.col("event_type")).alias("label"),
        "user_id",
    )


def connections(t: Tables) -> DataFrame:
    raw = raw_connections(t)
    return normalize_events(
        raw,
        event_id=F.col("event_id"),
        capture=F.col("capture_id"),
        label=S.tactic("label"),
        extra=("user_id",),
    )


def window_rows(t: Tables) -> DataFrame:
    return windows.window_features(
        connections(t), seconds=WINDOW_SECONDS, vocabulary=EVENT_LABELS
    )


def capture_regimes(rows: DataFrame) -> DataFrame:
    """Captures with a second traffic regime: days with an even or odd number of windows."""
    captures = windows.capture_summary(rows)
    return captures.withColumn(
        "stratum", F.concat_ws("-", "stratum", (F.col("row_count") % 2).cast("string"))
    )


def stored_windows(t: Tables) -> DataFrame:
    return t.stored("windows", window_rows)


def split_rows(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    rows = stored_windows(t) if rows is None else rows
    assignment = splitting.grouped_time_split(
        windows.capture_summary(rows), holdout_epoch=HOLDOUT_EPOCH, percentages=PERCENTAGES
    )
    return splitting.apply_split(rows, assignment)


def scaled_rows(t: Tables) -> DataFrame:
    rows = split_rows(t)
    fitted = transforms.fit_scaler(rows.where("split = 'train'"), windows.FEATURES)
    return transforms.standardize(rows, fitted, windows.FEATURES)


def labelled_records(t: Tables) -> DataFrame:
    """``lineitem`` as labelled records: one order line may appear under several tactics."""
    third = F.col("l_partkey") % 3 == 0
    flag = F.col("l_returnflag")
    tactic = (
        F.when(flag == "N", "None")
        .when((flag == "A") & third, "Defense Evasion")
        .when(flag == "A", "Reconnaissance")
        .when(third, "Credential Access")
        .otherwise("Exfiltration")
    )
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("supplier/"), "l_suppkey").alias("source_file"),
        "l_partkey",
        "l_shipdate",
        tactic.alias("label_tactic"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("T"), 1000 + F.col("l_partkey") % 7))
        .when(F.col("l_quantity") % 5 == 0, "Duplicate")
        .otherwise("none")
        .alias("label_technique"),
        F.when(F.col("l_suppkey") % 4 == 0, "Duplicate").otherwise("True").alias("label_binary"),
        F.when(F.col("l_tax") == 0, "-").otherwise(F.col("l_tax").cast("string")).alias("label_cve"),
        S.tactic(tactic).alias("tactic"),
    )


def vectors(t: Tables) -> DataFrame:
    """``embeddings`` as (vec_id, client_id, class, split, vector)."""
    index = F.pmod("vec_id", F.lit(CLIENTS))
    return t.embeddings.select(
        "vec_id",
        F.concat(F.lit("client"), F.lpad((index + 1).cast("string"), 2, "0")).alias("client_id"),
        F.col("label").alias("class"),
        splitting.hash_split(F.col("vec_id"), 17, PERCENTAGES).alias("split"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def client_updates(t: Tables) -> DataFrame:
    """The submitted updates: one row per client, a table of its own."""
    return t.stored("updates", build_updates)


def build_updates(t: Tables) -> DataFrame:
    """Mean vector per client minus the mean over all: (client_id, num_examples, delta)."""
    rows = vectors(t)
    means = V.mean_vector(rows, ["client_id"], "vector", "updated", WIDTH, count="num_examples")
    base = V.mean_vector(rows, [], "vector", "base", WIDTH).select("base").scalar()
    return means.withColumn("base", base).select(
        "client_id", "num_examples", "base", "updated", V.subtract("updated", "base").alias("delta")
    )


PARTS: dict[str, str] = {}

PARTS["conn"] = """
SELECT event_id, epoch_us(ts)/1e6 AS timestamp, strftime(ts,'%Y-%m-%d') AS capture_id, user_id,
  'conn-'||event_id AS uid, 'client-'||(user_id%15) AS originator_host,
  'host-'||user_id AS responder_host, k AS responder_port,
  CASE user_id%5 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' WHEN 3 THEN 'gre' ELSE 'missing' END AS protocol,
  CASE k%6 WHEN 0 THEN 'dns' WHEN 1 THEN 'http' WHEN 2 THEN 'ssl' WHEN 3 THEN 'ssh' WHEN 4 THEN 'ftp' ELSE 'missing' END AS service,
  CASE event_id%7 WHEN 0 THEN 'sf' WHEN 1 THEN 's0' WHEN 2 THEN 'rej' WHEN 3 THEN 'rsto' WHEN 4 THEN 'rstr' WHEN 5 THEN 'oth' ELSE 'missing' END AS connection_state,
  value AS duration, CAST(floor(value) AS BIGINT) AS originator_bytes, CAST(floor(value*3) AS BIGINT) AS responder_bytes,
  k AS originator_packets, k//2 AS responder_packets,
  CASE WHEN event_type='view' THEN 'benign' ELSE event_type END AS label
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)
"""

_share = lambda col, prefix, names: ",\n  ".join(
    [f"round(count(*) FILTER ({col}='{n}')/count(*),12) AS {prefix}_{n}_fraction" for n in names]
    + [
        f"round(count(*) FILTER ({col} NOT IN ({', '.join(repr(n) for n in names)}))/count(*),12) AS {prefix}_other_fraction"
    ]
)

PARTS["win"] = f"""
SELECT 'window-central-'||substr(sha256(capture_id||':'||bucket),1,20) AS window_id,
  bucket*{WINDOW_SECONDS} AS window_start_epoch, (bucket+1)*{WINDOW_SECONDS} AS window_end_epoch, capture_id,
  CASE WHEN count(DISTINCT label) FILTER (label<>'benign')>1 THEN 'multi_tactic'
       ELSE coalesce(min(label) FILTER (label<>'benign'),'benign') END AS label,
  string_agg(DISTINCT label, ',' ORDER BY label) AS observed_labels,
  count(*)::DOUBLE AS connection_count,
  count(DISTINCT responder_host)::DOUBLE AS unique_destination_count,
  count(DISTINCT CASE WHEN responder_port<>0 THEN responder_port END)::DOUBLE AS unique_destination_port_count,
  round(avg(duration),12) AS duration_mean, round(stddev_pop(duration),12) AS duration_std, max(duration) AS duration_max,
  sum(originator_bytes)::DOUBLE AS originator_bytes_sum, sum(responder_bytes)::DOUBLE AS responder_bytes_sum,
  sum(originator_packets)::DOUBLE AS originator_packets_sum, sum(responder_packets)::DOUBLE AS responder_packets_sum,
  {_share('protocol', 'protocol', windows.PROTOCOLS)},
  {_share('service', 'service', windows.SERVICES)},
  {_share('connection_state', 'state', windows.STATES)}
FROM (SELECT *, CAST(floor(timestamp/{WINDOW_SECONDS}) AS BIGINT) AS bucket FROM conn)
GROUP BY capture_id, bucket
"""

PARTS["cap"] = """
SELECT capture_id, min(window_start_epoch) AS start_epoch, count(*) AS row_count, count(DISTINCT label) AS label_count,
  CASE WHEN count(*) FILTER (label<>'benign')=0 THEN 'benign_only' ELSE 'attack_present' END AS stratum
FROM win GROUP BY capture_id
"""


def split_sql(source: str = "cap") -> str:
    return f"""
SELECT *, CASE WHEN start_epoch>={HOLDOUT_EPOCH} THEN 'temporal_holdout'
    WHEN place<train_end THEN 'train' WHEN place<train_end+validation_rows THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, CASE WHEN tr+va>=n THEN n-2 ELSE tr END AS train_end, CASE WHEN tr+va>=n THEN 1 ELSE va END AS validation_rows
  FROM (SELECT *, greatest(1,CAST(floor(n*60/100) AS BIGINT)) AS tr, greatest(1,CAST(floor(n*20/100) AS BIGINT)) AS va
    FROM (SELECT *, count(*) OVER (PARTITION BY start_epoch<{HOLDOUT_EPOCH}, stratum) AS n,
      row_number() OVER (PARTITION BY start_epoch<{HOLDOUT_EPOCH}, stratum ORDER BY start_epoch, capture_id)-1 AS place FROM {source})))
"""


PARTS["capsplit"] = split_sql()
PARTS["rows"] = "SELECT win.*, capsplit.split FROM win JOIN capsplit USING (capture_id)"

_mean = ", ".join(f"avg({c}) AS {c}" for c in windows.FEATURES)
_std = ", ".join(
    f"CASE WHEN stddev_pop({c})>0 THEN stddev_pop({c}) ELSE 1.0 END AS {c}" for c in windows.FEATURES
)
PARTS["fmean"] = f"SELECT {_mean} FROM rows WHERE split='train'"
PARTS["fstd"] = f"SELECT {_std} FROM rows WHERE split='train'"
_scaled = ", ".join(f"(r.{c}-m.{c})/s.{c} AS {c}" for c in windows.FEATURES)
PARTS["scaled"] = f"""
SELECT r.window_id, r.capture_id, r.window_start_epoch, r.label, r.observed_labels, r.split, {_scaled}
FROM rows r, fmean m, fstd s
"""

PARTS["rec"] = """
SELECT l_orderkey, l_linenumber, 'supplier/'||l_suppkey AS source_file, l_partkey, l_shipdate, tactic_raw AS label_tactic,
  CASE WHEN l_linestatus='F' THEN 'T'||(1000+l_partkey%7) WHEN l_quantity%5=0 THEN 'Duplicate' ELSE 'none' END AS label_technique,
  CASE WHEN l_suppkey%4=0 THEN 'Duplicate' ELSE 'True' END AS label_binary,
  CASE WHEN l_tax=0 THEN '-' ELSE CAST(l_tax AS VARCHAR) END AS label_cve,
  CASE WHEN tactic_raw='None' THEN 'benign' ELSE replace(lower(tactic_raw),' ','_') END AS tactic
FROM (SELECT *, CASE WHEN l_returnflag='N' THEN 'None' WHEN l_returnflag='A' AND l_partkey%3=0 THEN 'Defense Evasion'
    WHEN l_returnflag='A' THEN 'Reconnaissance' WHEN l_partkey%3=0 THEN 'Credential Access' ELSE 'Exfiltration' END AS tactic_raw
  FROM lineitem)
"""

PARTS["vec"] = """
SELECT vec_id, 'client'||lpad(CAST(vec_id%15+1 AS VARCHAR),2,'0') AS client_id, label AS class,
  CASE WHEN b<60 THEN 'train' WHEN b<80 THEN 'validation' ELSE 'test' END AS split, CAST(embedding AS DOUBLE[]) AS vector
FROM (SELECT *, CAST(('0x'||substr(sha256('17:'||vec_id),1,16))::UBIGINT % 100 AS INTEGER) AS b FROM embeddings)
"""
# Long layout of the vectors: (vec_id, client_id, class, split, pos, v), positions from 0.
PARTS["veclong"] = """
SELECT vec_id, client_id, class, split, unnest(range(64)) AS pos, unnest(vector) AS v FROM vec
"""
PARTS["upd"] = """
SELECT client_id, pos, avg(v) AS updated, count(*) AS num_examples FROM veclong GROUP BY client_id, pos
"""
PARTS["basev"] = "SELECT pos, avg(v) AS base FROM veclong GROUP BY pos"
PARTS["delta"] = """
SELECT u.client_id, u.pos, u.updated-b.base AS v, u.updated, b.base, u.num_examples FROM upd u JOIN basev b USING (pos)
"""

NEEDS = {
    "win": ["conn"],
    "cap": ["win"],
    "capsplit": ["cap"],
    "rows": ["capsplit", "win"],
    "fmean": ["rows"],
    "fstd": ["rows"],
    "scaled": ["rows", "fmean", "fstd"],
    "veclong": ["vec"],
    "upd": ["veclong"],
    "basev": ["veclong"],
    "delta": ["upd", "basev"],
}


def define(name: str, sql: str, needs: str = "") -> None:
    """Adds a shared SQL part."""
    PARTS[name] = sql
    NEEDS[name] = needs.split()


def with_parts(names: str, body: str) -> str:
    """``body`` below the named parts and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in NEEDS.get(name, []):
            visit(other)
        order.append(name)

    for name in names.split():
        visit(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {clauses},\n{body[5:]}"
    if body.startswith(","):
        return f"WITH {clauses}{body}"
    return f"WITH {clauses}\n{body}"
