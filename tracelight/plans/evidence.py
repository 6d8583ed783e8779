"""Queries on chains, custody, admission, replays and revocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators import admission, integrity
from tracelight.operators.ranking import slot_ranked
from tracelight.plans import standins as X
from tracelight.plans.catalog import Tables, query
from tracelight.plans.standins import with_parts

SESSION_BATCHES = 4


def order_places(t: Tables):
    """Orders of a customer, by date and key, in their places as a client's batches."""
    rows = slot_ranked(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
        groups=["o_custkey"],
        slot=F.date_format("o_orderdate", "yyyyMM"),
        order=["o_orderdate", "o_orderkey"],
        rank="_place",
    )
    return rows.select(
        "o_orderkey",
        "o_orderpriority",
        F.concat(F.lit("customer-"), "o_custkey").alias("client_id"),
        (F.col("_place") - 1).cast("int").alias("acquired_at"),
    )


def as_batches(rows):
    """Placed orders as batches in sessions of four, with their digests."""
    place = F.col("acquired_at")
    rows = rows.select(
        F.col("o_orderkey").alias("batch_id"),
        "client_id",
        F.concat(F.lit("s"), F.lpad(F.floor(place / SESSION_BATCHES).cast("string"), 4, "0")).alias("session_id"),
        (place % SESSION_BATCHES).alias("sequence_number"),
        "acquired_at",
        S.canonical_digest("o_orderkey", "o_orderpriority").alias("content_sha256"),
    )
    core = {
        "batch": F.col("batch_id"),
        "client": F.col("client_id"),
        "sequence": F.col("sequence_number"),
        "session": F.col("session_id"),
    }
    return rows.withColumn("core_sha256", S.object_digest(core))


def chained_batches(t: Tables):
    """Batches with recorded predecessor and chain hash, as the client built them."""
    return integrity.build_chain(
        order_places(t), ["client_id"], ["acquired_at"], late=as_batches, previous="previous_chain_hash"
    )


DIGESTS = ("content_sha256", "core_sha256", "chain_hash", "previous_chain_hash", "declared_sha256")


def received_batches(t: Tables):
    """The table of received batches; it is stored with its digests as bytes, and a declared digest only where it differs."""
    rows = t.stored("received", lambda t: stored_form(build_received(t)))
    declared = F.coalesce("declared_sha256", "content_sha256")
    return rows.withColumn("declared_sha256", declared).withColumns({c: S.unpack_digest(c) for c in DIGESTS})


def stored_form(rows):
    packed = rows.withColumns({c: S.pack_digest(c) for c in DIGESTS})
    differs = ~F.col("declared_sha256").eqNullSafe(F.col("content_sha256"))
    return packed.withColumn("declared_sha256", F.when(differs, F.col("declared_sha256")))


def build_received(t: Tables):
    """The same batches as received: some altered, some with another predecessor, some missing."""
    n = F.col("batch_id")
    altered = F.when(n % 101 == 0, F.sha2("content_sha256", 256)).otherwise(F.col("content_sha256"))
    relinked = F.when(n % 103 == 0, F.sha2("previous_chain_hash", 256)).otherwise(
        F.col("previous_chain_hash")
    )
    return (
        chained_batches(t)
        .where(n % 107 != 0)
        .withColumn("declared_sha256", F.col("content_sha256"))
        .withColumn("content_sha256", altered)
        .withColumn("previous_chain_hash", relinked)
    )


X.define(
    "ob",
    """SELECT batch_id, client_id, place, session_id, sequence_number, content_sha256,
    sha256('{"batch":'||batch_id||',"client":"'||client_id||'","sequence":'||sequence_number||',"session":"'||session_id||'"}') AS core_sha256 FROM
  (SELECT o_orderkey AS batch_id, 'customer-'||o_custkey AS client_id, place, 's'||lpad(CAST(place//4 AS VARCHAR),4,'0') AS session_id, place%4 AS sequence_number,
    sha256('["'||o_orderkey||'","'||o_orderpriority||'"]') AS content_sha256 FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)-1 AS place FROM orders))""",
)
GENESIS_SQL = "repeat('0',64)"
_CHAIN_RECURSION = f"""SELECT client_id, place, {GENESIS_SQL} AS previous_chain_hash, sha256(unhex({GENESIS_SQL})||unhex(content_sha256)||unhex(core_sha256)) AS chain_hash FROM ob WHERE place=0
  UNION ALL SELECT o.client_id, o.place, c.chain_hash, sha256(unhex(c.chain_hash)||unhex(o.content_sha256)||unhex(o.core_sha256)) FROM chain c JOIN ob o ON o.client_id=c.client_id AND o.place=c.place+1"""
X.define(
    "received",
    """SELECT o.batch_id, o.client_id, o.session_id, o.sequence_number, o.place, o.core_sha256, c.chain_hash, o.content_sha256 AS declared_sha256,
    CASE WHEN batch_id%101=0 THEN sha256(o.content_sha256) ELSE o.content_sha256 END AS content_sha256,
    CASE WHEN batch_id%103=0 THEN sha256(c.previous_chain_hash) ELSE c.previous_chain_hash END AS previous_chain_hash
  FROM ob o JOIN chain c USING (client_id, place) WHERE batch_id%107<>0""",
    "ob chain",
)
X.define("chain", _CHAIN_RECURSION, "ob")


def chain_parts(names: str, body: str) -> str:
    """Parts with the recursive chain, and what follows accepted batches, among them."""
    return with_parts(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def following(base: str) -> str:
    """Batches of ``base`` (with place and eligible), one after the other per client: the head is the last
    accepted commitment; a session expects position 0 or the one after its last accepted batch. Sessions do
    not overlap here, so the open session's last accepted batch is the client's."""
    verdict = f"""CASE WHEN b.sequence_number<>CASE WHEN f.session_id=b.session_id THEN f.accepted_to+1 ELSE 0 END THEN 'sequence-gap'
        WHEN b.previous_chain_hash<>coalesce(f.head,{GENESIS_SQL}) THEN 'wrong-predecessor' ELSE 'continuous' END"""
    fits = f"({verdict})='continuous' AND b.eligible"
    return f"""SELECT client_id, 0::BIGINT AS n, NULL::BIGINT AS batch_id, NULL::VARCHAR AS session_id, -1::BIGINT AS accepted_to, NULL::VARCHAR AS head, NULL::VARCHAR AS continuity
      FROM (SELECT DISTINCT client_id FROM {base})
    UNION ALL SELECT b.client_id, b.n, b.batch_id, b.session_id,
      CASE WHEN {fits} THEN b.sequence_number WHEN f.session_id=b.session_id THEN f.accepted_to ELSE -1 END,
      CASE WHEN {fits} THEN b.chain_hash ELSE f.head END, {verdict}
    FROM __SELF__ f JOIN (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY place) AS n FROM {base}) b ON b.client_id=f.client_id AND b.n=f.n+1"""


LINK_SQL = "chain_hash=sha256(unhex(previous_chain_hash)||unhex(content_sha256)||unhex(core_sha256))"
X.define("eligible_links", f"SELECT *, {LINK_SQL} AS eligible FROM received", "received")
X.define("cont", following("eligible_links").replace("__SELF__", "cont"), "eligible_links")


@query(
    "i1_chain_links",
    "I1 A4",
    chain_parts(
        "received",
        """SELECT batch_id, chain_hash, chain_hash=sha256(unhex(previous_chain_hash)||unhex(content_sha256)||unhex(core_sha256)) AS link_valid FROM received""",
    ),
)
def chain_links(t: Tables):
    return integrity.verify_links(received_batches(t)).select("batch_id", "chain_hash", "link_valid")


def followed_batches(t: Tables):
    """Continuity where a batch is eligible if its own chain link is right."""
    return integrity.verify_continuity(integrity.verify_links(received_batches(t)), F.col("link_valid"))


@query(
    "i2_session_continuity",
    "I2 W13",
    chain_parts(
        "received cont",
        """SELECT c.batch_id, r.sequence_number::INTEGER AS sequence_number, c.continuity FROM cont c JOIN received r USING (batch_id)""",
    ),
)
def session_continuity(t: Tables):
    return followed_batches(t).select("batch_id", "sequence_number", "continuity")


@query(
    "i2_continuity_counts",
    "I2",
    chain_parts(
        "cont",
        """SELECT session_id, continuity, count(*) AS batch_count, count(DISTINCT client_id) AS client_count FROM cont WHERE n>0 GROUP BY 1,2""",
    ),
)
def continuity_counts(t: Tables):
    return followed_batches(t).groupBy("session_id", "continuity").agg(
        F.count(F.lit(1)).alias("batch_count"), F.count_distinct("client_id").alias("client_count")
    )


def custody_events(t: Tables):
    """Turns of a conversation as the events of one custody chain."""
    turns = t.conversations.select("conv_id", "turn", "role", F.sha2("text", 256).alias("object_sha256"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "object_sha256")
    return turns.withColumn("sequence_number", F.row_number().over(order) - 1)


def custody_core():
    return {
        "action": F.col("role"),
        "actor": F.concat(F.lit("conv-"), "conv_id"),
        "object": F.col("object_sha256"),
        "sequence": F.col("sequence_number"),
    }


X.define(
    "turns",
    """SELECT *, conv_id*7+n AS k FROM (SELECT conv_id, role, object_sha256, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, object_sha256)-1 AS n FROM
    (SELECT conv_id, turn, role, sha256(text) AS object_sha256 FROM conversations))""",
)


@query(
    "i3_custody_chain",
    "I3 W13",
    with_parts(
        "turns",
        """SELECT a.conv_id, CAST(a.n AS INTEGER) AS sequence_number, a.n=0 OR b.n IS NOT NULL AS sequence_valid,
      CASE WHEN a.n>0 AND b.n IS NULL THEN false ELSE a.k%19<>0 END AS predecessor_valid, a.k%23<>0 AS digest_valid
    FROM (SELECT * FROM turns WHERE k%29<>28) a LEFT JOIN (SELECT * FROM turns WHERE k%29<>28) b ON b.conv_id=a.conv_id AND b.n=a.n-1""",
    ),
)
def custody_chain(t: Tables):
    k = F.col("conv_id") * 7 + F.col("sequence_number")
    events = custody_events(t).withColumn("event_hash", S.object_digest(custody_core()))
    linked = integrity.predecessor(events, ["conv_id"], "sequence_number", ["event_hash"])
    recorded = linked.withColumn(
        "previous_event_hash",
        F.when(k % 19 == 0, F.sha2("event_hash", 256)).otherwise(
            F.coalesce("previous_event_hash", F.lit(integrity.GENESIS))
        ),
    ).where(k % 29 != 28)
    tampered = recorded.withColumn(
        "object_sha256",
        F.when(k % 23 == 0, F.sha2("object_sha256", 256)).otherwise(F.col("object_sha256")),
    )
    return integrity.verify_custody(tampered, custody_core(), ["conv_id"])


def monthly_rounds(t: Tables):
    """Months of shipped lines as training rounds with model and record digests."""
    months = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q")
    )
    numbered = months.withColumn("round", F.row_number().over(Window.orderBy("month")))
    model = F.sha2(F.concat_ws(":", "month", F.col("n").cast("string"), F.col("q").cast("string")), 256)
    return numbered.withColumn("model_sha256", model).withColumn(
        "record_sha256", F.sha2(F.concat_ws("/", F.col("round").cast("string"), "model_sha256"), 256)
    )


@query(
    "i4_round_chain",
    "I4",
    """WITH m AS (SELECT CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS round FROM (SELECT DISTINCT strftime(l_shipdate,'%Y-%m') AS month FROM lineitem))
    SELECT round, round=1 OR (round-1)%13<>0 AS contiguous, round=1 OR ((round-1)%13<>0 AND round%7<>0) AS hash_chain_valid,
      round=1 OR ((round-1)%13<>0 AND round%11<>0) AS base_model_valid FROM m WHERE round%13<>0""",
)
def round_chain(t: Tables):
    linked = integrity.predecessor(
        monthly_rounds(t), [], "round", ["record_sha256", "model_sha256"], "p_"
    )
    r = F.col("round")
    recorded = linked.select(
        "round",
        "model_sha256",
        "record_sha256",
        F.when(r % 7 == 0, F.sha2("model_sha256", 256))
        .otherwise(F.coalesce("p_record_sha256", F.lit(integrity.GENESIS)))
        .alias("previous_round_sha256"),
        F.when(r % 11 == 0, F.lit(integrity.GENESIS)).otherwise(F.col("p_model_sha256")).alias("base_model_sha256"),
    ).where(r % 13 != 0)
    return integrity.verify_rounds(recorded)


@query(
    "i5_register_replay",
    "I5",
    f"""SELECT l_orderkey, list_reduce(list_prepend({GENESIS_SQL}, list(h ORDER BY s)), lambda a, b: sha256(unhex(a)||unhex(b))) AS register_value, count(*) AS event_count, true AS contiguous
    FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)-1 AS s,
      sha256('["'||l_partkey||'","'||l_suppkey||'"]') AS h FROM lineitem) GROUP BY l_orderkey""",
)
def register_replay(t: Tables):
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    log = t.lineitem.select(
        "l_orderkey",
        (F.row_number().over(order) - 1).alias("sequence_number"),
        S.canonical_digest("l_partkey", "l_suppkey").alias("measurement_sha256"),
    )
    return integrity.replay_registers(log, "l_orderkey", "sequence_number", "measurement_sha256")


DECIDED_AT = 20


def admission_inputs(t: Tables):
    """Received batches, customers as identities, one attestation per client and session."""
    received = integrity.verify_links(received_batches(t))
    n = F.col("batch_id")
    batches = received.withColumns(
        {
            "node_id": F.concat(F.lit("node-"), F.col("client_id")),
            "observed_sha256": F.col("content_sha256"),
            "content_sha256": F.col("declared_sha256"),
            "content_size": n % 1000,
            "observed_size": n % 1000 + F.when(n % 109 == 0, 1).otherwise(0),
            "signature_valid": n % 113 != 0,
            "attestation_id": F.concat_ws("/", "client_id", "session_id"),
            "attestation_sha256": F.sha2(F.concat_ws("/", "client_id", "session_id"), 256),
            "decided_at": F.lit(DECIDED_AT),
        }
    )
    key = F.col("c_custkey")
    identities = t.customer.where(key % 127 != 0).select(
        F.concat(F.lit("customer-"), "c_custkey").alias("client_id"),
        F.when(key % 31 == 0, "node-other")
        .otherwise(F.concat(F.lit("node-customer-"), "c_custkey"))
        .alias("node_id"),
        F.when(key % 37 == 0, "revoked").otherwise("active").alias("status"),
        F.lit(0).alias("valid_from"),
        F.when(key % 41 == 0, 10).otherwise(30).alias("valid_until"),
    )
    heads = received.groupBy("client_id", "session_id").agg(F.max("batch_id").alias("_n"))
    name = F.concat_ws("/", "client_id", "session_id")
    m = F.col("_n")
    attestations = heads.where(m % 43 != 0).select(
        name.alias("attestation_id"),
        "client_id",
        F.concat(F.lit("node-"), "client_id").alias("node_id"),
        F.sha2(name, 256).alias("result_sha256"),
        F.when(m % 47 == 0, "failed").when(m % 5 == 0, "passed_with_warning").otherwise("passed").alias("status"),
        F.when(m % 53 == 0, 5).otherwise(25).alias("expires_at"),
        F.when(m % 59 == 0, "software-development").otherwise("hardware").alias("trust_level"),
        (m % 61 != 0).alias("signature_valid"),
    )
    return batches, identities, attestations


X.define(
    "others",
    """SELECT r.*, list_filter([
    CASE WHEN k%127=0 THEN 'registered_identity' END,
    CASE WHEN k%127=0 OR k%31=0 OR k%37=0 OR k%41=0 THEN 'client_node_binding' END,
    CASE WHEN r.content_sha256<>r.declared_sha256 THEN 'content_digest' END,
    CASE WHEN r.batch_id%109=0 THEN 'content_size' END,
    CASE WHEN r.chain_hash<>sha256(unhex(r.previous_chain_hash)||unhex(r.content_sha256)||unhex(r.core_sha256)) THEN 'canonical_chain_commitment' END,
    CASE WHEN k%127=0 OR r.batch_id%113=0 THEN 'evidence_signature' END,
    CASE WHEN m%43=0 THEN 'attestation_reference' END,
    CASE WHEN m%43=0 OR m%61=0 THEN 'attestation_signature' END,
    CASE WHEN m%43=0 THEN 'attestation_identity_binding' END,
    CASE WHEN m%43=0 OR m%47=0 THEN 'attestation_status' END,
    CASE WHEN m%43=0 OR m%53=0 THEN 'attestation_freshness' END,
    CASE WHEN m%43=0 OR m%59=0 THEN 'attestation_trust_level' END], lambda x: x IS NOT NULL) AS failed
  FROM (SELECT *, CAST(substr(client_id,10) AS BIGINT) AS k, max(batch_id) OVER (PARTITION BY client_id, session_id) AS m FROM received) r""",
    "received",
)
X.define("eligible_batches", "SELECT *, len(failed)=0 AS eligible FROM others", "others")
X.define("followed", following("eligible_batches").replace("__SELF__", "followed"), "eligible_batches")
X.define(
    "checked",
    """SELECT o.batch_id, o.client_id, o.session_id, CASE WHEN f.continuity='continuous' THEN failed ELSE list_append(failed, 'session_sequence_continuity') END AS failed
  FROM others o JOIN followed f USING (batch_id)""",
    "others followed",
)


def admitted(t: Tables):
    return admission.admit_batches(*admission_inputs(t), trust_levels=["hardware"])


@query(
    "i6_admission_decisions",
    "I6 J5 J6",
    chain_parts(
        "checked",
        """SELECT batch_id, CASE WHEN len(failed)=0 THEN 'accepted' ELSE 'quarantined' END AS decision, len(failed)::INTEGER AS failed_count, coalesce(array_to_string(failed,','),'') AS failed_checks FROM checked""",
    ),
)
def admission_decisions(t: Tables):
    return admitted(t).select(
        "batch_id",
        "decision",
        F.size("failed_checks").alias("failed_count"),
        F.array_join("failed_checks", ",").alias("failed_checks"),
    )


@query(
    "i6_failed_check_counts",
    "I6",
    chain_parts(
        "checked",
        "SELECT check_name, count(*) AS failed_count FROM (SELECT unnest(failed) AS check_name FROM checked) GROUP BY 1",
    ),
)
def failed_check_counts(t: Tables):
    return admission.failed_check_counts(admitted(t))


@query(
    "i8_aggregation_gate",
    "I8",
    chain_parts(
        "checked",
        """SELECT client_id, session_id, count(*) AS submitted_count, count(*) FILTER (len(failed)=0) AS accepted_count, count(*) FILTER (len(failed)>0) AS quarantined_count,
      4-count(*) AS missing_count, count(*) FILTER (len(failed)=0)=4 AND count(*) FILTER (len(failed)>0)=0 AS aggregate_allowed FROM checked GROUP BY 1,2""",
    ),
)
def aggregation_gate(t: Tables):
    return admission.round_gate(admitted(t), ["client_id", "session_id"], SESSION_BATCHES)


@query(
    "i7_replays_and_conflicts",
    "I7",
    """SELECT l_orderkey, l_linenumber, commitment, copies, first_arrival, CASE WHEN r=1 THEN 'accepted' ELSE 'conflict' END AS status, CASE WHEN r=1 THEN copies-1 ELSE 0 END AS replay_count
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY first_arrival, commitment) AS r FROM
      (SELECT l_orderkey, l_linenumber, sha256('["'||l_returnflag||'","'||l_linestatus||'"]') AS commitment, count(*) AS copies, min(l_partkey) AS first_arrival FROM lineitem GROUP BY 1,2,3))""",
)
def replays_and_conflicts(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        S.canonical_digest("l_returnflag", "l_linestatus").alias("commitment"),
    )
    return integrity.classify_replays(rows, ["l_orderkey", "l_linenumber"], "commitment", "l_partkey")


def revocation_tables(t: Tables):
    enrollments = t.customer.select(F.col("c_custkey").alias("enrollment_id"), "c_mktsegment")
    revocations = t.orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("enrollment_id"), F.col("o_orderdate").alias("revoked_at")
    )
    return enrollments, revocations


@query(
    "j7_revocation_as_of",
    "J7",
    """SELECT c_custkey AS enrollment_id, c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F' AND o_orderpriority='1-URGENT' AND o_orderdate<=TIMESTAMP '1999-01-01') AS revoked FROM customer""",
)
def revocation_as_of(t: Tables):
    enrollments, revocations = revocation_tables(t)
    return admission.revoked_as_of(
        enrollments, revocations, F.lit("1999-01-01").cast("timestamp_ntz")
    )


@query(
    "j7_never_revoked",
    "J7",
    """SELECT c_custkey AS enrollment_id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT')""",
)
def never_revoked(t: Tables):
    return admission.unrevoked(*revocation_tables(t))


@query(
    "i12_table_digests",
    "I12 S4",
    """SELECT o_orderstatus, n AS row_count, sha256(n||':'||p0||':'||p1||':'||p2||':'||p3) AS table_sha256 FROM (
      SELECT o_orderstatus, count(*) AS n, """
    + ", ".join(f"sum(('0x'||substr(d,{1 + 15 * i},15))::UBIGINT::HUGEINT) AS p{i}" for i in range(4))
    + """ FROM (SELECT o_orderstatus, sha256('["'||o_orderkey||'","'||o_custkey||'"]') AS d FROM orders) GROUP BY 1)""",
)
def table_digests(t: Tables):
    from tracelight.operators.splitting import table_digest

    return table_digest(t.orders, ["o_orderkey", "o_custkey"], ["o_orderstatus"])
