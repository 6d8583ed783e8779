import hashlib

import pytest
from pyspark.sql import functions as F

from tracelight.functions import scalars as S
from tracelight.operators import admission as A
from tracelight.operators import cases as C
from tracelight.operators import integrity as I
from tracelight.operators import lineage as L
from tracelight.plans import catalog, evidence


def sha(b):
    return hashlib.sha256(b).hexdigest()


def batches(spark, clients=3, sessions=2, length=3):
    rows = []
    for c in range(clients):
        place = 0
        for s in range(sessions):
            for q in range(length):
                name = f"{c}-{s}-{q}"
                rows.append((f"c{c}", f"s{s}", q, place, sha(name.encode()), sha(b"core" + name.encode())))
                place += 1
    return spark.createDataFrame(rows, "client_id string, session_id string, sequence_number int, acquired_at int, content_sha256 string, core_sha256 string")


def chain(spark, **size):
    built = I.build_chain(batches(spark, **size), ["client_id"], ["acquired_at"])
    linked = I.predecessor(built, ["client_id"], "acquired_at", ["chain_hash"])
    return linked.withColumn("previous_chain_hash", F.coalesce("previous_chain_hash", F.lit(I.GENESIS)))


def test_chain_is_the_sequential_hash(spark):
    rows = chain(spark, clients=2, sessions=1, length=40).orderBy("client_id", "acquired_at").collect()
    value = bytes(32)
    for r in rows[:40]:
        value = hashlib.sha256(value + bytes.fromhex(r["content_sha256"]) + bytes.fromhex(r["core_sha256"])).digest()
        assert r["chain_hash"] == value.hex()
    assert rows[40]["previous_chain_hash"] == I.GENESIS


def test_valid_chain_verifies_and_tampering_shows(spark):
    good = chain(spark)
    assert I.verify_links(good).where("NOT link_valid").count() == 0
    assert {r["continuity"] for r in I.verify_continuity(good).collect()} == {"continuous"}
    at = (F.col("client_id") == "c1") & (F.col("session_id") == "s1") & (F.col("sequence_number") == 1)
    changed = good.withColumn("content_sha256", F.when(at, F.lit("0" * 64)).otherwise(F.col("content_sha256")))
    assert I.verify_links(changed).where("NOT link_valid").count() == 1
    holes = I.verify_continuity(good.where(~at)).where("continuity <> 'continuous'").collect()
    assert [(r["client_id"], r["session_id"], r["sequence_number"], r["continuity"]) for r in holes] == [("c1", "s1", 2, "sequence-gap")]
    relinked = good.withColumn("previous_chain_hash", F.when((F.col("sequence_number") == 0) & (F.col("session_id") == "s1"), F.lit(I.GENESIS)).otherwise(F.col("previous_chain_hash")))
    after = I.verify_continuity(relinked).groupBy("continuity").count().collect()
    assert {r[0]: r[1] for r in after} == {"continuous": 9, "wrong-predecessor": 3, "sequence-gap": 6}


def test_only_accepted_batches_move_the_chain_on(spark):
    good = chain(spark, clients=2, sessions=3)
    refused = (F.col("client_id") == "c0") & (F.col("session_id") == "s0") & (F.col("sequence_number") == 1)
    out = I.verify_continuity(good, ~refused)
    got = {(r["client_id"], r["session_id"], r["sequence_number"]): r["continuity"] for r in out.collect()}
    assert [got["c0", "s0", i] for i in range(3)] == ["continuous", "continuous", "sequence-gap"]
    assert [got["c0", "s1", i] for i in range(3)] == ["wrong-predecessor", "sequence-gap", "sequence-gap"]
    assert got["c0", "s2", 0] == "wrong-predecessor" and {v for k, v in got.items() if k[0] == "c1"} == {"continuous"}
    # A later session that links to the last accepted batch is taken up again.
    head = good.where("client_id = 'c0' AND session_id = 's0' AND sequence_number = 0").first()["chain_hash"]
    first = (F.col("client_id") == "c0") & (F.col("session_id") == "s2") & (F.col("sequence_number") == 0)
    again = good.withColumn("previous_chain_hash", F.when(first, F.lit(head)).otherwise(F.col("previous_chain_hash")))
    got = {(r["client_id"], r["session_id"], r["sequence_number"]): r["continuity"] for r in I.verify_continuity(again, ~refused).collect()}
    assert [got["c0", "s2", i] for i in range(3)] == ["continuous"] * 3 and got["c0", "s1", 0] == "wrong-predecessor"


def test_redeliveries_and_conflicts_neither_multiply_nor_move_the_chain(spark):
    good = chain(spark, clients=1, sessions=2)
    later = good.withColumn("acquired_at", F.col("acquired_at") + 100)
    other = later.where("session_id = 's0' AND sequence_number = 1").withColumn("chain_hash", F.lit("f" * 64))
    out = I.verify_continuity(good.union(later).union(other))
    assert out.count() == 13
    assert {r["continuity"] for r in out.where(F.col("chain_hash") != "f" * 64).collect()} == {"continuous"}
    assert out.where(F.col("chain_hash") == "f" * 64).first()["continuity"] == "conflicting-commitment"


def test_register_replay_and_contiguity(spark):
    rows = [("pcr0", i, sha(str(i).encode())) for i in range(300)] + [("pcr1", 0, sha(b"x")), ("pcr1", 2, sha(b"y"))]
    out = {r["register"]: r for r in I.replay_registers(spark.createDataFrame(rows, "register string, seq int, m string"), "register", "seq", "m").collect()}
    value = bytes(32)
    for i in range(300):
        value = hashlib.sha256(value + hashlib.sha256(str(i).encode()).digest()).digest()
    assert out["pcr0"]["register_value"] == value.hex() and out["pcr0"]["contiguous"]
    assert not out["pcr1"]["contiguous"]


def test_custody_chain(spark):
    events = spark.createDataFrame([(i, f"action-{i}") for i in range(4)], "sequence_number int, action string")
    core = {"action": F.col("action"), "sequence": F.col("sequence_number")}
    hashed = events.withColumn("event_hash", S.object_digest(core))
    linked = I.predecessor(hashed, [], "sequence_number", ["event_hash"]).withColumn("previous_event_hash", F.coalesce("previous_event_hash", F.lit(I.GENESIS)))
    assert I.verify_custody(linked, core).where("NOT (sequence_valid AND predecessor_valid AND digest_valid)").count() == 0
    edited = linked.withColumn("action", F.when(F.col("sequence_number") == 2, "other").otherwise(F.col("action")))
    assert [r[0] for r in I.verify_custody(edited, core).where("NOT digest_valid").select("sequence_number").collect()] == [2]
    cut = I.verify_custody(linked.where("sequence_number <> 1"), core)
    assert [r[0] for r in cut.where("NOT sequence_valid").select("sequence_number").collect()] == [2]


def test_replays_are_counted_and_conflicts_kept(spark):
    rows = [("k", "h1", 5)] * 500 + [("k", "h2", 9), ("k", "h1", 1), ("j", "h3", 2)]
    out = {(r["key"], r["hash"]): r for r in I.classify_replays(spark.createDataFrame(rows, "key string, hash string, at int"), ["key"], "hash", "at").collect()}
    assert out["k", "h1"]["status"] == "accepted" and out["k", "h1"]["replay_count"] == 500
    assert out["k", "h2"]["status"] == "conflict" and out["j", "h3"]["replay_count"] == 0


BATCH = dict(
    batch_id=1, client_id="c", node_id="n", attestation_id="a", attestation_sha256="d", observed_sha256="x", content_sha256="x",
    observed_size=3, content_size=3, link_valid=True, signature_valid=True, session_id="s", sequence_number=0, acquired_at=1,
    chain_hash="h", previous_chain_hash=I.GENESIS, decided_at=10,
)
SCHEMA = "batch_id int, client_id string, node_id string, attestation_id string, attestation_sha256 string, observed_sha256 string, content_sha256 string, observed_size int, content_size int, link_valid boolean, signature_valid boolean, session_id string, sequence_number int, acquired_at int, chain_hash string, previous_chain_hash string, decided_at int"


@pytest.mark.parametrize(
    "change,failed",
    [
        ({}, []),
        ({"observed_sha256": "y"}, ["content_digest"]),
        ({"observed_size": 4}, ["content_size"]),
        ({"node_id": "other"}, ["client_node_binding", "attestation_identity_binding"]),
        ({"client_id": "nobody"}, ["registered_identity", "client_node_binding", "evidence_signature", "attestation_identity_binding"]),
        ({"decided_at": 21}, ["client_node_binding", "attestation_freshness"]),
        ({"decided_at": 16}, ["attestation_freshness"]),
        ({"attestation_sha256": "z"}, ["attestation_reference"]),
        ({"sequence_number": 1}, ["session_sequence_continuity"]),
        ({"previous_chain_hash": "0"}, ["session_sequence_continuity"]),
        ({"signature_valid": False}, ["evidence_signature"]),
        ({"attestation_id": "none"}, ["attestation_reference", "attestation_signature", "attestation_identity_binding", "attestation_status", "attestation_freshness", "attestation_trust_level"]),
    ],
)
def test_admission_checks(spark, change, failed):
    row = {**BATCH, **change}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA)
    identities = spark.createDataFrame([("c", "n", "active", 0, 20)], "client_id string, node_id string, status string, valid_from int, valid_until int")
    attestations = spark.createDataFrame([("a", "c", "n", "d", "passed", 15, "hardware", True)], "attestation_id string, client_id string, node_id string, result_sha256 string, status string, expires_at int, trust_level string, signature_valid boolean")
    out = A.admit_batches(df, identities, attestations, trust_levels=["hardware"]).first()
    assert out["failed_checks"] == failed
    assert out["decision"] == ("quarantined" if failed else "accepted") and len(out["checks"]) == 13


def test_round_gate_is_all_or_nothing(spark):
    rows = [("r1", "accepted")] * 3 + [("r2", "accepted")] * 2 + [("r3", "accepted")] * 3 + [("r3", "quarantined")]
    out = {r["round"]: r for r in A.round_gate(spark.createDataFrame(rows, "round string, decision string"), ["round"], 3).collect()}
    assert [out[r]["aggregate_allowed"] for r in ("r1", "r2", "r3")] == [True, False, False]
    assert out["r2"]["missing_count"] == 1


def test_revocation_as_of(spark):
    who = spark.createDataFrame([("a",), ("b",), ("c",)], "enrollment_id string")
    gone = spark.createDataFrame([("a", 5), ("a", 50), ("b", 20)], "enrollment_id string, revoked_at int")
    assert {r["enrollment_id"]: r["revoked"] for r in A.revoked_as_of(who, gone, F.lit(10)).collect()} == {"a": True, "b": False, "c": False}
    assert [r[0] for r in A.unrevoked(who, gone).collect()] == ["c"]


def test_lineage_gaps(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    resolved = L.resolve_lineage(
        t([("w1",), ("w2",), ("w3",), ("w4",)], "window_id string"),
        t([("w1", "e1"), ("w2", "e2"), ("w3", "e3")], "window_id string, event_id string"),
        t([("e1", "f1"), ("e1", "f1"), ("e2", "f2")], "event_id string, source_file string"),
        t([("f1", "d")], "source_file string, file_sha256 string"),
    )
    got = {r["window_id"]: r["resolution"] for r in resolved.collect()}
    assert got == {"w1": "resolved", "w2": "no-source-file", "w3": "no-source-record", "w4": "no-event"}
    c = L.completeness_counts(resolved).first()
    assert (c["complete_window_count"], c["incomplete_window_count"], c["invariant_violation_count"]) == (1, 3, 3)
    w = {r["window_id"]: (r["event_count"], r["source_record_count"]) for r in L.window_completeness(resolved).collect()}
    assert w == {"w1": (1, 2), "w2": (1, 1), "w3": (1, 0), "w4": (0, 0)}


def test_coverage_names_the_problem(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, c string")
    out = L.coverage({"p": t([("1", "a"), ("2", "a"), ("3", "a")]), "q": t([("1", "a"), ("2", "b"), ("2", "b")])}, "id", ["c"])
    assert {r["id"]: r["status"] for r in out.collect()} == {"1": "covered", "2": "repeated-q,different-c", "3": "missing-q"}


def test_hypotheses_use_the_class_alone(spark):
    rows = [("p1", "exfiltration", "x"), ("p2", "benign", "y"), ("p3", "multi_tactic", "z")]
    df = spark.createDataFrame(rows, "prediction_id string, predicted_class string, reference_label string")
    rules = C.rule_table(spark)
    one = {r["prediction_id"]: r["mapping_id"] for r in C.tactic_hypotheses(df, rules, "1").collect()}
    two = {r["prediction_id"]: r["mapping_id"] for r in C.tactic_hypotheses(df.withColumn("reference_label", F.lit("other")), rules, "1").collect()}
    assert one == two
    counts = C.status_counts(C.tactic_hypotheses(df, rules, "1")).first()
    assert (counts["candidate_tactic_count"], counts["not_applicable_count"], counts["unresolved_multi_tactic_count"]) == (1, 1, 1)
    with pytest.raises(Exception, match="no tactic rule for class"):
        C.tactic_hypotheses(df.withColumn("predicted_class", F.lit("odd")), rules, "1").collect()


def test_packed_digests_are_half_as_long_and_come_back(spark):
    given = [sha(b"a"), sha(b"a").upper(), sha(b"b") + "\n", "", "no digest é", "0" * 64, None]
    rows = spark.createDataFrame([(g,) for g in given], "d string").withColumn("p", S.pack_digest("d"))
    got = rows.select("d", S.unpack_digest("p").alias("back"), F.octet_length("p").alias("n")).collect()
    assert [r["back"] for r in got] == given and [r["n"] for r in got][::5] == [32, 32]
    assert len({r["p"] for r in rows.collect()}) == len(given)


def test_late_digests_and_the_digest_before(spark):
    rows = batches(spark)
    late = lambda df: df.withColumn("content_sha256", F.sha2("content_sha256", 256))
    got = I.build_chain(rows, ["client_id"], ["acquired_at"], late=late, previous="before")
    want = I.predecessor(I.build_chain(late(rows), ["client_id"], ["acquired_at"]), ["client_id"], "acquired_at", ["chain_hash"], "p_")
    want = want.withColumn("before", F.coalesce("p_chain_hash", F.lit(I.GENESIS))).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_received_batches_are_stored_with_packed_digests(spark, tmp_path):
    rows = [(i, i % 7, f"1995-0{1 + i % 9}-01", f"{i % 3}-P") for i in range(300)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(str(tmp_path / "orders.parquet"))
    t = catalog.Tables(spark, str(tmp_path))
    got, built = evidence.received_batches(t), evidence.build_received(t)
    assert got.columns == built.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, built.collect()))
    kept = t.stored("received", evidence.build_received)
    assert {kept.schema[c].dataType.simpleString() for c in evidence.DIGESTS} == {"binary"}
    assert kept.where("declared_sha256 IS NOT NULL").count() == built.where("declared_sha256 <> content_sha256").count()


def test_lineage_digests_come_back_as_given(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    events, given = table([("w", "e"), ("w", "f"), ("w", "f")], "window_id string, event_id string"), [sha(b"1"), "none"]
    sources = table([("e", "a", given[0]), ("f", "b", given[1])], "event_id string, source_file string, record_sha256 string")
    files = table([("a", given[0])], "source_file string, file_sha256 string")
    out = L.resolve_lineage(table([("w",), ("x",)], "window_id string"), events, sources, files)
    got = sorted(tuple(r) for r in out.select("record_sha256", "file_sha256", "resolution").fillna("").collect())
    assert got == sorted([(given[0], given[0], "resolved"), (given[1], "", "no-source-file"), ("", "", "no-event")])
    assert "unhex" in out._jdf.queryExecution().optimizedPlan().toString()
