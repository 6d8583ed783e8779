import hashlib

import pytest
from pyspark.sql import functions as F

from tracelight.sources import manifests, scans, sinks


@pytest.fixture()
def connections(tmp_path):
    header = ",".join(scans.CONNECTION_COLUMNS)
    rows = []
    for i in range(3):
        cells = [f"v{i}-{c}" for c in scans.CONNECTION_COLUMNS]
        cells[2], cells[18] = "", "-"
        rows.append(",".join(cells))
    folder = tmp_path / "csv" / "Benign"
    folder.mkdir(parents=True)
    (folder / "part.csv").write_text(header + "\n" + "\n".join(rows) + "\n")
    return tmp_path


def test_strict_csv_reads_every_cell_as_text(spark, connections):
    rows = scans.read_strict_csv(spark, str(connections / "csv" / "Benign")).orderBy("uid").collect()
    assert len(rows) == 3 and rows[1]["uid"] == "v1-uid" and rows[1]["duration"] == "" and rows[1]["service"] == "-"
    assert rows[0]["source_file"].endswith("part.csv")


def test_wrong_header_fails(spark, connections):
    path = connections / "csv" / "Benign" / "part.csv"
    path.write_text(path.read_text().replace("uid,datetime", "datetime,uid"))
    with pytest.raises(Exception):
        scans.read_strict_csv(spark, str(path)).collect()


def test_csv_lines_keep_the_line_digest(spark):
    lines = spark.createDataFrame([('a,"x,1",c',), ("  ",), ("d,,f",)], "value string")
    rows = {r["k"]: r for r in scans.parse_csv_lines(lines, ["k", "m", "n"]).collect()}
    assert rows["a"]["m"] == "x,1" and rows["d"]["m"] == ""
    assert rows["d"]["raw_line_sha256"] == hashlib.sha256(b"d,,f").hexdigest()
    for bad in ("a,b", "a,b,c,d"):
        with pytest.raises(Exception, match="does not hold 3 values"):
            scans.parse_csv_lines(spark.createDataFrame([(bad,)], "value string"), ["k", "m", "n"]).collect()


def test_exact_parquet_and_text_forms(spark, tmp_path):
    df = spark.sql("SELECT 1.5D AS d, true AS b, timestamp_ntz'2024-01-02 03:04:05' AS t, timestamp_ntz'2024-01-02 03:04:05.25' AS u, double('nan') AS n, CAST(NULL AS bigint) AS z")
    df.write.parquet(str(tmp_path / "t"))
    read = scans.read_exact_parquet(spark, str(tmp_path / "t"), ["d", "b", "t", "u", "n", "z"])
    assert tuple(scans.stringify(read).first()) == ("1.5", "true", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250000Z", "", "")
    with pytest.raises(ValueError, match="unexpected columns"):
        scans.read_exact_parquet(spark, str(tmp_path / "t"), ["d", "b"])


def test_manifest_finds_every_kind_of_difference(spark, tmp_path):
    for name in ("same", "edited", "grown", "extra"):
        (tmp_path / f"{name}.bin").write_bytes(name.encode())
    facts = manifests.file_facts(spark, str(tmp_path), "*.bin")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    declared = spark.createDataFrame(
        [("same.bin", 4, digest(b"same")), ("edited.bin", 6, digest(b"other!")), ("grown.bin", 4, digest(b"grow")), ("gone.bin", 1, digest(b"x"))],
        "relative_path string, size_bytes bigint, sha256 string",
    )
    status = {r["relative_path"]: r["status"] for r in manifests.verify_manifest(declared, facts).collect()}
    assert status == {"same.bin": "verified", "edited.bin": "digest-mismatch", "grown.bin": "size-mismatch", "gone.bin": "missing", "extra.bin": "unmanifested"}


def test_write_once(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    path = str(tmp_path / "table")
    assert sinks.write_once(df, path) == "written"
    assert sinks.write_once(df.repartition(3), path) == "unchanged"
    with pytest.raises(sinks.DifferentContent):
        sinks.write_once(df.unionByName(df.limit(1)), path)
    with pytest.raises(sinks.DifferentContent):
        sinks.write_once(df.drop("x"), path)


def test_objects_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)], "text string")
    path = str(tmp_path / "objects")
    for _ in range(2):
        sinks.write_objects(sinks.object_table(df, "text"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    assert stored.where("content = 'a'").first()["digest"] == hashlib.sha256(b"a").hexdigest()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    for kind, read in (("csv", spark.read.option("header", True).csv), ("json", spark.read.json)):
        sinks.write_report(df, str(tmp_path / kind), ["v", "k"], kind)
        assert read(str(tmp_path / kind)).count() == 1
    line = df.select(sinks.markdown_table_line(["k", "v"]).alias("line"))
    sinks.write_report(line, str(tmp_path / "md"), ["line"], "text")
    assert spark.read.text(str(tmp_path / "md")).first()[0] == "| a | 1.5 |"
