"""Line numbers and offsets over files cut into many byte ranges, against the files themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tracelight.sources import positions, scans


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of 700 bytes, several of one file in a task."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_places_of_all_lines(small_ranges, tmp_path):
    random.seed(1)
    want, end = {}, {}
    for name in ("a", "b", "c", "d", "e"):
        sep = b"\r\n" if name == "b" else b"\n"
        lines = [random.choice(["", "same", "é" * random.randint(1, 9), "x" * random.randint(1, 1500)]).encode() for _ in range(400)]
        body = (b"\xef\xbb\xbf" if name == "c" else b"") + sep.join(lines) + (b"" if name == "d" else sep)
        lines = lines[:-1] if name == "d" and not lines[-1] else lines
        (tmp_path / f"{name}.txt").write_bytes(body if name != "e" else b"")
        at = 3 if name == "c" else 0
        for n, line in enumerate(lines if name != "e" else [], 1):
            want[name, n] = (at, line.decode())
            at += len(line) + len(sep)
    got = positions.read_lines(small_ranges, str(tmp_path)).collect()
    name = {r["source_file"]: r["source_file"].rsplit("/", 1)[1][0] for r in got}
    assert len(got) == len(want)
    assert {(name[r["source_file"]], r["line_number"]): (r["byte_offset"], r["value"]) for r in got} == want
    ranges = positions.line_index(small_ranges, str(tmp_path))
    assert ranges.count() > 20 and ranges.agg(F.sum("lines")).first()[0] == len(want)


def test_csv_records_keep_equal_lines_and_check_headers(small_ranges, tmp_path):
    (tmp_path / "x.csv").write_text("k,m\n" + "a,b\n\n" * 300 + "c,d")
    (tmp_path / "y.csv").write_text("k,m\n")
    rows = scans.read_csv_records(small_ranges, str(tmp_path), ["k", "m"]).orderBy("line_number").collect()
    assert [r["line_number"] for r in rows] == [*range(2, 602, 2), 602] and rows[-1]["k"] == "c"
    assert [r["byte_offset"] for r in rows[:3]] == [4, 9, 14] and len({r["raw_line_sha256"] for r in rows}) == 2
    (tmp_path / "y.csv").write_text("m,k\na,b\n")
    with pytest.raises(Exception, match="wrong header"):
        scans.read_csv_records(small_ranges, str(tmp_path), ["k", "m"]).collect()


def test_two_equal_rejects_are_two(small_ranges, tmp_path):
    good = '{"ts": 1.5, "label": "benign"}'
    (tmp_path / "x.json").write_text("\n".join(["{broken", good, "", "{broken", '{"label": "x"}', good] * 50))
    rows = scans.read_json_records(small_ranges, str(tmp_path))
    bad = rows.where("reject_reason IS NOT NULL").orderBy("line_number").collect()
    assert [r["line_number"] for r in bad[:4]] == [1, 4, 5, 7] and len(bad) == 150
    assert bad[2]["reject_reason"] == "missing_timestamp"
    first = positions.first_bad_lines(rows, ["source_file"], F.col("reject_reason").isNotNull()).first()
    assert (first["record_count"], first["bad_line_count"], first["first_bad_line"], first["first_bad_reason"]) == (100, 150, 1, "invalid_json")
