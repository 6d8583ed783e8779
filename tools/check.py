"""Runs registered queries on Spark and their SQL on DuckDB and compares every value.

usage: python tools/check.py [--sf 0.01] [--only TEXT[,TEXT]] [--explain]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracelight.plans import catalog  # noqa: E402
from tracelight.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def kind(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return type(value).__name__


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value != value:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(pdf):
    columns = sorted(pdf.columns)
    rows = [tuple(plain(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None)]
    return columns, sorted(rows, key=repr)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return type(a) is type(b) and a == b


def compare(spark_pdf, duck_pdf) -> str | None:
    a_cols, a = table(spark_pdf)
    b_cols, b = table(duck_pdf)
    if a_cols != b_cols:
        return f"columns {a_cols} <> {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}; spark {a[:2]} duckdb {b[:2]}"
    exact = sum(x != y for x, y in zip(a, b))
    for x, y in zip(a, b):
        if len(x) != len(y) or not all(close(p, q) for p, q in zip(x, y)):
            return f"{a_cols}\n    spark  {x}\n    duckdb {y}  ({exact} rows differ)"
    kinds = [
        (c, str(spark_pdf[c].dtype), str(duck_pdf[c].dtype))
        for c in a_cols
        if str(spark_pdf[c].dtype)[:3] != str(duck_pdf[c].dtype)[:3]
    ]
    if kinds:
        return f"types differ: {kinds}"
    return f"only rounding: {exact} rows" if exact else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    spark = get_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [w for w in args.only.split(",") if w]
    bad = []
    for name, q in catalog.load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            df = q(spark, folder)
            if args.explain:
                df.explain("formatted")
            got = df.toPandas()
            took = time.time() - begin
            if q.sql is None:
                print(f"{name:45s} {took:6.2f}s rows={len(got)} (no SQL)", flush=True)
                continue
            begin = time.time()
            problem = compare(got, duck.execute(q.sql).df())
            duck_took = time.time() - begin
        except Exception as exc:  # report and go on with the next query
            problem, took, duck_took = f"{type(exc).__name__}: {str(exc)[:900]}", time.time() - begin, 0
            got = []
        print(
            f"{name:45s} {took:6.2f}s duck {duck_took:5.2f}s rows={len(got)} {'ok' if not problem else 'DIFF'}",
            flush=True,
        )
        if problem:
            bad.append(name)
            print("   ", problem, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
