"""Run registered queries next to their SQL in DuckDB and compare whole results.

    python tests/oracle.py [--sf 0.01] [--times] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, bool) else int(v)) for v in r))
    return [columns[i] for i in order], out


def compare(spark, con, query, sf_dir):
    """(problem or None, Spark rows, seconds)"""
    began = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - began
    names, got = normal(df.columns, rows)
    if query.sql is None:
        return None, len(got), took
    result = con.execute(query.sql)
    expected_names, expected = normal([d[0] for d in result.description], result.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}", len(got), took
    if len(got) != len(expected):
        sample = [r for r in got[:3]], [r for r in expected[:3]]
        return f"rows {len(got)} != {len(expected)}; {sample}", len(got), took
    bad = [(a, b) for a, b in zip(got, expected) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({names}), first {bad[0][0]} != {bad[0][1]}", len(got), took
    if not got:
        return "no rows", 0, took
    return None, len(got), took


def main():
    from tidewire import session
    from tidewire.catalog import registry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = session.build("local[8]", "oracle", 8, spark__driver__memory="8g")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = database(sf_dir)
    failed = 0
    for name, q in registry().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            problem, n, took = compare(spark, con, q, sf_dir)
        except Exception as err:  # noqa: BLE001 - report and go on
            problem, n, took = f"{type(err).__name__}: {str(err)[:600]}", 0, 0.0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:<28} rows={n:<7} {took:5.1f}s {'' if q.sql else '(no sql)'} {problem or ''}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
