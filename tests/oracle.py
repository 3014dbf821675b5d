"""Holds a registered query's rows against its DuckDB equivalent on the same tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value as both engines give it: floats to 9 significant digits, arrays as tuples."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "as_tuple"):
        return float(f"{float(value):.9g}")
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    found = connect(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first of one side: {sorted(set(got) ^ set(want), key=repr)[:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    at, only = sys.argv[1], sys.argv[2:]
    sqls = entry.oracle_sql()
    for name, f in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            said = compare(session, f, sqls[name], at) or "same" if name in sqls else f"{f(session, at).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:600]}"
        print(f"{name}: {said[:700]} ({time.time() - began:.1f} s)", flush=True)
