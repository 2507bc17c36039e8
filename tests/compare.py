"""Compare a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return str(value) if value is not None and not isinstance(value, str) else value


def rows_of(df) -> list:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list, list]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
