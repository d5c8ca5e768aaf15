"""Rows of a query against rows of its SQL."""

import glob
import os

import duckdb


def canonical(value):
    if hasattr(value, "asDict"):
        value = list(value.asDict().values())
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return repr(value) if isinstance(value, float) else str(value)


def views(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        inside = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{inside}'")
    return c


def assert_same(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted("|".join(canonical(r[c]) for c in columns) for r in df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted("|".join(canonical(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want
