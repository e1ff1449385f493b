"""Rows of a query against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"create view {name} as select * from read_parquet('{files}')")
    return con.sql(sql).df()


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def _plain(value):
    if pd.isna(value):
        return "null"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float) or "float" in type(value).__name__:
        return repr(float(value))
    return str(value)


def in_order(frame):
    columns = sorted(frame.columns)
    return columns, [tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]


def assert_same(df, sql: str, sf_dir: str = SF):
    """Equal rows; in equal order too, where the query sorts its result."""
    as_rows = in_order if "order by" in sql.lower().rpartition(")")[2] else canonical
    ours, theirs = as_rows(df.toPandas()), as_rows(oracle(sql, sf_dir))
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for a, b in zip(*(x[1] for x in (ours, theirs)), strict=True):
        assert a == b or [_number(x) for x in a] == [_number(x) for x in b], (a, b)


def _number(text: str):
    try:
        return float(text)
    except ValueError:
        return text
