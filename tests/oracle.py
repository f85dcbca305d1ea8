"""Runs a registered query and its SQL side by side."""

import duckdb
import pandas as pd

TABLES = ("region", "nation", "supplier", "lineitem", "orders", "events", "part", "documents", "pages", "benchmark", "labels")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    return str(int(x)) if isinstance(x, int | float | bool) and float(x) == int(x) else str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    a, b = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
