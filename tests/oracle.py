"""Runs a query in Spark and its SQL in DuckDB and compares the rows, in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float) and x.is_integer():
            return str(int(x))
        return str(x)

    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


def assert_same(spark_df, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    got, want = spark_df.toPandas(), c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
