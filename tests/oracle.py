"""Comparing a query with its DuckDB oracle."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(None if pd.isna(v) else plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False))


def same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
