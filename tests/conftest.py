"""One Spark session for all tests, and a comparison with DuckDB over small tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

SF_DIR = os.environ.get("LOOMDEX_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in os.listdir(SF_DIR):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows(df: DataFrame, *names: str) -> list[tuple]:
    """Rows in a fixed order, as plain tuples."""
    chosen = df.select(*names) if names else df
    return sorted((plain(tuple(r)) for r in chosen.collect()), key=repr)


def same_as_sql(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """Assert that a DataFrame has the rows of a query."""
    names = sorted(df.columns)
    assert names == sorted(con.sql(sql).columns)
    wanted = con.sql(f"select {', '.join(f'\"{n}\"' for n in names)} from ({sql})").fetchall()
    assert rows(df, *names) == sorted((plain(tuple(r)) for r in wanted), key=repr)
