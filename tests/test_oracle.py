"""Every query against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from pixelseries.plans import geometry, outputs  # noqa: F401
from pixelseries.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    number = lambda v: isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_))
    text = lambda v: "null" if pd.isna(v) else f"{float(v):.6f}" if number(v) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, db, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() <= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
