"""Queries of the library against their SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quire.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(v) for v in value])
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return ""
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.number)):
        return repr(round(float(value), 6))
    return pd.Timestamp(value).isoformat() if hasattr(value, "isoformat") else str(value)


def bag(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert bag(QUERIES[name](spark, DATA).toPandas()) == bag(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "doc_id", "sentence_idx", "start", "end", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
