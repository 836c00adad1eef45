"""The SQL of the corpus queries gives the operators' rows."""

import os

import duckdb
import pytest

from graphloom.llm import oracle, queries

from ..test_entry import norm


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = queries.queries()[name](spark, sf)
    want = db.execute(oracle.oracle_sql()[name])
    assert norm(df.columns, df.collect()) == norm([c[0] for c in want.description], want.fetchall())
