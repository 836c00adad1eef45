"""Every graph query runs, and where it has SQL the rows are equal."""

import math
import os

import duckdb
import pytest

from graphloom.plans import queries as graph


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(x, 7) if isinstance(x, float) else x

    return sorted(columns), sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(graph.QUERIES))
def test_query(spark, sf, db, name):
    df = graph.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in graph.SQL:
        want = db.execute(graph.SQL[name])
        names = [c[0] for c in want.description]
        assert norm(df.columns, rows) == norm(names, want.fetchall())
    else:
        assert rows


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "centrality"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(graph.QUERIES) <= set(entry.queries())


def test_streaming_histogram(spark, sf):
    from graphloom.streaming.histogram import windowed_histogram

    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/event*.parquet")
    q = windowed_histogram(stream).writeStream.format("memory").queryName("hist").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("hist").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, windowed_histogram(batch).collect()))
