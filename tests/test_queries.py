"""The driver's contract, and the queries against their SQL."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sitescribe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The pages of the tables have neither addresses nor structured data; made ones are in other queries.
WITHOUT_ROWS = {"page_emails", "page_structured_data", "page_organisations"}


@pytest.fixture(scope="module")
def sql():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return found


def plain(frame):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(cell(x) for x in row) for row in frame.itertuples(index=False)), key=str)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_hourly_counts", "stream_event_state"}))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert (got.count() > 0) == (name not in WITHOUT_ROWS)
        return
    want = sql.execute(ORACLES[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    if any(str(t).startswith("datetime") for t in want.dtypes):
        for c in want.columns:
            if str(want[c].dtype).startswith("datetime"):
                got[c], want[c] = got[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["stream_hourly_counts", "stream_event_state"])
def test_streams_equal_batch(spark, sql, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(sql.execute(ORACLES[name]).df())
