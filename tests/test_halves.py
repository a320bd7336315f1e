"""Halves are rounded as the queries' SQL rounds them."""

import datetime as dt

import duckdb

from sitescribe.plans.catalog import ORACLES, QUERIES


def both(spark, folder, name, table, rows, schema):
    """Rows of a query and of its SQL over one made table."""
    path = f"{folder}/{table}.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    got = QUERIES[name](spark, str(folder))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    want = sql.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_deltas_near_a_half(spark, tmp_path):
    """26.05 as a difference of doubles is 26.049999999999997, whose tenfold is a half."""
    at = dt.datetime(1995, 1, 1)
    prices = [(k / 100, (k + 13_025_000) / 100) for k in range(100_000, 140_000, 137)]
    rows = [(2 * i + n, i, "F", price, at + dt.timedelta(days=n), "1-URGENT") for i, pair in enumerate(prices) for n, price in enumerate(pair)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    got, want = both(spark, tmp_path, "run_history_report", "orders", rows, schema)
    assert len({r[3] for r in want}) > 1
    assert got == want


def test_half_tokens(spark, tmp_path):
    """Ten characters are two tokens and fourteen are four, so a hundred and fifty fit."""
    rows = [(conv, turn, "user", "x" * length) for conv, length in enumerate((10, 14, 12)) for turn in range(120)]
    got, want = both(spark, tmp_path, "token_budget", "conversations", rows, "conv_id long, turn long, role string, text string")
    assert [sum(r[0] == conv for r in want) for conv in range(3)] == [100, 50, 66]
    assert got == want
