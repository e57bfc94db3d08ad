"""Markets of one event that share a ticker keep their own candles."""

import datetime

import duckdb

from oddsloom.plans import registry, venue_queries  # noqa: F401


def test_kalshi_history_of_lines_with_one_ticker(spark, tmp_path):
    # Numbers 1000 apart: 100 * 10 + 1 * 1000 + 5 = 0 * 10 + 2 * 1000 + 5, and 200 * 10 + 1 * 1000 + 5 = 0 * 10 + 3 * 1000 + 5, which has no candles.
    lines = [(1, 100, 1, 10.0), (1, 0, 2, 20.0), (2, 200, 1, 10.0), (2, 0, 3, 20.0), (3, 100, 1, 20.0), (3, 0, 2, 10.0), (4, 0, 2, 10.0), (4, 100, 1, 20.0), (5, 0, 2, 20.0), (5, 100, 1, 10.0)]
    rows = [(o, p, 5, n, 3.0, price, datetime.datetime(1996, 1, n)) for o, p, n, price in lines]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["kalshi_history"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["kalshi_history"]).fetchall())
    assert got == want and len(want) == 10
