"""Sponsorship against its DuckDB text without any tolerance: a last digit of 5, -0.0, moves below a rounding, missing values."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.1"


def both(spark, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    got = entry.queries()["c21_sponsorship"](spark, sf)
    cur = con.execute(entry.oracle_sql()["c21_sponsorship"])
    columns = [c[0] for c in cur.description]
    return {r["symbol"]: repr(tuple(r[c] for c in columns)) for r in got.collect()}, {r[columns.index("symbol")]: repr(r) for r in cur.fetchall()}


def test_equal_to_the_last_digit(spark):
    got, want = both(spark, SF)
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)


@pytest.mark.parametrize(
    ("older", "newer"),
    [(250010.0, 250020.0), (250020.0, 250010.0), (None, 1e5), (1e5, None), (None, None), (float("nan"), 1e5), (1e5, float("nan"))],
)
def test_small_moves_and_missing_shares(spark, tmp_path, older, newer):
    con = duckdb.connect()
    con.execute("CREATE TABLE o (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP)")
    rows = [(1, 7, older, "2026-01-01"), (2, 7, newer, "2026-01-02"), (3, 8, 1e5, "2026-01-01"), (4, 8, 3e5, None), (5, None, 2e5, None)]
    con.executemany("INSERT INTO o VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY o TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got, want = both(spark, str(tmp_path))
    assert got == want
