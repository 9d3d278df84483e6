"""Ownership against its DuckDB text without any tolerance: shares whose seventh digit is a 5 round alike."""

import datetime

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def exact(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    day = lambda v: v.date() if isinstance(v, datetime.datetime) else v
    return sorted((tuple(day(r[k]) for k in order) for r in found), key=str)


def test_shares_are_equal_to_the_last_digit(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    got = entry.queries()["s17_ownership"](spark, SF)
    cur = con.execute(entry.oracle_sql()["s17_ownership"])
    assert exact(got.columns, got.collect()) == exact([c[0] for c in cur.description], cur.fetchall())
