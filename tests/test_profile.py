"""Volume profiles: sums rounded once, so that levels do not hang on the order of rows; ends of areas as SQL gives them."""

import datetime
from math import floor, fsum

import duckdb
import numpy as np

import __spark_entry__ as entry
from barline.operators import patterns

SF = "/root/testdata/sf0.1"
BAR = "symbol string, date date, open double, high double, low double, close double, volume double"
SEED = 7


def bars(spark):
    """60 bars of one symbol, most of them across the whole range: their bins hold equal volumes but for the last digits."""
    rng = np.random.default_rng(SEED)
    rows = []
    for i in range(60):
        low, high = float(rng.uniform(1000, 1400)) / 3, float(rng.uniform(9000, 99000)) / 7
        rows.append(("A", datetime.date(2026, 1, 1) + datetime.timedelta(days=i), low, high if i % 20 else low, low, low, float(rng.integers(100, 9000))))
    return rows, spark.createDataFrame(rows, BAR)


def volumes(rows, bins=50):
    """The same by hand, in the doubles of the SQL text, with each sum rounded once."""
    lo, hi = min(r[4] for r in rows), max(r[3] for r in rows)
    step, parts = (hi - lo) / bins, [[] for _ in range(bins)]
    for _, _, _, high, low, _, volume in rows:
        if high > low:
            w = [max(min(high, lo + k * step + step) - max(low, lo + k * step), 0.0) for k in range(bins)]
        else:
            w = [float(min(bins - 1, floor((low - lo) / step)) == k) for k in range(bins)]
        for k, x in enumerate(w):
            parts[k].append(volume * x / fsum(w))
    return [fsum(p) for p in parts]


def test_sums_are_rounded_once(spark):
    rows, df = bars(spark)
    want = volumes(rows)
    for part in (df, df.repartition(7)):
        assert [r["volume"] for r in patterns.profile(part).orderBy("bin").collect()] == want
    assert patterns.value_area(patterns.profile(df)).first()["poc_position"] == want.index(max(want)) / 49


def test_ends_of_areas_are_equal_to_the_last_digit(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT symbol, val, vah FROM ({entry.oracle_sql()['c15_value_area']}) ORDER BY symbol").fetchall()
    got = entry.queries()["c15_value_area"](spark, SF).orderBy("symbol").select("symbol", "val", "vah").collect()
    assert [tuple(r) for r in got] == want


def test_distances_round_as_sql_rounds(spark):
    """Places after the second that are a 5 in decimal text only: the binary value decides."""
    rows = [(f"S{i}", datetime.date(2026, 1, 1), 100 + i / 200) for i in range(-150, 400)]
    last = spark.createDataFrame(rows, "symbol string, date date, close double")
    areas = last.selectExpr("symbol", "100D AS poc", "99D AS val", "102D AS vah", "'D' AS shape", "array(101D) AS hvn", "array(98D) AS lvn")
    got = {r["symbol"]: repr(r["poc_dist_pct"]) for r in patterns.profile_now(last, areas).collect()}
    con = duckdb.connect()
    want = con.execute("SELECT 'S' || i, round_even(100 * (px - poc) / poc, 2) FROM (SELECT i, 100 + i / 200::DOUBLE AS px, 100::DOUBLE AS poc FROM range(-150, 400) r(i))").fetchall()
    assert got == {symbol: repr(x) for symbol, x in want}
