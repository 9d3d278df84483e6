"""Hand examples of the core operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barline.functions.columns import clean
from barline.functions.recursive import average, averages, span
from barline.operators import backtest, breadth, patterns, rankings, scores, screen, series
from barline.sources import bars as B
from barline.streaming import polls

DAY = dt.date(2024, 1, 1)


def frame(spark, closes, volume=None, symbol="A", width=0.2, opens=None):
    rows = []
    for i, c in enumerate(closes):
        v = None if c is None else float(volume[i] if volume is not None else 100.0)
        o = None if c is None else float(opens[i] if opens is not None else c)
        rows.append((symbol, DAY + dt.timedelta(days=i), o, None if c is None else c + width, None if c is None else c - width, None if c is None else float(c), v))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").select(name).collect()]


def test_average_equals_the_recursion_with_gaps():
    x = np.array([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, 4.0, np.nan, 3.0])
    want, value, old, seen = [], np.nan, 1.0, 0
    for v in x:
        old *= 0.7 if seen else 1.0
        if v == v:
            value, old, seen = (v if not seen else (old * value + 0.3 * v) / (old + 0.3)), 1.0, seen + 1
        want.append(value if seen >= 2 else np.nan)
    np.testing.assert_allclose(average(x, 0.3, 2), want, rtol=1e-12)


def test_average_on_frame_keeps_null(spark):
    got = column(averages(frame(spark, [1.0, None, 3.0]), [("e", "close", span(3), 2)]), "e")
    want = pd.Series([1.0, np.nan, 3.0]).ewm(span=3, adjust=False, min_periods=2).mean().tolist()
    assert got[:2] == [None, None] and got[2] == pytest.approx(want[2])


def test_clean_drops_nan_and_infinities(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert sorted([r["x"] for r in df.select(clean("x").alias("x")).collect()], key=str) == [1.0, None, None]


def test_rsi_extremes(spark):
    up = series.rsi(frame(spark, [float(i) for i in range(1, 20)]))
    flat = series.rsi(frame(spark, [10.0] * 20))
    assert column(up, "rsi14")[-1] == 100.0 and column(up, "rsi14")[13] is None
    assert column(flat, "rsi14")[-1] is None


def test_levels_exclude_today(spark):
    b = series.levels(frame(spark, [10.0] * 69 + [12.0]))
    last = b.orderBy(F.col("date").desc()).first()
    assert last["high_20d"] == pytest.approx(10.2) and last["high_252"] == pytest.approx(10.2)
    assert last["pct_from_52w_high"] == pytest.approx((12 / 12.2 - 1) * 100)


def test_breadth_counts(spark):
    data = {"A": ([10, 11, 12, 11.5], [100, 110, 120, 130]), "B": ([20, 19, 19.5, 19], [200, 210, 220, 230]), "C": ([5, 6, 6, 5.5], [50, 55, 60, 65])}
    df = None
    for s, (c, v) in data.items():
        part = frame(spark, [float(x) for x in c], v, s)
        df = part if df is None else df.unionByName(part)
    days = breadth.aggregates(df).orderBy("date").collect()
    assert [r["advances"] for r in days] == [2, 2, 0] and [r["declines"] for r in days] == [1, 0, 3] and [r["unchanged"] for r in days] == [0, 1, 0]
    assert days[0]["up_vol"] == 165 and days[0]["down_vol"] == 210 and days[2]["down_vol"] == 425


def _days(spark, pairs):
    rows = [(DAY + dt.timedelta(days=i), a, d, 100.0, 50.0, 1, 1) for i, (a, d) in enumerate(pairs)]
    return spark.createDataFrame(rows, "date date, advances long, declines long, up_vol double, down_vol double, new_highs long, new_lows long")


def test_summation_closed_form(spark):
    flat = breadth.derived(_days(spark, [(150, 50)] * 10)).orderBy("date").collect()
    assert flat[-1]["mcclellan"] == pytest.approx(0, abs=1e-9) and flat[-1]["summation"] == pytest.approx(5000)
    step = breadth.derived(_days(spark, [(150, 50), (50, 150)])).orderBy("date").collect()
    assert [r["mcclellan"] for r in step] == pytest.approx([0, -50]) and [r["summation"] for r in step] == pytest.approx([5000, 4950])


def test_thrust(spark):
    rows = [(DAY + dt.timedelta(days=i), x) for i, x in enumerate([0.45, 0.38, 0.45, 0.55, 0.60, 0.63, 0.64, 0.62])]
    got = breadth.thrusts(spark.createDataFrame(rows, "date date, zbt_ema double")).collect()
    assert [r["date"] for r in got] == [DAY + dt.timedelta(days=5)]


def test_bull_flag(spark):
    closes = [100 + 1.2 * i for i in range(11)] + [111, 110.5, 111, 110.8, 111] + [111 + 14 * (i + 1) / 20 for i in range(20)]
    e = patterns.flag_events(frame(spark, closes, [2000] * 11 + [1000] * 25))
    w = patterns.win_rates(e).first()
    assert w["bull_n"] >= 1 and w["bull"] == 1.0 and w["bear_n"] == 0


def test_climax(spark):
    base = [(100.0, 101.0, 99.0, 100.0, 1000.0)] * 29
    for last, want in (((99.0, 100.0, 90.0, 99.0, 5000.0), "seller"), ((101.0, 112.0, 100.0, 101.0, 5000.0), "buyer")):
        rows = [("A", DAY + dt.timedelta(days=i), *r) for i, r in enumerate([*base, last])]
        df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
        assert column(patterns.exhaustion(df), "exhaustion")[-1] == want


def test_pocket_has_no_lookahead(spark):
    rng = np.random.default_rng(5)
    closes = [float(x) for x in 100 + np.cumsum(rng.normal(0, 1, 80))]
    whole = column(patterns.golden_pocket(frame(spark, closes)), "gp_retrace")
    cut = column(patterns.golden_pocket(frame(spark, closes[:60])), "gp_retrace")
    assert whole[:60] == cut


def test_value_area_prefers_upwards(spark):
    cells = spark.createDataFrame([("A", i, float(i), v) for i, v in enumerate([1.0, 2.0, 6.0, 2.0, 1.0])], "symbol string, bin int, centre double, volume double")
    r = patterns.value_area(cells).first()
    assert (r["poc"], r["val"], r["vah"]) == (2.0, 1.0, 3.0) or (r["poc"], r["vah"]) == (2.0, 3.0)


def test_conditions(spark):
    df = spark.createDataFrame([("UP", 5.0, "bull"), ("DOWN", -3.0, "none"), ("GAP", None, None)], "symbol string, chg_pct double, flag string")
    names = lambda c: sorted(r["symbol"] for r in screen.matching(df, c).collect())
    assert names([]) == ["DOWN", "GAP", "UP"]
    assert names([{"field": "chg_pct", "op": "!=", "value": 5}]) == ["DOWN"]
    assert names([{"field": "flag", "op": "in", "value": ["bull", "bear"]}]) == ["UP"]
    assert names([{"field": "absent", "op": ">", "value": 0}]) == [] and names([{"field": "chg_pct", "op": "~", "value": 0}]) == []
    assert screen.validate([{"field": "chg_pct", "op": "in", "value": [1]}]) and not screen.validate([{"field": "flag", "op": "==", "value": "bull"}])


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 2.0), ("c", DAY, 2.0), ("d", DAY, None)], "symbol string, date date, x double")
    got = {r["symbol"]: r["p"] for r in df.select("symbol", rankings.percent_rank("x").alias("p")).collect()}
    want = (pd.Series([1.0, 2.0, 2.0]).rank(pct=True) * 100).tolist()
    assert got["a"] == pytest.approx(want[0]) and got["b"] == pytest.approx(want[1]) and got["d"] is None
    pooled = {r["symbol"]: r["rank"] for r in rankings.pooled_rank(df, "x").collect()}
    assert pooled == {"a": 33, "b": 99, "c": 99, "d": None}


def test_contract_score(spark):
    row = [("CALL", 105.0, 100.0, 45, 20000, 500, 2.0, 2.1, 2.05, 2.05, 3, 1e6, 0.0), ("CALL", 105.0, 100.0, 45, 100, 500, 2.0, 2.1, 2.05, 2.05, 1, None, 0.0), ("PUT", 100.0, 100.0, 0, 20000, 500, 2.0, 2.1, 2.05, 2.05, 1, None, 0.6)]
    df = spark.createDataFrame(row, "put_call string, strike double, spot double, dte int, session_volume long, open_interest long, bid double, ask double, last double, mark double, cluster_count int, baseline_notional double, conf_align double")
    a, b, c = scores.classify_contracts(df).collect()
    assert a["conviction"] == pytest.approx(34 + 26 * min(1, 4.1 / 6) + 6.5 + 14 * 2 / 3 + 10, abs=0.06) and a["classification"] == "conviction"
    assert b["drop_reason"] == "size below floor" and b["conviction"] == 0 and c["drop_reason"] is None


def test_votes_and_stance(spark):
    v = spark.createDataFrame([("breadth", 1, 80.0, 30.0, True), ("rrg", -1, 50.0, 20.0, True), ("news", 1, 90.0, 12.0, False)], "domain string, direction int, conviction double, weight double, ok boolean")
    assert scores.combined(v, "NEUTRAL").first()["score"] == pytest.approx(14.0)
    assert scores.combined(v, "CONCENTRATE").first()["posture"] == "Lean bullish"


def test_hold_trade(spark):
    closes = [100.0] * 40 + [110.0, 112.0, 113.0, 114.0] + [100.0] * 16
    opens = [100.0, *closes[:-1]]
    g = B.grid(frame(spark, closes, width=1.0, opens=opens).unionByName(frame(spark, [50.0] * 60, symbol="B")))
    g = g.withColumn("chg_pct", 100 * (F.col("close") / F.lag("close").over(series.over_time(order="bar_no")) - 1))
    r = backtest.replay(series.atr(g), [{"field": "chg_pct", "op": ">", "value": 5}])
    t = backtest.exits(backtest.entries(r), r, "hold", hold=3).collect()
    assert [(x["entry_px"], x["exit_px"], x["exit_reason"]) for x in t] == [(110.0, 114.0, "hold")]
    s = backtest.exits(backtest.entries(r), r, "signal").collect()
    assert [(x["exit_px"], x["bars_held"]) for x in s] == [(112.0, 1)]


def test_polls_batch_equals_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 2, 10)
    rows = [("o", DAY, t, 20000, 2.05), ("o", DAY, t + dt.timedelta(minutes=1), 20400, 2.05), ("o", DAY, t + dt.timedelta(minutes=2), 60000, 2.05), ("o", DAY + dt.timedelta(days=1), t + dt.timedelta(days=1), 60000, 2.05)]
    df = spark.createDataFrame(rows, "option_symbol string, day date, ts timestamp, session_volume long, mark double")
    want = sorted(tuple(r) for r in polls.deltas(df).collect())
    assert [r[-1] for r in want] == [1, 1, 2, 1] and want[0][-2] == 20000
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = polls.stream_deltas(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = s.writeStream.format("memory").queryName("polled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("polled").collect()) == want


def test_sources(spark):
    old = spark.createDataFrame([("u", "A", DAY, DAY, True), ("u", "B", DAY, DAY, True)], "universe string, symbol string, first_seen date, last_seen date, active boolean")
    now = spark.createDataFrame([("u", "B"), ("u", "C")], "universe string, symbol string")
    got = {r["symbol"]: (r["active"], str(r["first_seen"])) for r in B.membership(old, now, "2024-02-01").collect()}
    assert got == {"A": (False, "2024-01-01"), "B": (True, "2024-01-01"), "C": (True, "2024-02-01")}
    rows = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 20.0)], "symbol string, load int, x double")
    assert [r["x"] for r in B.keep_latest(rows, ["symbol"], "load").collect()] == [20.0]


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_readers(spark):
    from barline.sources import adapters as A

    text = "### Tech\nNYSE:BRK.B, aapl,\n'msft', AAPL, 12bad"
    files = spark.createDataFrame([("a", text), ("b", "Name,Symbol\nX,IBM\nY,SPY\n")], "file string, text string")
    got = {f: [r["symbol"] for r in A.watchlist(files).filter(F.col("file") == f).orderBy("position").collect()] for f in "ab"}
    assert got == {"a": ["BRK-B", "AAPL", "MSFT"], "b": ["IBM", "SPY"]}
    raw = '{"underlyingPrice": 100.0, "callExpDateMap": {"e": {"105": [{"symbol": "o", "putCall": "CALL", "strikePrice": 105.0, "expirationDate": "2024-03-15T20:00", "bid": 2.0, "delta": -999.0, "totalVolume": 7}]}}}'
    c = A.contracts(spark.createDataFrame([("U", "t", raw)], "underlying string, ts string, raw string")).first()
    assert (c["strike"], str(c["expiry"]), c["delta"], c["session_volume"], c["open_interest"], c["spot"]) == (105.0, "2024-03-15", None, 7, 0, 100.0)
    s = spark.createDataFrame([("Health Care",), ("XLE",), ("Other",)], "s string").select(A.sector_etf(F.col("s")).alias("e"))
    assert [r["e"] for r in s.collect()] == ["XLV", "XLE", None]
    o = A.observations(spark.createDataFrame([("a", "2024-01-01", "1.5"), ("a", "2024-01-02", ".")], "series_id string, date string, value string"))
    assert [r["value"] for r in o.collect()] == [1.5]


def test_feeds(spark):
    from barline.operators import books, feeds

    i = spark.createDataFrame([(1, 0, "neutral"), (1, 1, "neutral"), (1, 2, "negative"), (2, 0, "positive"), (2, 1, "negative"), (3, 0, "neutral")], "article_id int, pos int, label string")
    assert {r["article_id"]: r["sentiment"] for r in feeds.sentiment(i).collect()} == {1: "negative", 2: "positive", 3: "neutral"}
    before = spark.createDataFrame([(1, "A", DAY), (1, "B", DAY)], "screen_id long, symbol string, first_matched date")
    now = spark.createDataFrame([(1, "B"), (1, "C")], "screen_id long, symbol string")
    got = {r["symbol"]: str(r["first_matched"]) for r in feeds.screen_memory(before, now, "2024-02-01").collect()}
    assert got == {"B": "2024-01-01", "C": "2024-02-01"}
    days = [DAY + dt.timedelta(days=k) for k in range(2)]
    t = spark.createDataFrame([("b", d, s, w, None) for d in days for s, w in (("A", 0.5), ("S", -0.5))], "book string, date date, symbol string, weight double, stop double")
    c = spark.createDataFrame([("A", days[0], 100.0), ("A", days[1], 110.0), ("S", days[0], 400.0), ("S", days[1], 400.0)], "symbol string, date date, close double")
    one, two = books.run_books(t, c).orderBy("date").collect()
    assert one["equity"] == pytest.approx(100_000 - 50) and one["cost"] == pytest.approx(50)
    assert two["equity"] == pytest.approx(99_950 + 5_000 - two["cost"])
    state = books.book_state(books.run_books(t, c), c.filter("symbol = 'S'")).first()
    assert state["excess"] == pytest.approx(two["equity"] / 100_000 - 1)


def test_conviction_and_call(spark):
    from barline.operators import rotation

    base = {"symbol": "A", "date": DAY, "cur_rs": 100.0, "wv_trend": "up", "wv_leg": "corrective", "wave_label": "wave-2", "abc_type": "—", "div_rs": "bull", "div_px": "none", "gp_q": 1.0, "ext_q": 0.0, "flag": 0.0, "c_tgt_hi": None, "w4_zone": None, "rotation": "on"}
    cases = [base, base | {"symbol": "B", "rotation": "off"}, base | {"symbol": "C", "wv_leg": "impulse", "wave_label": "wave-5", "gp_q": 0.0, "ext_q": 1.0, "div_rs": "bear"}, base | {"symbol": "D", "wv_leg": "abc", "wave_label": "wave-A", "div_rs": "none"}]
    schema = "symbol string, date date, cur_rs double, wv_trend string, wv_leg string, wave_label string, abc_type string, div_rs string, div_px string, gp_q double, ext_q double, flag double, c_tgt_hi double, w4_zone double, rotation string"
    got = {r["symbol"]: (r["conviction"], r["call"]) for r in rotation.timeline(spark.createDataFrame([tuple(c.values()) for c in cases], schema)).collect()}
    assert got == {"A": (72.4, "ROTATE IN"), "B": (42.4, "ROTATE IN"), "C": (-70.0, "⚠️ w5 extended"), "D": (0.0, "ROTATE OUT")}
