"""Queries of patterns, indicators, the screening language, ranks and scores."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, round_half
from ..functions.recursive import span
from ..operators import breadth, indicators, patterns, screen, series
from ..sources import bars as B
from ..sources.store import session_store
from .registry import query, rounded
from .sql import average, bars, guard, over
from .windows import _AGG, _DER, _NB, _r

_LAG = over()


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {_LAG}"


_FLAG = f"""fp AS (SELECT *, {_lag('close', 4)} AS pb, {_lag('close', 14)} AS pa, {guard('max(close)', 'close', 5, 5)} AS mx, {guard('min(close)', 'close', 5, 5)} AS mn,
    CASE WHEN count(volume) OVER w11 >= 11 THEN avg(volume) OVER w11 END AS pv, {guard('avg(volume)', 'volume', 5, 5)} AS fv FROM bars WINDOW w11 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 14 PRECEDING AND 4 PRECEDING)),
  fl AS (SELECT *, CASE WHEN pa IS NULL OR pb IS NULL OR mx IS NULL THEN NULL
    WHEN abs(pb - pa) > 0 AND (mx - mn) <= 0.5 * abs(pb - pa) AND pv > 0 AND fv < pv AND (pb - pa) / pa <= -0.06 AND (close - pb) / abs(pb - pa) BETWEEN 0 AND 0.45 THEN 'bear'
    WHEN abs(pb - pa) > 0 AND (mx - mn) <= 0.5 * abs(pb - pa) AND pv > 0 AND fv < pv AND (pb - pa) / pa >= 0.06 AND (pb - close) / abs(pb - pa) BETWEEN 0 AND 0.45 THEN 'bull' ELSE 'none' END AS flag FROM fp)"""


@query("c7_flags", f"{_NB}, {_FLAG} SELECT symbol, date, flag FROM fl")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.flags(B.nation_bars(spark, sf)).select("symbol", "date", "flag")


@query("c8_flag_events")
def flag_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.flag_events(B.nation_bars(spark, sf)))


@query("c9_flag_summary")
def flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.flag_summary(patterns.flag_events(B.nation_bars(spark, sf)))


@query("c10_win_rates")
def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    labels = breadth.regime_labels(breadth.derived(breadth.aggregates(b)))
    return rounded(patterns.win_rates(patterns.flag_events(b), labels))


_EXH = f"""e0 AS (SELECT *, {guard('avg(volume)', 'volume', 20, 20)} AS av0, {guard('max(high)', 'high', 20, 20)} AS h0, {guard('min(low)', 'low', 20, 20)} AS l0, (close - low) / nullif(high - low, 0) AS pos FROM bars),
  e1 AS (SELECT *, {_lag('av0')} AS av, {_lag('h0')} AS hi, {_lag('l0')} AS lo FROM e0),
  ex AS (SELECT *, CASE WHEN av IS NULL OR pos IS NULL THEN NULL WHEN volume >= 2 * av AND low <= lo AND pos >= 0.6 THEN 'seller' WHEN volume >= 2 * av AND high >= hi AND pos <= 0.4 THEN 'buyer' ELSE 'none' END AS exhaustion FROM e1)"""


@query("c5_exhaustion", f"{_NB}, {_EXH} SELECT symbol, date, exhaustion FROM ex")
def exhaustion(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.exhaustion(B.nation_bars(spark, sf)).select("symbol", "date", "exhaustion")


def _accumulation_sql(distance: int) -> str:
    return f"""g0 AS (SELECT *, close > {_lag('close')} AS up, close < {_lag('close')} AS dn, (close - low) / nullif(high - low, 0) AS pos FROM bars),
  g1 AS (SELECT *, sum(coalesce(2 * pos - 1, 0) * volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS line, {guard('avg(volume)', 'volume', 20, 20)} AS av0 FROM g0),
  g2 AS (SELECT *, {_lag('av0')} AS av, sign(line - {_lag('line', distance)}) AS dir, sign(close - {_lag('close', distance)}) AS pdir FROM g1),
  g3 AS (SELECT *, count(*) OVER {over(50)} AS n, sum(CASE WHEN up THEN volume ELSE 0 END) OVER {over(50)} AS uv, sum(CASE WHEN dn THEN volume ELSE 0 END) OVER {over(50)} AS dv,
    sum(CASE WHEN volume >= 1.25 * av AND up AND pos >= 0.5 THEN 1 ELSE 0 END) OVER {over(50)} AS good, sum(CASE WHEN volume >= 1.25 * av AND dn AND pos <= 0.5 THEN 1 ELSE 0 END) OVER {over(50)} AS bad FROM g2),
  g4 AS (SELECT *, CASE WHEN n >= 50 THEN CASE WHEN dv > 0 THEN least(uv / dv, 10.0) WHEN uv > 0 THEN 10.0 ELSE 1.0 END END AS ud, coalesce((good - bad) / nullif(good + bad, 0), 0) AS bal,
    CASE WHEN pdir > 0 AND dir < 0 THEN 'distribution' WHEN pdir < 0 AND dir > 0 THEN 'accumulation' ELSE 'confirming' END AS dv_ FROM g3),
  g5 AS (SELECT *, least(greatest((CASE WHEN ud >= 1.5 THEN 0.5 WHEN ud >= 1.1 THEN 0.25 WHEN ud <= 0.6 THEN -0.5 WHEN ud <= 0.9 THEN -0.25 ELSE 0 END)::DOUBLE + 0.2::DOUBLE * dir + 0.3::DOUBLE * bal
    + (CASE dv_ WHEN 'distribution' THEN -0.3 WHEN 'accumulation' THEN 0.3 ELSE 0 END)::DOUBLE, -1), 1) AS st0, dir IS NULL AS nodir FROM g4),
  ac AS (SELECT *, CASE WHEN nodir THEN NULL ELSE st0 END AS st FROM g5)"""


_LETTER = "CASE WHEN st >= 0.5 THEN 'A' WHEN st >= 0.2 THEN 'B' WHEN st <= -0.5 THEN 'E' WHEN st <= -0.2 THEN 'D' ELSE 'C' END"


@query("c1_accumulation", f"{_NB}, {_accumulation_sql(50)} SELECT symbol, date, {_r('ud')} AS ud_ratio, divergence, ad_rating FROM (SELECT symbol, date, ud, dv_ AS divergence, CASE WHEN ud IS NOT NULL AND av IS NOT NULL THEN {_LETTER} END AS ad_rating FROM ac)")
def accumulation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.accumulation(B.nation_bars(spark, sf)).select("symbol", "date", "ud_ratio", "divergence", "ad_rating"))


@query(
    "c3_accumulation_now",
    f"""{_NB}, {_accumulation_sql(49)}, z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM ac)
    SELECT symbol, date, {_LETTER} AS rating, dv_ AS divergence, CAST(good AS BIGINT) AS accum_days, CAST(bad AS BIGINT) AS distrib_days, {_r('st')} AS ad_strength FROM z WHERE k = 1 AND m >= 70""",
)
def accumulation_now(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.accumulation_now(B.nation_bars(spark, sf)).select("symbol", "date", "rating", "divergence", "accum_days", "distrib_days", "ad_strength"))


_POCKET = f"""q0 AS (SELECT *, row_number() OVER {_LAG} AS i, CASE WHEN count(high) OVER lw >= 5 AND count(high) OVER rw >= 5 AND high > max(high) OVER lw AND high > max(high) OVER rw THEN high END AS sh,
    CASE WHEN count(low) OVER lw >= 5 AND count(low) OVER rw >= 5 AND low < min(low) OVER lw AND low < min(low) OVER rw THEN low END AS sl FROM bars
    WINDOW lw AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), rw AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
  q1 AS (SELECT *, {_lag('sh', 5)} AS shl, {_lag('sl', 5)} AS sll, CASE WHEN {_lag('sh', 5)} IS NOT NULL THEN i - 5 END AS hi_i, CASE WHEN {_lag('sl', 5)} IS NOT NULL THEN i - 5 END AS lo_i FROM q0),
  q2 AS (SELECT *, last_value(shl IGNORE NULLS) OVER u AS hp, last_value(sll IGNORE NULLS) OVER u AS lp, last_value(hi_i IGNORE NULLS) OVER u AS hx, last_value(lo_i IGNORE NULLS) OVER u AS lx FROM q1
    WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
  gp AS (SELECT *, CASE WHEN hp > lp THEN CASE WHEN hx > lx THEN 'bullish' ELSE 'bearish' END END AS gp_direction,
    CASE WHEN hp > lp THEN CASE WHEN hx > lx THEN (hp - close) / (hp - lp) ELSE (close - lp) / (hp - lp) END END AS gp_retrace FROM q2)"""


@query("c23_golden_pocket", f"{_NB}, {_POCKET} SELECT symbol, date, gp_direction, {_r('gp_retrace')} AS gp_retrace, CASE WHEN gp_retrace IS NOT NULL THEN CASE WHEN gp_retrace BETWEEN 0.618 AND 0.786 THEN 1.0::DOUBLE ELSE 0.0 END END AS gp_in_pocket FROM gp")
def golden_pocket(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.golden_pocket(B.nation_bars(spark, sf)).select("symbol", "date", "gp_direction", "gp_retrace", "gp_in_pocket"))


_PROFILE = """pr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars),
  p60 AS (SELECT *, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM pr WHERE k <= 60),
  pc AS (SELECT symbol, date, volume, lo, (hi - lo) / 50 AS step, high, low, unnest(range(50)) AS bin FROM p60 WHERE hi > lo),
  pw AS (SELECT *, CASE WHEN high > low THEN greatest(least(high, lo + bin * step + step) - greatest(low, lo + bin * step), 0)
    WHEN least(49, floor((low - lo) / step)) = bin THEN 1.0 ELSE 0.0 END AS w FROM pc),
  ps AS (SELECT *, volume * w / nullif(sum(w) OVER (PARTITION BY symbol, date), 0) AS v FROM pw)"""


@query("c14_volume_profile", f"{_NB}, {_PROFILE} SELECT symbol, CAST(bin AS INTEGER) AS bin, {_r('max(lo + bin * step + step / 2)', 4)} AS centre, {_r('sum(coalesce(v, 0))', 4)} AS volume FROM ps GROUP BY symbol, bin")
def volume_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.profile(B.nation_bars(spark, sf)), 4)


@query("c15_value_area")
def value_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.value_area(patterns.profile(B.nation_bars(spark, sf))).select("symbol", "poc", "val", "vah", "poc_position"), by=round_half)


def _build_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return screen.snapshot(indicators.indicators(B.nation_bars(spark, sf), B.market_bars(spark, sf)))


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The stored snapshot; it is made by the first query of an application that needs it."""
    return session_store(spark).once(f"snapshot-{hashlib.md5(sf.encode()).hexdigest()[:12]}", lambda: _build_snapshot(spark, sf))


_SNAP_FIELDS = ("sma20", "sma200", "ema10", "ema20", "chg_pct", "gap_pct", "rvol_10d", "high_20d", "low_252")
_SNAP = f"""ind AS (SELECT *, {guard('avg(close)', 'close', 20, 20)} AS sma20, {guard('avg(close)', 'close', 200, 200)} AS sma200, {average('close', span(10), 10)} AS ema10, {average('close', span(20), 20)} AS ema20,
    100 * (close / {_lag('close')} - 1) AS chg_pct, 100 * (open / {_lag('close')} - 1) AS gap_pct, {guard('avg(volume)', 'volume', 10, 10)} AS av, {guard('max(high)', 'high', 20, 20)} AS h20, {guard('min(low)', 'low', 252, 60)} AS l252 FROM bars),
  ind2 AS (SELECT *, volume / {_lag('av')} AS rvol_10d, {_lag('h20')} AS high_20d, {_lag('l252')} AS low_252 FROM ind),
  snap AS (SELECT s.symbol, s.last_bar, i.* EXCLUDE (symbol) FROM (SELECT symbol, max(date) AS last_bar FROM bars GROUP BY symbol) s LEFT JOIN ind2 i ON i.symbol = s.symbol AND i.date = (SELECT max(date) FROM bars))"""


@query("c25_snapshot", f"{_NB}, {_SNAP} SELECT symbol, last_bar, {_r('close')} AS close, {', '.join(_r(c) + f' AS {c}' for c in _SNAP_FIELDS)} FROM snap")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot job: built from the bars and stored, then read."""
    store, name = session_store(spark), f"snapshot-{hashlib.md5(sf.encode()).hexdigest()[:12]}"
    store.replace(name, _build_snapshot(spark, sf))
    return rounded(store.read(name).select("symbol", "last_bar", "close", *_SNAP_FIELDS))


_CONDITIONS = [{"field": "rvol_10d", "op": ">", "value": 0.2}, {"field": "chg_pct", "op": "between", "value": [-60, 60]}, {"field": "price_vs_sma20_pct", "op": "<=", "value": 40}]


@query(
    "f1_scan",
    f"""{_NB}, {_SNAP} SELECT symbol, {_r('close')} AS close, {_r('chg_pct')} AS chg_pct, {_r('100 * (close / sma20 - 1)')} AS price_vs_sma20_pct FROM snap
    WHERE rvol_10d > 0.2 AND chg_pct BETWEEN -60 AND 60 AND 100 * (close / sma20 - 1) <= 40 ORDER BY chg_pct DESC NULLS LAST, symbol LIMIT 10""",
)
def scan(spark: SparkSession, sf: str) -> DataFrame:
    df = screen.derive(_snapshot(spark, sf), "2001-11-05")
    return rounded(screen.scan(df, _CONDITIONS, "chg_pct", True, 10).select("symbol", "close", "chg_pct", "price_vs_sma20_pct"))


_RULES = f"""k1 AS (SELECT *, close - {_lag('close')} AS st, {guard('max(high)', 'high', 252, 60)} AS h252, {guard('min(low)', 'low', 20, 20)} AS l20 FROM bars),
  k2 AS (SELECT *, CASE WHEN st IS NOT NULL THEN greatest(st, 0) END AS up, CASE WHEN st IS NOT NULL THEN greatest(-st, 0) END AS dn, {_lag('h252')} AS high_252, {_lag('l20')} AS low_20d FROM k1),
  k3 AS (SELECT *, {average('up', 1 / 14, 14)} AS au, {average('dn', 1 / 14, 14)} AS ad FROM k2),
  kr AS (SELECT symbol, high_252, low_20d, CASE WHEN ad = 0 AND au > 0 THEN 100.0 WHEN ad <> 0 THEN 100 - 100 / (1 + au / ad) END AS rsi14 FROM k3 WHERE date = (SELECT max(date) FROM bars)),
  sr AS (SELECT snap.*, kr.high_252, kr.low_20d, kr.rsi14, CASE WHEN ascii(snap.symbol) % 3 = 0 THEN 5 WHEN ascii(snap.symbol) % 3 = 1 THEN 9 END AS dte FROM snap LEFT JOIN kr ON kr.symbol = snap.symbol)"""


@query(
    "k13_alerts",
    f"""{_NB}, {_SNAP}, {_RULES}, hits AS (SELECT symbol, unnest([CASE WHEN rvol_10d >= 3 AND chg_pct >= 3 THEN 'vol_thrust_up' END, CASE WHEN rvol_10d >= 3 AND chg_pct <= -3 THEN 'vol_thrust_down' END,
      CASE WHEN rvol_10d >= 2 AND abs(chg_pct) < 3 AND chg_pct >= 0 THEN 'vol_building_up' END, CASE WHEN rvol_10d >= 2 AND abs(chg_pct) < 3 AND chg_pct < 0 THEN 'vol_building_down' END,
      CASE WHEN rsi14 >= 80 THEN 'rsi_overbought' END, CASE WHEN rsi14 <= 20 THEN 'rsi_oversold' END,
      CASE WHEN 100 * (close / sma20 - 1) >= 15 THEN 'ma_stretch_up' END, CASE WHEN 100 * (close / sma20 - 1) <= -15 THEN 'ma_stretch_down' END,
      CASE WHEN close > high_252 THEN 'break_52w_high' WHEN close > high_20d THEN 'break_20d_high' END, CASE WHEN close < low_252 THEN 'break_52w_low' WHEN close < low_20d THEN 'break_20d_low' END,
      CASE WHEN gap_pct >= 4 THEN 'gap_up' END, CASE WHEN gap_pct <= -4 THEN 'gap_down' END, CASE WHEN dte BETWEEN 0 AND 7 THEN 'earnings_soon' END]) AS rule_key FROM sr)
    SELECT symbol, rule_key, CASE WHEN rule_key = 'earnings_soon' THEN 'info' WHEN rule_key IN ('vol_thrust_up', 'vol_building_up', 'rsi_oversold', 'ma_stretch_down', 'break_52w_high', 'break_20d_high', 'gap_up') THEN 'pump' ELSE 'dump' END AS kind FROM hits WHERE rule_key IS NOT NULL""",
)
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """All fifteen rules on the snapshot, with made-up earnings dates."""
    k = F.ascii("symbol") % 3
    df = _snapshot(spark, sf).withColumn("earnings_date", F.when(k == 0, "2001-11-10").when(k == 1, "2001-11-14"))
    return screen.alerts(screen.derive(df, "2001-11-05"))


@query(
    "k14_armed",
    f"""{_NB}, {_SNAP}, now AS (SELECT 1 AS screen_id, symbol, 'screen:up' AS rule_key FROM snap WHERE chg_pct > 0 UNION ALL SELECT 2, symbol, 'screen:busy' FROM snap WHERE rvol_10d > 0.3)
    SELECT CAST(screen_id AS BIGINT) AS screen_id, symbol, rule_key FROM now WHERE NOT (screen_id = 1 AND symbol < 'NATION_15')""",
)
def armed(spark: SparkSession, sf: str) -> DataFrame:
    df = _snapshot(spark, sf)
    screens = [{"id": 1, "name": "up", "conditions": [{"field": "chg_pct", "op": ">", "value": 0}]}, {"id": 2, "name": "busy", "conditions": [{"field": "rvol_10d", "op": ">", "value": 0.3}]}]
    before = df.filter("symbol < 'NATION_15'").select(F.lit(1).cast("long").alias("screen_id"), "symbol")
    return screen.armed(df, screens, before)[0]


@query(
    "j4_leaders",
    f"""{_NB}, {_SNAP}, s AS (SELECT DISTINCT symbol, sector FROM bars), r AS (SELECT snap.symbol, s.sector, chg_pct, row_number() OVER (PARTITION BY s.sector ORDER BY chg_pct DESC, snap.symbol) AS place FROM snap JOIN s ON s.symbol = snap.symbol WHERE chg_pct IS NOT NULL)
    SELECT symbol, sector, {_r('chg_pct')} AS chg_pct, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""",
)
def leaders(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    snap = _snapshot(spark, sf).drop("sector").join(b.select("symbol", "sector").distinct(), "symbol")
    return rounded(screen.leaders(snap, 2, "chg_pct", "sector").select("symbol", "sector", "chg_pct", "place"))
