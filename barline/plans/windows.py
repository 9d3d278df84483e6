"""Queries of the time-axis and cross-sectional operators over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.recursive import averages, span
from ..operators import breadth, series
from ..sources import bars as B
from .registry import query, rounded
from .sql import average, bars, guard, over


def _r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


_NB = f"WITH {bars('nation')}"
_BB = f"WITH {bars('brand')}"


@query("s3_coverage", f"WITH {bars('brand', 'day')} SELECT symbol, CAST(count(*) AS BIGINT) AS n_bars, max(date) AS last_date FROM bars GROUP BY symbol")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return B.coverage(B.brand_bars(spark, sf, "day"))


@query("s1_series", f"WITH {bars('brand', 'day')} SELECT date, {_r('close')} AS close, volume FROM bars WHERE symbol = 'Brand#11' AND date >= DATE '1998-01-01'")
def one_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.series(B.brand_bars(spark, sf, "day"), "Brand#11", "1998-01-01"))


@query("s2_panel", f"WITH {bars('nation')} SELECT symbol, sector, date, {_r('close')} AS close FROM bars WHERE sector = 'ASIA' AND date >= DATE '1999-01-01'")
def panel(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    return rounded(B.panel(b, b.filter("sector = 'ASIA'"), "1999-01-01").select("symbol", "sector", "date", "close"))


@query("w1_sma", f"{_BB} SELECT symbol, date, {_r(guard('avg(close)', 'close', 20, 20))} AS sma20, {_r(guard('avg(close)', 'close', 200, 200))} AS sma200 FROM bars")
def sma(spark: SparkSession, sf: str) -> DataFrame:
    b = B.brand_bars(spark, sf)
    return rounded(b.select("symbol", "date", series.simple_average("close", 20).alias("sma20"), series.simple_average("close", 200).alias("sma200")))


@query("w2_ema", f"{_BB} SELECT symbol, date, {_r(average('close', span(10), 10))} AS ema10, {_r(average('close', span(20)))} AS ema20 FROM bars")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    b = B.brand_bars(spark, sf).select("symbol", "date", "close")
    return rounded(averages(b, [("ema10", "close", span(10), 10), ("ema20", "close", span(20), 0)]).drop("close"))


@query(
    "w4_rsi",
    f"""{_BB}, d AS (SELECT *, close - lag(close) OVER {over()} AS s FROM bars),
    u AS (SELECT *, CASE WHEN s IS NOT NULL THEN greatest(s, 0) END AS up, CASE WHEN s IS NOT NULL THEN greatest(-s, 0) END AS dn FROM d),
    a AS (SELECT symbol, date, {average('up', 1 / 14, 14)} AS au, {average('dn', 1 / 14, 14)} AS ad FROM u)
    SELECT symbol, date, {_r('CASE WHEN ad = 0 AND au > 0 THEN 100.0 WHEN ad <> 0 THEN 100 - 100 / (1 + au / ad) END')} AS rsi14 FROM a""",
)
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.rsi(B.brand_bars(spark, sf)).select("symbol", "date", "rsi14"))


@query(
    "w5_atr",
    f"""{_BB}, p AS (SELECT *, lag(close) OVER {over()} AS pc FROM bars),
    t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS st FROM p)
    SELECT symbol, date, {_r(average('tr', 1 / 14, 14))} AS atr14, {_r(average('st', 1 / 14, 14))} AS atr14_strict, {_r(guard('avg(st)', 'st', 14, 14))} AS atr14_simple FROM t""",
)
def atr(spark: SparkSession, sf: str) -> DataFrame:
    b = series.atr(series.atr(B.brand_bars(spark, sf), 14), 14, "atr14_strict", strict=True).withColumn("tr", series.strict_true_range())
    return rounded(b.select("symbol", "date", "atr14", "atr14_strict", series.simple_atr().alias("atr14_simple")))


@query(
    "w6_changes",
    f"""{_BB} SELECT symbol, date, {_r(f'100 * (close / lag(close) OVER {over()} - 1)')} AS chg_pct, {_r(f'100 * (volume / nullif(lag(volume) OVER {over()}, 0) - 1)')} AS vol_chg_pct,
    {_r(f'100 * (open / lag(close) OVER {over()} - 1)')} AS gap_pct, {_r(f'100 * (close / lag(close, 5) OVER {over()} - 1)')} AS ret5 FROM bars""",
)
def changes(spark: SparkSession, sf: str) -> DataFrame:
    b = B.brand_bars(spark, sf)
    gap = ratio("open", F.lag("close").over(series.over_time())) - 1
    cols = {"chg_pct": series.change("close"), "vol_chg_pct": series.change("volume"), "gap_pct": gap, "ret5": series.change("close", 5)}
    return rounded(b.select("symbol", "date", *[(100 * v).alias(k) for k, v in cols.items()]))


@query(
    "w9_rvol",
    f"""{_BB}, a AS (SELECT *, {guard('avg(volume)', 'volume', 10, 10)} AS av FROM bars)
    SELECT symbol, date, {_r('av')} AS avg_vol_10d, {_r(f'volume / lag(av) OVER {over()}')} AS rvol_10d FROM a""",
)
def rvol(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.relative_volume(B.brand_bars(spark, sf)).select("symbol", "date", "avg_vol_10d", "rvol_10d"))


@query(
    "w10_levels",
    f"""{_BB}, a AS (SELECT *, {guard('max(high)', 'high', 20, 20)} AS h20, {guard('min(low)', 'low', 20, 20)} AS l20,
      {guard('max(high)', 'high', 252, 60)} AS h252, {guard('min(low)', 'low', 252, 60)} AS l252 FROM bars)
    SELECT symbol, date, {', '.join(_r(f'lag({a}) OVER {over()}') + f' AS {b}' for a, b in (('h20', 'high_20d'), ('l20', 'low_20d'), ('h252', 'high_252'), ('l252', 'low_252')))},
      {_r('100 * (close / h252 - 1)')} AS pct_from_52w_high, {_r('100 * (close / l252 - 1)')} AS pct_from_52w_low FROM a""",
)
def levels(spark: SparkSession, sf: str) -> DataFrame:
    names = ("high_20d", "low_20d", "high_252", "low_252", "pct_from_52w_high", "pct_from_52w_low")
    return rounded(series.levels(B.brand_bars(spark, sf)).select("symbol", "date", *names))


@query(
    "w12_relative_strength",
    f"""WITH {bars('nation')}, {bars('market', name='mkt')}, j AS (SELECT bars.*, m.close AS bench FROM bars LEFT JOIN mkt m ON m.date = bars.date)
    SELECT symbol, date, {_r(f'100 * (close / lag(close, 21) OVER {over()} - bench / lag(bench, 21) OVER {over()})')} AS rs_1m_pct,
      {_r(f'100 * (close / lag(close, 63) OVER {over()} - bench / lag(bench, 63) OVER {over()})')} AS rs_3m_pct FROM j""",
)
def relative_strength(spark: SparkSession, sf: str) -> DataFrame:
    b = series.relative_strength(B.nation_bars(spark, sf), B.market_bars(spark, sf))
    return rounded(b.select("symbol", "date", "rs_1m_pct", "rs_3m_pct"))


@query(
    "w13_scaled",
    f"""{_NB}, s AS (SELECT symbol, date, close, {guard('stddev_pop(close)', 'close', 52, 26)} AS sd FROM bars)
    SELECT symbol, date, {_r('(close - 1500) / CASE WHEN sd > 1e-9 THEN sd END')} AS scaled FROM s""",
)
def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.nation_bars(spark, sf).select("symbol", "date", series.scaled("close", 52, 1500.0).alias("scaled")))


@query(
    "w14_z_scores",
    f"""{_NB}, m AS (SELECT symbol, date, close, close / lag(close, 21) OVER {over()} - 1 AS mom, row_number() OVER {over()} AS n FROM bars)
    SELECT symbol, date, {_r(f'CASE WHEN n >= 51 AND count(mom) OVER {over(180)} >= 30 THEN (mom - avg(mom) OVER {over(180)}) / nullif(stddev_samp(mom) OVER {over(180)}, 0) END')} AS z_mom,
      {_r(f'CASE WHEN count(close) OVER {over(180)} >= 30 THEN (close - avg(close) OVER {over(180)}) / nullif(stddev_samp(close) OVER {over(180)}, 0) END')} AS z_level FROM m""",
)
def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = series.z_momentum(B.nation_bars(spark, sf), "close")
    return rounded(b.select("symbol", "date", "z_mom", series.z_level("close").alias("z_level")))


@query(
    "w16_realized_vol",
    f"""{_NB}, r AS (SELECT symbol, date, ln(close / lag(close) OVER {over()}) AS r FROM bars)
    SELECT symbol, date, {_r(guard('stddev_samp(r)', 'r', 20, 20) + ' * sqrt(252) * 100', 5)} AS realized_vol FROM r""",
)
def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.realized_volatility(B.nation_bars(spark, sf)).select("symbol", "date", "realized_vol"), 5)


@query(
    "w20_weekly_last",
    f"""WITH {bars('nation', 'day')}, n AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol, isoyear(date), weekofyear(date) ORDER BY date DESC) AS k FROM bars)
    SELECT symbol, date, {_r('close')} AS close FROM n WHERE k = 1""",
)
def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.weekly_last(B.nation_bars(spark, sf, "day")).select("symbol", "date", "close"))


@query(
    "w21_onsets",
    f"""{_NB}, c AS (SELECT symbol, date, CASE WHEN close > lag(close) OVER {over()} THEN 'UP' ELSE 'DOWN' END AS call FROM bars),
    p AS (SELECT *, lag(call) OVER {over()} AS b FROM c) SELECT symbol, date, call FROM p WHERE b IS NULL OR b <> call""",
)
def onsets(spark: SparkSession, sf: str) -> DataFrame:
    up = F.when(F.col("close") > F.lag("close").over(series.over_time()), "UP").otherwise("DOWN")
    return series.onsets(B.nation_bars(spark, sf).select("symbol", "date", up.alias("call")), "call", "symbol")


@query(
    "w24_baseline",
    f"{_NB} SELECT symbol, date, {_r('avg(nullif(volume, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)')} AS baseline FROM bars",
)
def baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.nation_bars(spark, sf).select("symbol", "date", series.baseline("volume").alias("baseline")))


@query(
    "w26_drawdown",
    f"""{_NB} SELECT symbol, date, {_r('close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown,
      {_r('100 * (close / first(close) OVER (PARTITION BY symbol, year(date) ORDER BY date) - 1)')} AS ytd FROM bars""",
)
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.nation_bars(spark, sf).select("symbol", "date", series.drawdown("close").alias("drawdown"), series.year_to_date().alias("ytd")))


@query(
    "w27_turnover",
    f"""{_NB}, w AS (SELECT symbol, date, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars), d AS (SELECT date, abs(weight - lag(weight) OVER {over()}) AS d FROM w)
    SELECT date, {_r('sum(coalesce(d, 0)) / 2')} AS turnover FROM d GROUP BY date""",
)
def turnover(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))
    return rounded(series.turnover(B.nation_bars(spark, sf).select("symbol", "date", w.alias("weight"))))


_LABELS = "l AS (SELECT DISTINCT date, 'Q' || quarter(date) AS label FROM mkt WHERE day(date) <= 7)"


@query(
    "j9_as_of",
    f"""WITH {bars('nation', 'day')}, {bars('market', name='mkt')}, {_LABELS}
    SELECT symbol, bars.date AS date, l.label AS label FROM bars ASOF LEFT JOIN l ON bars.date >= l.date""",
)
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    labels = B.market_bars(spark, sf).filter(F.dayofmonth("date") <= 7).select("date", F.concat(F.lit("Q"), F.quarter("date")).alias("label"))
    return series.as_of(B.nation_bars(spark, sf, "day").select("symbol", "date"), labels, "label")


@query(
    "j12_next_bar",
    f"""WITH {bars('market', name='mkt')}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS bar_no FROM mkt), e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
    SELECT e.date AS date, CAST((SELECT min(bar_no) FROM c WHERE c.date > e.date + 4) AS INTEGER) AS bar_no FROM e""",
)
def next_bar(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    calendar = B.market_bars(spark, sf).select("date", F.row_number().over(Window.orderBy("date")).alias("bar_no"))
    return series.next_bar(B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct(), calendar, 4)


@query(
    "j13_forward",
    f"""WITH {bars('nation', 'day')}, d AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS bar_no FROM (SELECT DISTINCT date FROM bars)),
    g AS (SELECT s.symbol, d.date, d.bar_no, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN d LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date)
    SELECT symbol, date, bar_no, {_r(f"100 * (lead(close, 5) OVER {over(order='bar_no')} / close - 1)")} AS fwd5 FROM g""",
)
def forward(spark: SparkSession, sf: str) -> DataFrame:
    g = B.grid(B.nation_bars(spark, sf, "day"))
    return rounded(g.select("symbol", "date", "bar_no", (100 * (ratio(series.forward("close", 5), "close") - 1)).alias("fwd5")))


# Breadth

_AGG = f"""a0 AS (SELECT *, close - lag(close) OVER {over()} AS chg, {', '.join(f"{guard('avg(close)', 'close', n, n)} AS s{n}" for n in (20, 50, 200))},
    {', '.join(f"{average('close', span(n), n)} AS e{n}" for n in (5, 10, 20))}, {guard('max(close)', 'close', 252, 252)} AS hi, {guard('min(close)', 'close', 252, 252)} AS lo FROM bars),
  agg AS (SELECT date, count_if(chg > 0) AS advances, count_if(chg < 0) AS declines, count_if(chg = 0) AS unchanged,
    coalesce(sum(volume) FILTER (chg > 0), 0) AS up_vol, coalesce(sum(volume) FILTER (chg < 0), 0) AS down_vol,
    {', '.join(f"100.0 * count_if(close > s{n}) / nullif(count_if(s{n} IS NOT NULL), 0) AS pct_above_{n}" for n in (20, 50, 200))},
    {', '.join(f"count_if(close > e{n}) AS n_above_{n}ema, 100.0 * count_if(close > e{n}) / nullif(count_if(e{n} IS NOT NULL), 0) AS pct_above_{n}ema" for n in (5, 10, 20))},
    count_if(close >= hi) AS new_highs, count_if(close <= lo) AS new_lows, count_if(chg IS NOT NULL) AS n_symbols FROM a0 GROUP BY date HAVING count_if(chg IS NOT NULL) > 0)"""
_COUNTS = ("advances", "declines", "unchanged", "new_highs", "new_lows", "n_symbols", "n_above_5ema", "n_above_10ema", "n_above_20ema")


@query(
    "a1_breadth",
    f"""{_NB}, {_AGG} SELECT date, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, up_vol, down_vol,
    {', '.join(_r(c) + f' AS {c}' for c in ('pct_above_20', 'pct_above_50', 'pct_above_200', 'pct_above_5ema', 'pct_above_10ema', 'pct_above_20ema'))} FROM agg""",
)
def breadth_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(breadth.aggregates(B.nation_bars(spark, sf)))


def _moves(c: str, x: float) -> str:
    return f"count_if({c} {'>=' if x > 0 else '<='} {x})"


_MOVES = {"up4": ("r1", 0.04), "down4": ("r1", -0.04), "up25q": ("r65", 0.25), "down25q": ("r65", -0.25), "up25m": ("r20", 0.25), "down25m": ("r20", -0.25), "up50m": ("r20", 0.5), "down50m": ("r20", -0.5), "up13": ("r34", 0.13), "down13": ("r34", -0.13)}


@query(
    "a6_monitor",
    f"""{_NB}, p AS (SELECT *, lag(close) OVER {over()} AS pc FROM bars),
    t AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
      {', '.join(f'close / lag(close, {n}) OVER {over()} - 1 AS r{n}' for n in (1, 20, 34, 65))}, {guard('avg(close)', 'close', 50, 50)} AS s50 FROM p),
    u AS (SELECT *, {average('tr', 1 / 14, 14)} AS atr FROM t),
    d AS (SELECT date, {', '.join(f'{_moves(*v)} AS {k}' for k, v in _MOVES.items())}, count_if(close >= s50 + 10 * atr) AS atr_ext, count_if(r1 IS NOT NULL) AS n_symbols FROM u GROUP BY date),
    w AS (SELECT *, {', '.join(f"CASE WHEN count(*) OVER {over(n, '')} >= {n} THEN sum(up4) OVER {over(n, '')} / nullif(sum(down4) OVER {over(n, '')}, 0) END AS q{n}" for n in (5, 10))} FROM d)
    SELECT date, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in (*_MOVES, 'atr_ext', 'n_symbols'))}, {_r('q5')} AS ratio5, {_r('q10')} AS ratio10 FROM w WHERE n_symbols > 0""",
)
def monitor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(breadth.monitor(B.nation_bars(spark, sf)))


_DER = f"""x AS (SELECT *, 1000.0 * (advances - declines) / nullif(advances + declines, 0) AS rana, advances / nullif(advances + declines, 0) AS sh,
    100.0 * new_highs / nullif(new_highs + new_lows, 0) AS hl FROM agg),
  der AS (SELECT *, {average('rana', span(19), 0, '')} - {average('rana', span(39), 0, '')} AS mcclellan, 19.0 * ({average('rana', span(39), 0, '')}) - 9.0 * ({average('rana', span(19), 0, '')}) AS summation,
    {average('sh', span(10), 0, '')} AS zbt_ema, sum(advances - declines) OVER (ORDER BY date) AS ad_line, avg(hl) OVER {over(10, '')} AS hl_index,
    (advances / nullif(declines, 0)) / nullif(up_vol / nullif(down_vol, 0), 0) AS trin FROM x),
  reg AS (SELECT *, CASE WHEN summation > 0 THEN 1 ELSE -1 END + CASE WHEN coalesce(summation - lag(summation, 5) OVER (ORDER BY date), 0) > 0 THEN 1 ELSE -1 END
    + CASE WHEN pct_above_200 >= 60 THEN 1 WHEN pct_above_200 < 50 THEN -1 ELSE 0 END AS score FROM der)"""


@query(
    "d1_derived",
    f"""{_NB}, {_AGG}, {_DER} SELECT date, {_r('mcclellan')} AS mcclellan, {_r('summation')} AS summation, {_r('zbt_ema')} AS zbt_ema, CAST(ad_line AS BIGINT) AS ad_line, {_r('hl_index')} AS hl_index, {_r('trin')} AS trin FROM der""",
)
def derived(spark: SparkSession, sf: str) -> DataFrame:
    d = breadth.derived(breadth.aggregates(B.nation_bars(spark, sf)))
    return rounded(d.select("date", "mcclellan", "summation", "zbt_ema", "ad_line", "hl_index", "trin"))


@query(
    "d11_regime",
    f"""{_NB}, {_AGG}, {_DER} SELECT date, {_r('summation', 4)} AS summation, CAST(score AS INTEGER) AS regime_score,
    CASE WHEN score >= 3 THEN 'HEALTHY' WHEN score <= -2 THEN 'DETERIORATING' ELSE 'NEUTRAL' END AS regime FROM reg""",
)
def regime(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: bars to breadth to averages to a regime for each date."""
    d = breadth.regime_labels(breadth.derived(breadth.aggregates(B.nation_bars(spark, sf))))
    return rounded(d.select("date", "summation", "regime_score", "regime"), 4)


@query(
    "d6_thrusts",
    f"""{_NB}, {_AGG}, {_DER}, z AS (SELECT date, zbt_ema AS x, lag(zbt_ema) OVER (ORDER BY date) AS b, min(zbt_ema) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM der)
    SELECT date FROM z WHERE x >= 0.615 AND b < 0.615 AND m <= 0.40""",
)
def thrusts(spark: SparkSession, sf: str) -> DataFrame:
    return breadth.thrusts(breadth.derived(breadth.aggregates(B.nation_bars(spark, sf)))).select("date")


@query("d8_divergences")
def divergences(spark: SparkSession, sf: str) -> DataFrame:
    d = breadth.derived(breadth.aggregates(B.nation_bars(spark, sf)))
    d = d.join(B.market_bars(spark, sf).select("date", F.col("close").alias("index_close")), "date")
    return breadth.divergences(d, "index_close", ["ad_line", "mcclellan", "pct_above_50"])


@query(
    "d16_rotation_label",
    f"""WITH {bars('nation')}, {bars('market', name='mkt')}, e AS (SELECT date, avg(close) AS a FROM bars GROUP BY date), j AS (SELECT e.date, a / m.close AS r FROM e JOIN mkt m ON m.date = e.date),
    k AS (SELECT date, r, {average('r', span(50), 0, '')} AS ema FROM j) SELECT date, {_r('r')} AS ratio, {_r('ema')} AS ema, CASE WHEN r > ema THEN 'on' ELSE 'off' END AS rotation FROM k""",
)
def rotation_label(spark: SparkSession, sf: str) -> DataFrame:
    equal = B.nation_bars(spark, sf).groupBy("date").agg(F.avg("close").alias("close"))
    return rounded(breadth.concentration(equal, B.market_bars(spark, sf)))
