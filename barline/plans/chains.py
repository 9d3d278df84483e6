"""Queries of regimes, rotation details, the macro panel, votes, picks and decisions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import breadth, desk, feeds, macro, rankings, rotation, scores, series, votes, wave
from ..sources import bars as B
from ..sources.store import session_store, union_all
from .desk import _FLOW, _flow, _pick
from .models import _COMP, _MK, _POOL, _RRG
from .registry import query, rounded
from .screener import _SNAP, _snapshot
from .sql import average, bars, over
from .waves import _timeline, _waves
from .windows import _AGG, _DER, _NB, _r

# Breadth


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth and its chains, recomputed once in an application and kept as a derived table."""
    name = f"breadth-{hashlib.md5(sf.encode()).hexdigest()[:12]}"
    return session_store(spark).once(name, lambda: breadth.derived(breadth.aggregates(B.nation_bars(spark, sf))))


@query(
    "a16_gauges",
    f"{_NB}, {_AGG} SELECT date, {_r('100.0 * advances / nullif(advances + declines, 0)')} AS adv_pct, {_r('100.0 * new_highs / nullif(new_highs + new_lows, 0)')} AS nh_pct FROM agg",
)
def gauges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(breadth.gauges(breadth.aggregates(B.nation_bars(spark, sf))))


_EVENTS = "ev AS (SELECT DISTINCT date, CASE WHEN day(date) % 2 = 0 THEN 'bearish' ELSE 'bullish' END AS kind, 'ad_line' AS measure FROM bars WHERE day(date) <= 9)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    d = B.nation_bars(spark, sf).select("date").distinct().filter(F.dayofmonth("date") <= 9)
    return d.select("date", F.when(F.dayofmonth("date") % 2 == 0, "bearish").otherwise("bullish").alias("kind"), F.lit("ad_line").alias("measure"))


@query("d9_active", f"{_NB}, {_EVENTS} SELECT date, kind, measure FROM ev WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 21)")
def active(spark: SparkSession, sf: str) -> DataFrame:
    return breadth.active(_events(spark, sf), B.nation_bars(spark, sf).select("date").distinct())


_STATE = f"""ls AS (SELECT date, summation, coalesce(summation - lag(summation, 5) OVER (ORDER BY date), 0) AS slope FROM der WHERE summation IS NOT NULL QUALIFY row_number() OVER (ORDER BY date DESC) = 1),
  lp AS (SELECT pct_above_200 AS p FROM agg WHERE pct_above_200 IS NOT NULL ORDER BY date DESC LIMIT 1), na AS (SELECT count(*) AS n FROM ev WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 21)),
  sc AS (SELECT date, summation, slope, p, n, CASE WHEN summation > 0 THEN 1 ELSE -1 END + CASE WHEN slope > 0 THEN 1 ELSE -1 END + CASE WHEN p >= 60 THEN 1 WHEN p < 50 THEN -1 ELSE 0 END - least(n, 2) AS score FROM ls, lp, na),
  rs_ AS (SELECT *, CASE WHEN score >= 3 THEN 'HEALTHY' WHEN score <= -2 THEN 'DETERIORATING' ELSE 'NEUTRAL' END AS regime FROM sc)"""


@query(
    "d10_regime_state",
    f"{_NB}, {_AGG}, {_DER}, {_EVENTS}, {_STATE} SELECT date, {_r('summation', 4)} AS summation, {_r('slope', 4)} AS slope, {_r('p', 4)} AS pct_above_200, n AS n_divergences, CAST(score AS INTEGER) AS score, regime FROM rs_",
)
def regime_state(spark: SparkSession, sf: str) -> DataFrame:
    """The current regime with its divergence leg."""
    d = _days(spark, sf)
    s = breadth.regime_state(d, breadth.active(_events(spark, sf), d.select("date")))
    return rounded(s.select("date", "summation", "slope", "pct_above_200", "n_divergences", "score", "regime"), 4)


@query(
    "d12_extremes",
    f"""{_NB}, {_AGG}, {_DER}, {_EVENTS}, {_STATE}, ld AS (SELECT mcclellan, trin, pct_above_20 FROM der ORDER BY date DESC LIMIT 1),
    th AS (SELECT max(date) AS d FROM ev WHERE date IN (SELECT date FROM der ORDER BY date DESC LIMIT 21))
    SELECT regime, concat_ws(', ', CASE WHEN mcclellan <= -70 THEN 'oversold' WHEN mcclellan >= 70 THEN 'overbought' END, CASE WHEN trin >= 2 THEN 'panic' WHEN trin <= 0.5 THEN 'euphoria' END,
      CASE WHEN pct_above_20 <= 20 THEN 'washout' WHEN pct_above_20 >= 85 THEN 'stretch' END, 'thrust ' || CAST(d AS VARCHAR)) AS tags FROM rs_, ld, th""",
)
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    d = _days(spark, sf)
    return breadth.extremes(d, breadth.regime_state(d, breadth.active(_events(spark, sf), d.select("date"))), _events(spark, sf))


@query(
    "d13_dashboard",
    f"""WITH {bars('nation')}, {bars('market', name='mkt')}, {_AGG}, {_DER}, eq AS (SELECT date, avg(close) AS a FROM bars GROUP BY date) SELECT der.date AS date, {_r('mcclellan')} AS mcclellan, CAST(ad_line AS BIGINT) AS ad_line, {_r('eq.a / m.close')} AS concentration
    FROM der LEFT JOIN eq ON eq.date = der.date LEFT JOIN mkt m ON m.date = der.date ORDER BY der.date DESC LIMIT 100""",
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    equal = B.nation_bars(spark, sf).groupBy("date").agg(F.avg("close").alias("close"))
    return rounded(breadth.dashboard(_days(spark, sf), equal, B.market_bars(spark, sf), 100).select("date", "mcclellan", "ad_line", "concentration"))


@query(
    "d14_tape",
    f"""WITH {bars('nation')}, {bars('market', name='mkt')}, r AS (SELECT *, close / lag(close) OVER {over()} - 1 AS r FROM bars), d AS (SELECT date, count(*) FILTER (r >= 0.04) AS up4, count(*) FILTER (r <= -0.04) AS down4 FROM r GROUP BY date HAVING count(r) > 0)
    SELECT d.date AS date, up4, down4, {_r('m.close')} AS index_close FROM d LEFT JOIN mkt m ON m.date = d.date ORDER BY d.date DESC LIMIT 60""",
)
def tape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(breadth.tape(breadth.monitor(B.nation_bars(spark, sf)), B.market_bars(spark, sf), 60).select("date", "up4", "down4", "index_close"))


# Rotation


@query(
    "g7_turning_scores",
    f"""{_NB}, {_MK}, {_COMP}, {_RRG}, p AS (SELECT symbol, date, round_even(x, 3) AS x, round_even(y, 3) AS y FROM xy), t AS (SELECT *, count(y) OVER {over(6)} AS n, y - first(y) OVER {over(6)} AS run, y - lag(y) OVER {over()} AS kick FROM p)
    SELECT symbol, date, {', '.join(f"CAST(coalesce(CASE WHEN n >= 2 THEN greatest(0, least(100, round_even(50 + {16 * s} * run + 8 * greatest({s} * kick, 0.0) + 5 * least(greatest({-s} * (x - 100), 0.0), 3.0), 0))) END, 0) AS INTEGER) AS {c}" for c, s in (('accumulate', 1), ('distribute', -1)))} FROM t WHERE x IS NOT NULL AND run IS NOT NULL AND kick IS NOT NULL""",
)
def turning_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = rotation.coordinates(B.nation_bars(spark, sf), B.market_bars(spark, sf)).select("symbol", "date", "x", "y")
    w = series.over_time()
    known = F.col("x").isNotNull() & (F.col("y") - F.lag("y").over(w)).isNotNull() & F.first("y").over(w.rowsBetween(-5, 0)).isNotNull()
    return rotation.turning_scores(p.withColumn("__k", known)).filter("__k").select("symbol", "date", "accumulate", "distribute")


@query("g3_as_of", f"{_NB}, {_MK}, {_COMP} SELECT symbol, date, {_r('c')} AS rs_composite FROM comp WHERE date <= DATE '1998-06-30'")
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    """What was known on a date: the windows see nothing later."""
    return rounded(rankings.composite(rotation.as_of_date(B.nation_bars(spark, sf), "1998-06-30"), B.market_bars(spark, sf)).select("symbol", "date", "rs_composite"))


@query(
    "g4_time_frames",
    f"""WITH {bars('nation')}, {bars('nation', 'month', 'mb')}, m AS (SELECT symbol, date, lag(CASE WHEN close > open THEN 0.5 ELSE -0.5 END) OVER w AS c, lag(CASE WHEN close > open THEN 'bull' ELSE 'bear' END) OVER w AS d FROM mb WINDOW w AS (PARTITION BY symbol ORDER BY date)), n AS (SELECT * FROM m WHERE c IS NOT NULL)
    SELECT bars.symbol AS symbol, bars.date AS date, coalesce(n.c, 0.0)::DOUBLE AS mtf_1mo, coalesce(n.d, 'none') AS div_1mo FROM bars ASOF LEFT JOIN n ON bars.symbol = n.symbol AND bars.date >= n.date""",
)
def time_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly contributions, a month late, on weekly rows."""
    m = B.nation_bars(spark, sf, "month")
    up = F.col("close") > F.col("open")
    frame = m.select("symbol", "date", F.when(up, 0.5).otherwise(-0.5).alias("contrib"), F.when(up, "bull").otherwise("bear").alias("div"))
    return rotation.attached(B.nation_bars(spark, sf).select("symbol", "date"), {"1mo": (frame, 1)})


@query("g4_timeline")
def mtf_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline with monthly wave contributions; path-dependent, so without SQL."""
    b, market = B.nation_bars(spark, sf, "month"), B.market_bars(spark, sf, "month")
    lines = series.aligned(b, market).withColumn("rs", 100 * F.col("close") / F.col("bench")).filter("rs is not null")
    month = rotation.contribution_of(wave.waves(lines.select("symbol", "date", "rs", "close")))
    t = rotation.timeline(rotation.attached(_waves(spark, sf), {"1mo": (month, 1)}))
    return rounded(t.select("symbol", "date", "mtf_1mo", "conviction", "call"))


@query(
    "g11_agreement",
    """WITH d AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'none' END AS a, CASE p_partkey % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'none' END AS b, CASE p_partkey % 2 WHEN 0 THEN 'bull' ELSE 'none' END AS h, CASE p_partkey % 5 WHEN 0 THEN 'bear' ELSE 'none' END AS l FROM part),
    s AS (SELECT *, concat_ws('+', CASE WHEN a = 'bull' THEN 'RS' END, CASE WHEN b = 'bull' THEN 'price' END, CASE WHEN h = 'bull' THEN 'HTF' END, CASE WHEN l = 'bull' THEN 'LTF' END) AS up, concat_ws('+', CASE WHEN a = 'bear' THEN 'RS' END, CASE WHEN b = 'bear' THEN 'price' END, CASE WHEN h = 'bear' THEN 'HTF' END, CASE WHEN l = 'bear' THEN 'LTF' END) AS dn FROM d)
    SELECT id, concat_ws('+', CASE WHEN a = 'bull' AND b = 'bull' THEN 'RS+price' END, CASE WHEN h = 'bull' THEN 'HTF' END, CASE WHEN l = 'bull' THEN 'LTF' END) AS agree, CASE WHEN up <> '' THEN 'bullish: ' || up WHEN dn <> '' THEN 'bearish: ' || dn END AS summary FROM s""",
)
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    d = B.table(spark, sf, "part").select(
        k.alias("id"), _pick(F.col("p_size") % 3, ["bull", "bear"], "none").alias("a"), _pick(k % 3, ["bull", "bear"], "none").alias("b"), _pick(k % 2, ["bull"], "none").alias("h"), _pick(k % 5, ["bear"], "none").alias("l")
    )
    c = [F.col(n) for n in "abhl"]
    return d.select("id", rotation.agreement(F.lit("bull"), *c).alias("agree"), rotation.divergence_summary(*c).alias("summary"))


_CALLS = f"""ch AS (SELECT symbol, date, 100 * (close / lag(close) OVER {over()} - 1) AS chg FROM bars), ca AS (SELECT symbol, date, CASE WHEN chg > 10 THEN 'ROTATE IN' WHEN chg < -10 THEN 'ROTATE OUT' WHEN chg > 0 THEN 'HOLD' ELSE 'WATCH' END AS call, chg AS conviction FROM ch WHERE chg IS NOT NULL)"""


def plain_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A panel of calls that SQL can repeat: by each bar's change."""
    c = B.nation_bars(spark, sf).select("symbol", "date", (100 * series.change("close")).alias("conviction")).filter("conviction is not null")
    x = F.col("conviction")
    return c.withColumn("call", F.when(x > 10, "ROTATE IN").when(x < -10, "ROTATE OUT").when(x > 0, "HOLD").otherwise("WATCH"))


@query("g15_best", f"{_NB}, {_CALLS}, l AS (SELECT * FROM ca WHERE date = (SELECT max(date) FROM ca)) SELECT symbol, call, {_r('conviction')} AS conviction FROM l ORDER BY call = 'ROTATE IN' DESC, coalesce(nullif(conviction, 0), -1e9) DESC, symbol LIMIT 1")
def best(spark: SparkSession, sf: str) -> DataFrame:
    c = plain_calls(spark, sf)
    return rounded(rotation.best(c.join(c.agg(F.max("date").alias("date")), "date")).select("symbol", "call", "conviction"))


@query(
    "r13_legs",
    f"""{_NB}, {_CALLS}, k AS (SELECT symbol, date, 1 AS side, row_number() OVER (PARTITION BY date ORDER BY conviction DESC, symbol) AS k FROM ca WHERE call = 'ROTATE IN' UNION ALL SELECT symbol, date, -1, row_number() OVER (PARTITION BY date ORDER BY conviction, symbol) FROM ca WHERE call = 'ROTATE OUT')
    SELECT symbol, date, side, {_r('side / count(*) OVER (PARTITION BY date, side)')} AS weight FROM k WHERE k <= 3""",
)
def legs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rankings.leg_weights(plain_calls(spark, sf)))


@query(
    "r10_theme_leaders",
    f"""{_NB}, m AS (SELECT symbol, sector, date, 100 * (close / lag(close, 21) OVER {over()} - 1) AS move FROM bars), l AS (SELECT symbol, sector, arg_max(move, date) AS move FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) GROUP BY ALL)
    SELECT sector AS theme, symbol, {_r('move')} AS move, CAST(row_number() OVER (PARTITION BY sector ORDER BY move DESC, symbol) AS INTEGER) AS place FROM l WHERE move IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sector ORDER BY move DESC, symbol) <= 3""",
)
def theme_leaders(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    themes = b.groupBy(F.col("sector").alias("theme")).agg(F.collect_set("symbol").alias("symbols"))
    return rounded(rankings.theme_leaders(b, themes).select("theme", "symbol", "move", "place"))


@query(
    "r10_theme_board",
    f"""WITH {bars('nation', name='nb')}, {_MK}, tr AS (SELECT sector, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM nb), td AS (SELECT sector, date, coalesce(avg(r), 0) AS ret FROM tr GROUP BY ALL),
    bars AS (SELECT sector AS symbol, sector, date, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY sector ORDER BY date)) AS close FROM td), {_COMP}, {_POOL}, k AS (SELECT symbol, rank, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM pool),
    m AS (SELECT symbol, 100 * (close / lag(close, 5) OVER {over()} - bench / lag(bench, 5) OVER {over()}) AS rs_1w, 100 * (close / max(close) OVER {over(252)} - 1) AS off_high, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM q)
    SELECT m.symbol AS symbol, {_r('rs_1w', 4)} AS rs_1w, {_r('off_high', 4)} AS off_high, rank FROM m LEFT JOIN k ON k.symbol = m.symbol AND k.k = 1 WHERE m.k = 1""",
)
def theme_board(spark: SparkSession, sf: str) -> DataFrame:
    """The leaderboard with baskets in the place of symbols."""
    b = B.nation_bars(spark, sf)
    themes = b.groupBy(F.col("sector").alias("theme")).agg(F.collect_set("symbol").alias("symbols"))
    board = rankings.leaderboard(rankings.baskets(b, themes).select(F.col("theme").alias("symbol"), "date", "close"), B.market_bars(spark, sf))
    return rounded(board.select("symbol", "rs_1w", "off_high", "rank"), 4)


_PARTS = "pt AS (SELECT p_partkey AS symbol, p_brand AS list, CASE WHEN p_size % 4 > 0 THEN p_size::DOUBLE END AS rs, p_retailprice AS float_ FROM part)"


@query(
    "r11_percentiles",
    f"""WITH {_PARTS}, a AS (SELECT symbol, CAST(least(99, round_even(100 * cume_dist() OVER (ORDER BY rs), 0)) AS INTEGER) AS rs_rating FROM pt WHERE rs IS NOT NULL),
    b AS (SELECT symbol, CAST(least(99, round_even(100 * cume_dist() OVER (PARTITION BY list ORDER BY rs), 0)) AS INTEGER) AS local_rating FROM pt WHERE rs IS NOT NULL) SELECT pt.symbol AS symbol, rs_rating, local_rating FROM pt LEFT JOIN a ON a.symbol = pt.symbol LEFT JOIN b ON b.symbol = pt.symbol""",
)
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks over the universe and within each list."""
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("list"), F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("double")).alias("rs"))
    out = rankings.cross_percentile(rankings.cross_percentile(p, "rs", "rs_rating"), "rs", "local_rating", ["list"])
    return out.select("symbol", "rs_rating", "local_rating")


@query("r8_holdings", "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, round_even(100 * s_acctbal / 1e6, 2) AS weight_pct, CASE WHEN s_suppkey % 2 = 0 THEN 5.0::DOUBLE END AS chg_pct FROM supplier WHERE s_nationkey % 3 = 0 ORDER BY s_acctbal DESC LIMIT 10")
def holdings(spark: SparkSession, sf: str) -> DataFrame:
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_acctbal") / 1e6).alias("weight"), (F.col("s_nationkey") % 3).cast("string").alias("fund"), "s_suppkey")
    return rankings.holdings(s, s.filter("s_suppkey % 2 = 0").select("symbol", F.lit(5.0).alias("chg_pct")), "0")


@query("k4_blend", f"WITH {_PARTS} SELECT symbol, {_r('(0.6 * coalesce(rs, 0) + 0.4 * float_) / (CASE WHEN rs IS NULL THEN 0 ELSE 0.6 END + 0.4)')} AS rs_value FROM pt")
def blend(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("double")).alias("rs"), F.col("p_retailprice").alias("float_"))
    return rounded(rankings.blended_strength(p, {"rs": 0.6, "float_": 0.4}).select("symbol", "rs_value"))


# Macro panel

_NAMES = ("^VIX", "^VIX3M", "SPY", "HYG", "UUP", "BTC-USD", "HG=F", "GC=F", "XLK", "XLY", "XLC", "XLU", "XLP", "XLV", "XLE", "XLF", "XLI", "IWM")
_SERIES = {"AUTOMOBILE": ("T10Y2Y", 1e6), "BUILDING": ("BAMLH0A0HYM2", 5e4), "FURNITURE": ("T10YIE", 1e5), "HOUSEHOLD": ("ICSA", 1.0)}
_LINES = f"""mp AS (SELECT * FROM (VALUES {', '.join(f"('NATION_{k}', '{n}')" for k, n in enumerate(_NAMES))}) v(symbol, name)), pr AS (SELECT mp.name AS symbol, date, close FROM bars JOIN mp ON mp.symbol = bars.symbol),
  rt AS (SELECT v.sid AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) / any_value(v.d) AS close FROM orders JOIN customer ON o_custkey = c_custkey JOIN (VALUES {', '.join(f"('{k}', '{s}', {d!r}::DOUBLE)" for k, (s, d) in _SERIES.items())}) v(seg, sid, d) ON v.seg = c_mktsegment GROUP BY ALL),
  bk AS (SELECT theme, date, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY theme ORDER BY date)) AS close FROM (SELECT theme, date, coalesce(avg(r), 0) AS ret FROM (SELECT pr.symbol, date, close / lag(close) OVER (PARTITION BY pr.symbol ORDER BY date) - 1 AS r FROM pr) x
    JOIN (VALUES {', '.join(f"('{t}', '{s}')" for t, m in (('g', macro.GROWTH), ('d', macro.DEFENSIVE), ('c', macro.CYCLICAL)) for s in m)}) v(theme, symbol) ON v.symbol = x.symbol GROUP BY theme, date)),
  nm AS (SELECT symbol, date, close FROM pr UNION ALL SELECT theme, date, close FROM bk),
  own AS (SELECT v.line, date, close AS value FROM (SELECT * FROM pr UNION ALL SELECT * FROM rt) z JOIN (VALUES {', '.join(f"('{n}', '{s}')" for n, s in (('vix', '^VIX'), ('vix3m', '^VIX3M'), ('spy', 'SPY'), ('hyg', 'HYG'), ('dxy', 'UUP'), ('btc', 'BTC-USD'), ('copper', 'HG=F'), ('gold', 'GC=F'), ('curve', 'T10Y2Y'), ('credit', 'BAMLH0A0HYM2'), ('breakeven', 'T10YIE'), ('claims', 'ICSA')))}) v(line, symbol) ON v.symbol = z.symbol),
  quo AS (SELECT v.line, a.date, a.close / b.close AS value FROM (VALUES {', '.join(f"('{n}', '{a}', '{b}')" for n, a, b in (('small', 'IWM', 'SPY'), ('tech', 'XLK', 'SPY'), ('energy', 'XLE', 'SPY'), ('hs', 'HYG', 'SPY'), ('cg', 'HG=F', 'GC=F'), ('lead', 'g', 'd'), ('cyc', 'c', 'd')))}) v(line, a, b) JOIN nm a ON a.symbol = v.a JOIN nm b ON b.symbol = v.b AND b.date = a.date),
  ln AS (SELECT * FROM own WHERE value IS NOT NULL UNION ALL SELECT * FROM quo WHERE value IS NOT NULL),
  l1 AS (SELECT *, value / lag(value, 20) OVER w - 1 AS m20, value / lag(value, 4) OVER w - 1 AS m4, row_number() OVER w AS n, ln(value / lag(value) OVER w) AS lr FROM ln WINDOW w AS (PARTITION BY line ORDER BY date)),
  l2 AS (SELECT line, date, value AS v, value - lag(value, 4) OVER w AS d4, value - lag(value, 20) OVER w AS d20, 100 * (value / lag(value, 20) OVER w - 1) AS p20, 100 * (value / lag(value, 63) OVER w - 1) AS p63,
    CASE WHEN n >= 50 AND count(m20) OVER t >= 30 THEN (m20 - avg(m20) OVER t) / nullif(stddev_samp(m20) OVER t, 0) END AS z, CASE WHEN n >= 34 AND count(m4) OVER t >= 30 THEN (m4 - avg(m4) OVER t) / nullif(stddev_samp(m4) OVER t, 0) END AS z4,
    CASE WHEN count(value) OVER t >= 30 THEN (value - avg(value) OVER t) / nullif(stddev_samp(value) OVER t, 0) END AS zl, CASE WHEN n > 200 THEN 100 * (value / avg(value) OVER (PARTITION BY line ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) - 1) END AS m200,
    CASE WHEN count(lr) OVER u >= 20 THEN stddev_samp(lr) OVER u * sqrt(252) * 100 END AS rv FROM l1 WINDOW w AS (PARTITION BY line ORDER BY date), t AS (PARTITION BY line ORDER BY date ROWS BETWEEN 179 PRECEDING AND CURRENT ROW), u AS (PARTITION BY line ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  l3 AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY line ORDER BY date DESC) = 1),
  br AS (SELECT pct_above_50, pct_above_200, (new_highs - new_lows)::DOUBLE AS nh_nl, advances / nullif(declines, 0) AS adv_dec, mcclellan FROM der ORDER BY date DESC LIMIT 1),
  inp AS (SELECT br.*, {', '.join(f"max(CASE WHEN line = '{n}' THEN {w} END) OVER () AS {n}_{w}" for n in macro.LINES for w in macro.READINGS)} FROM l3, br LIMIT 1)"""


def _panel_lines(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    names = spark.createDataFrame([(f"NATION_{k}", n) for k, n in enumerate(_NAMES)], "symbol string, name string")
    prices = b.join(names, "symbol").select(F.col("name").alias("symbol"), "date", "close")
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ids = spark.createDataFrame([(k, s, d) for k, (s, d) in _SERIES.items()], "c_mktsegment string, series_id string, d double")
    rates = o.join(ids, "c_mktsegment").groupBy("series_id", F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).agg((F.avg("o_totalprice") / F.first("d")).alias("value"))
    return macro.lines(prices, rates)


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    last = _days(spark, sf).agg(F.max_by(F.struct("pct_above_50", "pct_above_200", F.col("nh_nl").cast("double").alias("nh_nl"), (F.col("advances") / F.when(F.col("declines") > 0, F.col("declines"))).alias("adv_dec"), "mcclellan"), "date").alias("x"))
    return macro.readings(_panel_lines(spark, sf)).crossJoin(last.select("x.*"))


_ROWS = " UNION ALL ".join(
    f"SELECT {k} AS place, '{key}' AS key, '{panel}' AS panel, round_even(({value})::DOUBLE, 3) AS value, '{unit}' AS unit, round_even(({change})::DOUBLE, 2) AS delta, '{du}' AS delta_unit, CASE {' '.join(f'''WHEN {t} THEN '{s}' ''' for t, s in states)} END AS state FROM inp"
    for k, (key, panel, value, unit, change, du, states) in enumerate(macro.INDICATORS)
)


@query("k19_indicators", f"{_NB}, {_AGG}, {_DER}, {_LINES}, ir AS ({_ROWS}) SELECT * FROM ir WHERE value IS NOT NULL")
def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of both panels."""
    return rounded(macro.indicator_rows(_inputs(spark, sf)))


@query(
    "k20_summaries",
    f"""{_NB}, {_AGG}, {_DER}, {_LINES}, ir AS ({_ROWS}), s AS (SELECT panel, count(*) AS n, count(*) FILTER (state <> 'STABLE') AS n_caution, count(*) FILTER (state = 'COMPLACENT') AS n_complacent FROM ir WHERE value IS NOT NULL GROUP BY panel)
    SELECT *, CASE WHEN n_caution = 0 THEN 'healthy' WHEN n_complacent >= 2 AND n_complacent >= n_caution - 1 THEN 'complacent' ELSE 'mixed' END AS reading FROM s""",
)
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return macro.panel_summary(macro.indicator_rows(_inputs(spark, sf)))


def _axis(inputs: tuple[tuple[str, str], ...]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS k, '{label}' AS label, CASE WHEN {e} IS NOT NULL THEN greatest(-3, least(3, {e})) END AS z FROM inp" for k, (label, e) in enumerate(inputs))


@query(
    "k21_features",
    f"""{_NB}, {_AGG}, {_DER}, {_LINES}, gi AS ({_axis(macro.GROWTH_INPUTS)}), ii AS ({_axis(macro.INFLATION_INPUTS)}), al AS (SELECT k, label, z FROM gi UNION ALL SELECT k + 100, label, z FROM ii),
    dr AS (SELECT string_agg(label, ' · ' ORDER BY a DESC, k) AS driver FROM (SELECT label, k, abs(round_even(z, 2)) AS a FROM al WHERE z IS NOT NULL ORDER BY a DESC, k LIMIT 3))
    SELECT round_even(coalesce((SELECT avg(z) FROM gi), 0), 3) AS growth_z, round_even(coalesce((SELECT avg(z) FROM ii), 0), 3) AS inflation_z, driver FROM dr""",
)
def features(spark: SparkSession, sf: str) -> DataFrame:
    """The axes of the regime and what drives them."""
    return rounded(macro.regime_features(_inputs(spark, sf)))


@query(
    "k24_market_health",
    f"""WITH {bars('market', name='mkt')}, b AS (SELECT * FROM mkt), h AS (SELECT date, close, avg(close) OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS a50, avg(close) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS a200, first(close) OVER (PARTITION BY year(date) ORDER BY date) AS y, {average('close', 2 / 311, 0, '')} AS e FROM b)
    SELECT date, round_even(100 * (close / a50 - 1), 2) AS vs_50, round_even(100 * (close / a200 - 1), 2) AS vs_200, round_even(100 * (close / e - 1), 2) AS vs_long_ema, round_even(100 * (close / y - 1), 2) AS ytd FROM h ORDER BY date DESC LIMIT 1""",
)
def market_health(spark: SparkSession, sf: str) -> DataFrame:
    return desk.market_health(B.market_bars(spark, sf)).drop("symbol")


# Votes and their combination

_VOTES = f"""v1 AS (SELECT 'breadth' AS domain, CASE regime WHEN 'HEALTHY' THEN 1 WHEN 'DETERIORATING' THEN -1 ELSE 0 END AS direction, CASE WHEN regime = 'NEUTRAL' THEN 20 ELSE least(100, 40 + 18 * abs(score)) END::DOUBLE AS conviction, 30.0::DOUBLE AS weight, true AS ok FROM rs_),
  lc AS (SELECT * FROM ca WHERE date = (SELECT max(date) FROM ca)), v2 AS (SELECT 'rrg', sign(net)::INTEGER, round_even(least(100, abs(net) / greatest(1, n)), 1), 20.0::DOUBLE, true FROM (SELECT coalesce(sum(CASE WHEN call IN ('ROTATE IN', 'HOLD') THEN conviction WHEN call IN ('ROTATE OUT', 'AVOID') THEN -conviction END), 0) AS net, count(*) FILTER (call <> 'WATCH') AS n FROM lc)),
  lk AS (SELECT 'x' || symbol AS symbol, rank FROM pool QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
  v3 AS (SELECT 'rankings', coalesce(sign(s)::INTEGER, 0), CASE WHEN s IS NULL THEN 0 ELSE round_even(least(100, abs(s) * 1.4), 1) END, 15.0::DOUBLE, s IS NOT NULL FROM (SELECT avg(rank) FILTER (symbol IN ('xNATION_0', 'xNATION_1', 'xNATION_2', 'xNATION_3', 'xNATION_4')) - avg(rank) FILTER (symbol IN ('xNATION_5', 'xNATION_6', 'xNATION_7')) AS s FROM lk)),
  v4 AS (SELECT 'canslim', CASE WHEN k >= 3 OR top >= 65 THEN 1 ELSE 0 END, round_even(least(100.0, k * 11 + greatest(0, top - 50)), 1)::DOUBLE, 15.0::DOUBLE, true FROM (SELECT count(*) FILTER (p_size >= 45) AS k, max(p_size) + 25.0::DOUBLE AS top FROM (SELECT p_size FROM part ORDER BY p_partkey LIMIT 10))),
  ft AS (SELECT * FROM fs WHERE day = (SELECT max(day) FROM fs) AND classification = 'conviction' ORDER BY conviction DESC, notional DESC LIMIT 1), v5 AS (SELECT 'flow', CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END, round_even(least(100, conviction), 1), 10.0::DOUBLE, true FROM ft),
  v6 AS (SELECT 'news', -1, 28.0::DOUBLE, 12.0::DOUBLE, true),
  v7 AS (SELECT 'screener', sign(net)::INTEGER, least(60, abs(net) * 6 + 15)::DOUBLE, 8.0::DOUBLE, true FROM (SELECT sum(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS net FROM events WHERE event_id < 40)),
  v8 AS (SELECT 'themes', 0, 0.0::DOUBLE, 6.0::DOUBLE, false), v9 AS (SELECT 'macro', 1, round_even(0.5 * 70 + 12, 1)::DOUBLE, 18.0::DOUBLE, true),
  vt AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4 UNION ALL SELECT * FROM v5 UNION ALL SELECT * FROM v6 UNION ALL SELECT * FROM v7 UNION ALL SELECT * FROM v8 UNION ALL SELECT * FROM v9)"""


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    d = _days(spark, sf)
    calls = plain_calls(spark, sf)
    board = rankings.pooled_rank(rankings.composite(B.nation_bars(spark, sf), B.market_bars(spark, sf)), "rs_composite", "rank").filter("rank is not null")
    names = dict(zip((f"NATION_{k}" for k in range(8)), (*desk.OFFENSIVE, *desk.DEFENSIVE), strict=True))
    fund = F.when(F.lit(False), "")
    for k, v in names.items():
        fund = fund.when(F.col("symbol") == k, v)
    last = board.groupBy("symbol").agg(F.max_by("rank", "date").alias("rank")).select(fund.alias("symbol"), "rank")
    leaders = B.table(spark, sf, "part").orderBy("p_partkey").limit(10).select(F.when(F.col("p_size") >= 45, F.col("p_size") + 25.0).otherwise(F.least(F.col("p_size") + 25.0, F.lit(69.0))).alias("rating"), "p_size")
    top = leaders.agg(F.max("p_size").alias("m"))
    leaders = leaders.crossJoin(top).select(F.when(F.col("p_size") == F.col("m"), F.col("p_size") + 25.0).otherwise(F.col("rating")).alias("rating"))
    f = _flow(spark, sf)
    e = B.table(spark, sf, "events").filter("event_id < 40")
    rule = F.when(F.col("event_type") == "click", "vol_thrust_down").when(F.col("event_type") == "view", "gap_up").when(F.col("event_type") == "error", "rsi_overbought").otherwise("break_52w_high")
    one = spark.range(1)
    parts = [
        votes.breadth(breadth.regime_state(d, breadth.active(_events(spark, sf), d.select("date")))),
        votes.rrg(calls.join(calls.agg(F.max("date").alias("date")), "date")),
        votes.rankings(last),
        votes.canslim(leaders),
        votes.flow(f.join(f.agg(F.max("day").alias("day")), "day")),
        votes.news(one.select(F.lit(9).alias("days_until"), F.lit(False).alias("flagged")), one.select(F.lit(True).alias("inverted"))),
        votes.screener(e.select(rule.alias("rule_key"), F.lit("x").alias("kind"))),
        votes.themes(one.limit(0).select(F.lit(50).alias("rank"))),
        votes.macro(one.select(F.lit(0.5).alias("equity_tilt"), F.lit(42).alias("confidence"))),
    ]
    return union_all(parts)


@query("k26_votes", f"{_NB}, {_MK}, {_COMP}, {_POOL}, {_AGG}, {_DER}, {_EVENTS}, {_STATE}, {_CALLS}, {_FLOW}, {_VOTES} SELECT * FROM vt")
def all_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The votes of nine domains, one of them without data."""
    return rounded(_votes(spark, sf))


@query(
    "k27_combined",
    f"""{_NB}, {_MK}, {_COMP}, {_POOL}, {_AGG}, {_DER}, {_EVENTS}, {_STATE}, {_CALLS}, {_FLOW}, {_VOTES}, c AS (SELECT round_even(greatest(-100, least(100, sum(direction * conviction / 100 * weight * CASE domain WHEN 'rrg' THEN 0.5 WHEN 'rankings' THEN 1.2 WHEN 'canslim' THEN 1.2 ELSE 1 END))), 1) AS score, count(*) AS n_votes FROM vt WHERE ok)
    SELECT score, n_votes, CASE WHEN score >= 40 THEN 'Risk-on' WHEN score >= 15 THEN 'Lean bullish' WHEN score > -15 THEN 'Neutral' WHEN score > -40 THEN 'Lean bearish' ELSE 'Risk-off' END AS posture FROM c""",
)
def combined(spark: SparkSession, sf: str) -> DataFrame:
    """The votes combined in a concentrated market."""
    return rounded(scores.combined(_votes(spark, sf), "CONCENTRATE"), 1)


@query("k28_stance", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 OR p_partkey % 2 = 1 THEN 'CONCENTRATE' WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'ROTATE' ELSE 'NEUTRAL' END AS stance, (CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.75 END)::DOUBLE AS factor FROM part")
def stance(spark: SparkSession, sf: str) -> DataFrame:
    """Stance of a regime and a rotation state, and the regime's factor for picks."""
    regime = _pick(F.col("p_size") % 3, ["HEALTHY", "NEUTRAL"], "DETERIORATING")
    rot = _pick(F.col("p_partkey") % 2, ["on"], "off")
    factor = scores.pick(F.lit(1.0), F.lit(1.0), regime, F.lit(False))
    return B.table(spark, sf, "part").select("p_partkey", scores.stance(regime, rot).alias("stance"), factor.alias("factor"))


@query(
    "k29_sector_scores",
    f"""{_NB}, {_MK}, {_COMP}, {_POOL}, {_CALLS}, lc AS (SELECT * FROM ca WHERE date = (SELECT max(date) FROM ca)), lk AS (SELECT symbol, rank FROM pool QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
    s AS (SELECT lc.symbol, rank, CASE WHEN call IN ('ROTATE IN', 'HOLD') THEN 1 WHEN call IN ('ROTATE OUT', 'AVOID') THEN -1 ELSE 0 END AS sg, conviction FROM lc LEFT JOIN lk ON lk.symbol = lc.symbol)
    SELECT symbol, coalesce(rank IS NOT NULL AND sg <> 0 AND (sg > 0) = (rank >= 50), false) AS agree, round_even((sg * conviction * 0.5 + coalesce((rank - 50) * 0.6, 0)) * CASE WHEN rank IS NOT NULL AND sg <> 0 AND (sg > 0) = (rank >= 50) THEN 1.25 ELSE 1 END, 1) AS score FROM s""",
)
def sector_scores(spark: SparkSession, sf: str) -> DataFrame:
    calls = plain_calls(spark, sf)
    board = rankings.leaderboard(B.nation_bars(spark, sf), B.market_bars(spark, sf))
    out = scores.sector_scores(calls.join(calls.agg(F.max("date").alias("date")), "date"), board, suppressed=True)
    return rounded(out.select("symbol", F.coalesce("agree", F.lit(False)).alias("agree"), "score"), 1)


# Picks and fundamentals on snapshot rows

_PK = """fx AS (SELECT p_partkey AS symbol, p_size / 2.0::DOUBLE AS close, p_size / 2.2::DOUBLE AS sma50, p_size / 2.1::DOUBLE + p_partkey % 5 AS sma200, CASE WHEN p_partkey % 4 > 0 THEN p_size::DOUBLE END AS pe_ratio, -(p_partkey % 45)::DOUBLE AS pct_from_52w_high, (p_partkey % 100)::DOUBLE AS rsi14,
  CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' END AS ad_rating, (p_size - 20) / 10.0::DOUBLE AS g, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 130) / 100.0::DOUBLE END AS held, (p_partkey % 21 - 10)::DOUBLE AS rs1, (p_partkey % 15 - 7)::DOUBLE AS rs3,
  CASE p_partkey % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'none' END AS flag, (p_partkey % 2)::DOUBLE AS pocket, (p_partkey % 5 / 1.2)::DOUBLE AS rvol, (p_partkey % 9 - 4)::DOUBLE AS chg, (p_partkey % 7) * 1e6::DOUBLE AS vol, (p_partkey % 100)::DOUBLE AS rating FROM part)"""


def _pick_rows(spark: SparkSession, sf: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    d = lambda x: x.cast("double")
    letter = F.when(k % 6 == 0, "A").when(k % 6 == 1, "B").when(k % 6 == 2, "C").when(k % 6 == 3, "D").when(k % 6 == 4, "E")
    return B.table(spark, sf, "part").select(
        k.alias("symbol"), (z / 2.0).alias("close"), (z / 2.2).alias("sma50"), (z / 2.1 + k % 5).alias("sma200"), F.when(k % 4 > 0, d(z)).alias("pe_ratio"), d(-(k % 45)).alias("pct_from_52w_high"), d(k % 100).alias("rsi14"),
        letter.alias("ad_rating"), ((z - 20) / 10.0).alias("eps_growth_q"), F.lit(None).cast("double").alias("eps_growth_a"), F.when(k % 3 > 0, (k % 130) / 100.0).alias("inst_pct_held"), d(k % 21 - 10).alias("rs_1m_pct"), d(k % 15 - 7).alias("rs_3m_pct"),
        _pick(k % 3, ["bull", "bear"], "none").alias("flag"), d(k % 2).alias("gp_in_pocket"), F.lit(1.0).alias("gp_approaching"), d(z).alias("high_20d"), (k % 5 / 1.2).alias("rvol_10d"), d(k % 9 - 4).alias("chg_pct"),
        (z / 2.1).alias("ema20"), (z / 2.15).alias("ema50"), _pick(k % 4, ["buyer"], "none").alias("exhaustion"), ((k % 7) * 1e6).alias("avg_vol_10d"), F.lit(2.0).alias("atr14"), d(k % 100).alias("rs_rating"),
    )


_GROW = "CASE WHEN {g} IS NULL THEN NULL WHEN {g} <= 0 THEN 0 ELSE least(100, 75 * pow({g} / 0.25, 0.6)) END"
_SUBS = f"""h1 AS (SELECT *, CASE WHEN held > 1.5 THEN held / 100 ELSE held END AS hd, CASE WHEN abs(g) > 3 THEN g / 100 ELSE g END AS gf FROM fx),
  sb AS (SELECT *, {_GROW.format(g='gf')} AS s1, CASE ad_rating WHEN 'A' THEN 100 WHEN 'B' THEN 75 WHEN 'C' THEN 50 WHEN 'D' THEN 25 WHEN 'E' THEN 0 END AS s2, CASE WHEN hd < 0.15 THEN 35 WHEN hd > 0.92 THEN 45 WHEN hd BETWEEN 0.40 AND 0.85 THEN 80 WHEN hd IS NOT NULL THEN 65 END AS s3,
    CASE WHEN pe_ratio <= 0 THEN 35 WHEN pe_ratio <= 20 THEN 90 WHEN pe_ratio >= 60 THEN 15 WHEN pe_ratio IS NOT NULL THEN 90 - (pe_ratio - 20) / 40 * 75 END AS s4,
    (CASE WHEN close > sma50 AND sma50 > sma200 THEN 80.0 WHEN close > sma200 THEN 55 ELSE 25 END + greatest(0, least(100, 100 * (40 - abs(pct_from_52w_high)) / 35)) + CASE WHEN rsi14 >= 80 OR rsi14 <= 20 THEN 40 ELSE 70 END) / 3 AS s5, greatest(0, least(100, 50 + 5 * (rs1 + rs3) / 2)) AS s6 FROM h1 WHERE close <> 0 AND sma50 <> 0 AND sma200 <> 0),
  fd AS (SELECT *, (0.24::DOUBLE * s1 + 0.14 * coalesce(s2, 0) + 0.10 * coalesce(s3, 0) + 0.16 * coalesce(s4, 0) + 0.20 * s5 + 0.16 * s6) / (0.24::DOUBLE + CASE WHEN s2 IS NULL THEN 0 ELSE 0.14 END + CASE WHEN s3 IS NULL THEN 0 ELSE 0.10 END + CASE WHEN s4 IS NULL THEN 0 ELSE 0.16 END + 0.36) AS raw FROM sb)"""


@query("k7_fundamental", f"WITH {_PK}, {_SUBS} SELECT symbol, {_r('raw', 5)} AS fund_raw, CASE WHEN raw >= 70 THEN 'Strong' WHEN raw >= 55 THEN 'Solid' WHEN raw >= 40 THEN 'Mixed' ELSE 'Weak' END AS fund_verdict FROM fd")
def fundamental(spark: SparkSession, sf: str) -> DataFrame:
    """Fundamental conviction over what is known."""
    rows = _pick_rows(spark, sf).filter("close <> 0 and sma50 <> 0 and sma200 <> 0")
    return rounded(scores.fundamental(rows).select("symbol", "fund_raw", "fund_verdict"), 5)


_PICKS = f"""im AS (SELECT *, greatest(0, least(100, CASE flag WHEN 'bull' THEN 25 WHEN 'bear' THEN -15 ELSE 0 END + CASE WHEN pocket <> 0 THEN 20 ELSE 10 END + CASE WHEN pct_from_52w_high >= -2 THEN 20 ELSE 0 END + CASE WHEN rvol >= 3 THEN 20 WHEN rvol >= 2 THEN 12 WHEN rvol >= 1.5 AND abs(chg) < 3 THEN 8 ELSE 0 END
    + CASE ad_rating WHEN 'A' THEN 15 WHEN 'B' THEN 8 WHEN 'D' THEN -10 WHEN 'E' THEN -10 ELSE 0 END + CASE WHEN rs1 > 0 AND rs3 > 0 THEN 10 ELSE 0 END + 8 + CASE WHEN symbol % 4 = 0 THEN -20 ELSE 0 END))::DOUBLE AS impulse FROM fd),
  hl AS (SELECT *, greatest(0, least(100, (0.45::DOUBLE * raw + 0.55::DOUBLE * greatest(0, least(100, 50 + (rating - 50) * 0.4::DOUBLE + CASE WHEN close > sma50 AND sma50 > sma200 THEN 15 WHEN close < sma200 THEN -15 ELSE 0 END)))
    * CASE WHEN close < 5 THEN 0.5 ELSE 1 END * CASE WHEN close * vol < 3e6 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN close < sma200 AND rs1 < 0 THEN 0.7::DOUBLE ELSE 1 END)) AS hold FROM im)"""


@query(
    "k11_picks",
    f"""WITH {_PK}, {_SUBS}, {_PICKS} SELECT symbol, {_r('impulse')} AS impulse, {_r('hold', 5)} AS hold, {_r('greatest(0, least(100, sqrt(impulse * hold) * 0.9 * 0.85))', 5)} AS pick, round_even(close - 4, 2) AS stop, round_even(close + 8, 2) AS target, hold >= 45 AND impulse >= 40 AS tradeable FROM hl""",
)
def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Impulse, hold and pick of every row near an event in a neutral market."""
    rows = scores.fundamental(_pick_rows(spark, sf).filter("close <> 0 and sma50 <> 0 and sma200 <> 0"))
    p = scores.picks(rows, F.lit(None).cast("double"), F.col("fund_raw"), F.col("rs_rating"), F.lit("NEUTRAL"), F.lit(True))
    return rounded(p.select("symbol", "impulse", "hold", "pick", "stop", "target", "tradeable"), 5)


@query("k12_suggestions", f"WITH {_PK}, {_SUBS}, {_PICKS}, p AS (SELECT symbol, greatest(0, least(100, sqrt(impulse * hold))) AS pick FROM hl WHERE symbol % 3 = 0) SELECT symbol, {_r('pick', 4)} AS pick FROM p ORDER BY pick DESC, symbol LIMIT 20")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """A watchlist's rows scored end to end, best first."""
    rows = _pick_rows(spark, sf).filter("close <> 0 and sma50 <> 0 and sma200 <> 0")
    members = rows.filter("symbol % 3 = 0").select("symbol")
    return rounded(scores.suggestions(rows, members, "HEALTHY", False, 20).select("symbol", "pick"), 4)


@query(
    "k5_leaderboard",
    """WITH f AS (SELECT p_partkey AS symbol, p_size::DOUBLE + p_partkey % 50 AS score FROM part) SELECT symbol, greatest(0, least(99, round_even(score * 0.6, 0))) AS rating FROM f ORDER BY score DESC, symbol LIMIT 15""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """K5, K6: the best scores in a deteriorating market."""
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") + F.col("p_partkey") % 50).cast("double").alias("score"))
    return scores.rated(p, F.lit("DETERIORATING"), 15).select("symbol", "rating")


@query("k17_trade_sides", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'above_ask' WHEN 2 THEN 'ask' WHEN 3 THEN 'below_bid' WHEN 4 THEN 'bid' ELSE 'mid' END AS side, CASE WHEN p_size <= 1 THEN '0dte' WHEN p_size < 21 THEN 'weekly' WHEN p_size * 10 >= 270 AND p_partkey % 2 = 0 THEN 'leaps' ELSE 'swing' END AS bucket FROM part")
def trade_sides(spark: SparkSession, sf: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    last = F.when(k % 6 == 1, 2.2).when(k % 6 == 2, 2.1).when(k % 6 == 3, 1.9).when(k % 6 == 4, 2.0).when(k % 6 == 5, 2.05)
    dte = F.when((z * 10 >= 270) & (k % 2 == 0), z * 10).otherwise(z)
    return B.table(spark, sf, "part").select("p_partkey", scores.aggressor(last, F.lit(2.0), F.lit(2.1)).alias("side"), scores.expiry(dte).alias("bucket"))


_ALIGN = "CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END * (CASE p_size % 3 WHEN 0 THEN 0.35 WHEN 1 THEN -0.35 ELSE 0 END + CASE p_partkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN -0.25 ELSE 0 END + CASE p_size % 4 WHEN 0 THEN 0.4 WHEN 1 THEN -0.4 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 0.25 ELSE 0 END + CASE p_partkey % 7 WHEN 0 THEN 0.3 WHEN 1 THEN -0.3 ELSE 0 END)::DOUBLE"


@query("k18_alignment", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 0.0 ELSE {_r(f'greatest(-1, least(1, {_ALIGN}))')} END AS conf FROM part")
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    conf = scores.alignment(_pick(k % 3, ["bullish", "bearish"], "unclear"), _pick(z % 3, ["rotate in", "AVOID"], "WATCH"), _pick(k % 4, ["HEALTHY", "DETERIORATING"], "NEUTRAL"), _pick(z % 4, ["discount", "premium"], "value"), F.when(k % 5 == 0, True), _pick(k % 7, ["a", "E"], "C"))
    return rounded(B.table(spark, sf, "part").select("p_partkey", conf.alias("conf")))


@query(
    "k34_texts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, '%b %Y') ELSE 'Q' || quarter(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH) || ' ' || year(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH) END AS period,
    CASE date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN -1 THEN 'yesterday' ELSE CASE WHEN CAST(o_orderdate AS DATE) > DATE '1997-06-01' THEN 'in ' || date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) || ' days' ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-06-01') || ' days ago' END END AS relative FROM orders""",
)
def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The period that a release is about, and a date in words."""
    o = B.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", feeds.reference_period(F.col("d"), F.when(F.col("o_orderkey") % 2 == 0, "month").otherwise("quarter")).alias("period"), feeds.relative_day(F.col("d"), "1997-06-01").alias("relative"))


@query("k25_brief", f"{_NB}, {_SNAP} SELECT count(*) AS n_symbols, count(*) FILTER (chg_pct > 0) AS n_up, arg_max(symbol, chg_pct) AS best, arg_min(symbol, chg_pct) AS worst FROM snap")
def brief(spark: SparkSession, sf: str) -> DataFrame:
    """The facts that a brief is written from."""
    s = _snapshot(spark, sf)
    return s.agg(F.count("*").alias("n_symbols"), F.sum(F.when(F.col("chg_pct") > 0, 1).otherwise(0)).alias("n_up"), F.max_by("symbol", "chg_pct").alias("best"), F.min_by("symbol", "chg_pct").alias("worst"))


@query(
    "k36_deep_dive",
    f"""{_NB}, {_MK}, {_COMP}, {_POOL}, {_SNAP}, lk AS (SELECT symbol, rank FROM pool QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
    SELECT snap.symbol AS symbol, {_r('snap.close')} AS close, {_r('chg_pct')} AS chg_pct, rank, s.sector AS sector FROM snap JOIN (SELECT DISTINCT symbol, sector FROM bars) s ON s.symbol = snap.symbol LEFT JOIN lk ON lk.symbol = snap.symbol WHERE snap.symbol = 'NATION_7'""",
)
def deep_dive(spark: SparkSession, sf: str) -> DataFrame:
    """One target with everything that is known about it."""
    b = B.nation_bars(spark, sf)
    board = rankings.leaderboard(b, B.market_bars(spark, sf)).select("symbol", "rank")
    s = _snapshot(spark, sf).filter("symbol = 'NATION_7'").select("symbol", "close", "chg_pct")
    return rounded(s.join(b.select("symbol", "sector").distinct(), "symbol").join(board, "symbol", "left"))


@query("g10_calls")
def calls_now(spark: SparkSession, sf: str) -> DataFrame:
    """The last call of each symbol; path-dependent, so without SQL."""
    t = _timeline(spark, sf)
    return rounded(t.groupBy("symbol").agg(F.max_by(F.struct("date", "call", "conviction"), "date").alias("x")).select("symbol", "x.*"))
