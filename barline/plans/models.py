"""Queries of ranks, baskets, rotation, scores, backtests and polled state."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.recursive import span
from ..operators import backtest, rankings, rotation, scores, series
from ..sources import bars as B
from ..sources.store import session_store
from ..streaming import polls as P
from .registry import query, rounded
from .sql import average, bars, guard, over
from .windows import _NB, _r

_MK = bars("market", name="mkt")
_COMP = f"""q AS (SELECT bars.symbol, bars.sector, bars.date, bars.close, m.close AS bench, bars.close / m.close AS q FROM bars LEFT JOIN mkt m ON m.date = bars.date),
  comp AS (SELECT *, 0.5 * 100 * (q / lag(q, 21) OVER {over()} - 1) + 0.3 * 100 * (q / lag(q, 63) OVER {over()} - 1) + 0.2 * 100 * (q / lag(q, 126) OVER {over()} - 1) AS c FROM q)"""


def _nation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return B.nation_bars(spark, sf), B.market_bars(spark, sf)


@query("r1_composite", f"{_NB}, {_MK}, {_COMP} SELECT symbol, date, {_r('c')} AS rs_composite FROM comp")
def composite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rankings.composite(*_nation(spark, sf)).select("symbol", "date", "rs_composite"))


@query(
    "r2_percent_rank",
    f"""{_NB}, {_MK}, {_COMP} SELECT symbol, date, {_r('100.0 * (rank() OVER (PARTITION BY date ORDER BY c) + (count(*) OVER (PARTITION BY date, c) - 1) / 2) / count(*) OVER (PARTITION BY date)')} AS pct FROM comp WHERE c IS NOT NULL""",
)
def percent_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = rankings.composite(*_nation(spark, sf))
    return rounded(c.select("symbol", "date", rankings.percent_rank("rs_composite").alias("pct")).filter("pct is not null"))


_POOL = "pool AS (SELECT *, CAST(least(99, round_even(100 * cume_dist() OVER (ORDER BY c), 0)) AS INTEGER) AS rank FROM comp WHERE c IS NOT NULL)"


@query("r3_pooled_rank", f"{_NB}, {_MK}, {_COMP}, {_POOL} SELECT symbol, date, rank FROM pool")
def pooled_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = rankings.composite(*_nation(spark, sf)).select("symbol", "date", "rs_composite")
    return rankings.pooled_rank(c, "rs_composite").filter("rank is not null").select("symbol", "date", "rank")


@query(
    "r4_leaderboard",
    f"""{_NB}, {_MK}, {_COMP}, {_POOL}, k AS (SELECT symbol, rank, {', '.join(f'lag(rank, {n}) OVER {over()} AS rank_{x}' for x, n in rankings.BACK)}, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM pool),
    m AS (SELECT symbol, {', '.join(f'100 * (close / lag(close, {n}) OVER {over()} - bench / lag(bench, {n}) OVER {over()}) AS rs_{x}' for x, n in rankings.BACK)},
      100 * (close / max(close) OVER {over(252)} - 1) AS off_high, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM q)
    SELECT m.symbol, {', '.join(_r(f'rs_{x}') + f' AS rs_{x}' for x, _ in rankings.BACK)}, {_r('off_high')} AS off_high, rank, {', '.join(f'rank_{x}' for x, _ in rankings.BACK)} FROM m LEFT JOIN k ON k.symbol = m.symbol AND k.k = 1 WHERE m.k = 1""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rankings.leaderboard(*_nation(spark, sf)))


@query("r5_movers")
def movers(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.movers(rankings.leaderboard(*_nation(spark, sf)))


@query(
    "a10_baskets",
    f"""{_NB}, r AS (SELECT sector AS theme, date, close / lag(close) OVER {over()} - 1 AS r FROM bars), d AS (SELECT theme, date, coalesce(avg(r), 0) AS ret FROM r GROUP BY theme, date)
    SELECT theme, date, {_r('ret')} AS ret, {_r('ln(100) + sum(ln(1 + ret)) OVER (PARTITION BY theme ORDER BY date)', 4)} AS log_close FROM d""",
)
def baskets(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    themes = b.select("sector", "symbol").distinct().groupBy(F.col("sector").alias("theme")).agg(F.collect_list("symbol").alias("symbols"))
    out = rankings.baskets(b, themes)
    return out.select("theme", "date", (F.round("ret", 6) + 0.0).alias("ret"), F.round(F.log("close"), 4).alias("log_close"))


_RRG = f"""rs AS (SELECT symbol, sector, date, q AS rs, 100 * ({average('q', span(10))}) / ({average('q', span(40))}) AS rr FROM q),
  rd AS (SELECT *, rr - lag(rr, 5) OVER {over()} AS d FROM rs),
  rm AS (SELECT *, {average('d', span(3))} AS m FROM rd),
  xy AS (SELECT symbol, date, rr, 100 + 4.0 * (rr - 100) / nullif({guard('stddev_pop(rr)', 'rr', 52, 26)}, 0) AS x, 100 + 2.2 * m / nullif({guard('stddev_pop(m)', 'm', 26, 20)}, 0) AS y FROM rm)"""


@query("g1_ratio_line", f"{_NB}, {_MK}, {_COMP}, {_RRG} SELECT symbol, date, {_r('rr')} AS rs_ratio FROM xy")
def ratio_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rotation.ratio_line(*_nation(spark, sf)).select("symbol", "date", "rs_ratio"))


@query(
    "g2_coordinates",
    f"{_NB}, {_MK}, {_COMP}, {_RRG} SELECT symbol, date, {_r('x', 4)} AS x, {_r('y', 4)} AS y, CASE WHEN x >= 100 AND y >= 100 THEN 'LEADING' WHEN x >= 100 THEN 'WEAKENING' WHEN y >= 100 THEN 'IMPROVING' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'LAGGING' END AS quadrant FROM xy",
)
def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    p = rotation.coordinates(*_nation(spark, sf))
    return rounded(p.select("symbol", "date", "x", "y", rotation.quadrant(F.col("x"), F.col("y")).alias("quadrant")), 4)


@query("g6_headings")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    p = rotation.coordinates(*_nation(spark, sf)).select("symbol", "date", "x", "y")
    return rounded(rotation.last_points(rotation.headings(p)))


# Scores over the part and supplier tables as stand-ins for fundamentals

_FUND = """f AS (SELECT p_partkey AS symbol, (p_size - 20) / 50.0::DOUBLE AS eps_growth_q, CASE WHEN p_size % 3 > 0 THEN (p_size - 10) / 40.0::DOUBLE END AS eps_growth_a, -(p_partkey % 45)::DOUBLE AS pct_from_52w_high,
    CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' END AS ad_rating, (p_partkey % 100)::DOUBLE AS float_pctl, (p_retailprice % 100)::INTEGER AS rs_rating, NULL::DOUBLE AS inst_score FROM part)"""


@query(
    "k3_canslim",
    f"""WITH {_FUND}, l AS (SELECT symbol, CASE WHEN eps_growth_q <= 0 THEN 0 ELSE least(100, 75 * pow(eps_growth_q / 0.25, 0.6)) END AS c, CASE WHEN eps_growth_a IS NULL THEN NULL WHEN eps_growth_a <= 0 THEN 0 ELSE least(100, 75 * pow(eps_growth_a / 0.25, 0.6)) END AS a,
      greatest(0, least(100, 100 * (30 - abs(pct_from_52w_high)) / 25)) AS n, 0.75 * CASE ad_rating WHEN 'A' THEN 100 WHEN 'B' THEN 75 WHEN 'C' THEN 50 WHEN 'D' THEN 25 WHEN 'E' THEN 0 END + 0.25 * (100 - float_pctl) AS s, rs_rating::DOUBLE AS l FROM f)
    SELECT symbol, {_r('(0.2 * c + 0.15 * coalesce(a, 0) + 0.15 * n + 0.15 * coalesce(s, 0) + 0.25 * l) / (0.2 + 0.15 + 0.25 + CASE WHEN a IS NULL THEN 0 ELSE 0.15 END + CASE WHEN s IS NULL THEN 0 ELSE 0.15 END)', 5)} AS score FROM l""",
)
def canslim(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    k = F.col("p_partkey") % 6
    letter = F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "C").when(k == 3, "D").when(k == 4, "E")
    rows = p.select(
        F.col("p_partkey").alias("symbol"),
        ((F.col("p_size") - 20) / 50.0).alias("eps_growth_q"),
        F.when(F.col("p_size") % 3 > 0, (F.col("p_size") - 10) / 40.0).alias("eps_growth_a"),
        (-(F.col("p_partkey") % 45)).cast("double").alias("pct_from_52w_high"),
        letter.alias("ad_rating"),
        (F.col("p_partkey") % 100).cast("double").alias("float_pctl"),
        F.bround(F.col("p_retailprice") % 100).cast("int").alias("rs_rating"),
        F.lit(None).cast("double").alias("inst_score"),
    )
    return rounded(scores.canslim(rows).select("symbol", "score"), 5)


@query("k22_macro", f"""WITH z AS (SELECT c_custkey AS id, (c_acctbal - 4500) / 3000 AS g, (c_custkey % 7 - 3)::DOUBLE / 2 AS i FROM customer), p AS (SELECT id, 1 / (1 + exp(-0.9 * g)) AS a, 1 / (1 + exp(-0.9 * i)) AS b FROM z),
    q AS (SELECT id, unnest([{{'n': 'Goldilocks', 'p': a * (1 - b), 'k': 0}}, {{'n': 'Reflation', 'p': a * b, 'k': 1}}, {{'n': 'Stagflation', 'p': (1 - a) * b, 'k': 2}}, {{'n': 'Disinflation', 'p': (1 - a) * (1 - b), 'k': 3}}]) AS s FROM p),
    r AS (SELECT id, s.n AS n, s.p AS p, row_number() OVER (PARTITION BY id ORDER BY s.p DESC, s.k) AS k FROM q)
    SELECT id, max(n) FILTER (k = 1) AS macro, CASE WHEN max(p) FILTER (k = 1) - max(p) FILTER (k = 2) >= 0.18 THEN 'Low' WHEN max(p) FILTER (k = 1) - max(p) FILTER (k = 2) >= 0.07 THEN 'Moderate' ELSE 'High' END AS shift_risk FROM r GROUP BY id""")
def macro(spark: SparkSession, sf: str) -> DataFrame:
    z = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") - 4500) / 3000).alias("g"), ((F.col("c_custkey") % 7 - 3) / 2.0).alias("i"))
    read = scores.macro_regime(F.col("g"), F.col("i"))
    return z.select("id", read["macro"].alias("macro"), read["shift_risk"].alias("shift_risk"))


@query("k33_importance", f"""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(scores.HIGH_WORDS)}') THEN 'high' WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(scores.MED_WORDS)}') THEN 'med' ELSE 'low' END AS importance FROM documents""")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", scores.importance(F.col("text")).alias("importance"))


@query(
    "k31_event_risk",
    """WITH e AS (SELECT CAST(o_orderdate AS DATE) AS event_date, 'order ' || o_orderkey AS title FROM orders WHERE o_orderpriority LIKE '1%'),
    n AS (SELECT *, CAST(event_date - DATE '1998-03-01' AS INTEGER) AS days_until FROM e WHERE event_date - DATE '1998-03-01' BETWEEN 0 AND 10)
    SELECT event_date, title, days_until, days_until <= 2 AS flagged FROM n ORDER BY days_until, title LIMIT 1""",
)
def event_risk(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("event_date"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"),
        F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("low").alias("importance"),
    )
    return scores.event_risk(e, "1998-03-01")


# Polled contracts from the events table

_POLLS = """pl AS (SELECT user_id::VARCHAR AS option_symbol, event_type AS underlying, CAST(ts AS DATE) AS day, ts, event_id, CAST(floor(value * 100) AS BIGINT) AS session_volume, 1.0 + (event_id % 10) / 10.0::DOUBLE AS mark FROM events),
  p1 AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY option_symbol, ts ORDER BY event_id) = 1)"""


def _polls(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("option_symbol"), F.col("event_type").alias("underlying"), F.to_date("ts").alias("day"), "ts", "event_id",
        F.floor(F.col("value") * 100).cast("long").alias("session_volume"), (1.0 + (F.col("event_id") % 10) / 10.0).alias("mark"),
    )
    w = Window.partitionBy("option_symbol", "ts").orderBy("event_id")
    return e.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


@query(
    "t1_poll_deltas",
    f"""WITH {_POLLS}, d AS (SELECT *, greatest(session_volume - coalesce(lag(session_volume) OVER (PARTITION BY option_symbol, day ORDER BY ts), 0), 0) AS volume_delta FROM p1)
    SELECT option_symbol, event_id, volume_delta, CAST(sum(CASE WHEN volume_delta * mark * 100 >= 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY option_symbol, day ORDER BY ts) AS BIGINT) AS cluster_count FROM d""",
)
def poll_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return P.deltas(_polls(spark, sf)).select("option_symbol", "event_id", "volume_delta", "cluster_count")


@query(
    "t3_signals",
    f"""WITH {_POLLS} SELECT day, option_symbol, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(session_volume, ts) AS session_volume FROM p1 GROUP BY day, option_symbol""",
)
def signals(spark: SparkSession, sf: str) -> DataFrame:
    return P.signals(_polls(spark, sf).select("day", "option_symbol", "ts", "session_volume"))


@query(
    "t5_confirmations",
    f"""WITH {_POLLS}, s AS (SELECT day, option_symbol, arg_max(session_volume, ts) AS oi FROM p1 GROUP BY day, option_symbol),
    n AS (SELECT *, lead(day) OVER (PARTITION BY option_symbol ORDER BY day) AS next_day, lead(oi) OVER (PARTITION BY option_symbol ORDER BY day) AS next_oi FROM s)
    SELECT day, option_symbol, next_day, CASE WHEN next_oi - oi >= greatest(500, 0.2 * oi) THEN 'opened' WHEN next_oi - oi <= -greatest(500, 0.2 * oi) THEN 'closed' ELSE 'flat' END AS entry_exit FROM n WHERE next_day IS NOT NULL""",
)
def confirmations(spark: SparkSession, sf: str) -> DataFrame:
    s = P.signals(_polls(spark, sf).select("day", "option_symbol", "ts", "session_volume")).withColumnRenamed("session_volume", "open_interest")
    return P.confirmations(s, s.select("option_symbol", "day", "open_interest"))


@query("t6_first_alerts", f"WITH {_POLLS} SELECT option_symbol AS symbol, day, underlying AS rule_key, min(ts) AS ts FROM p1 GROUP BY ALL")
def first_alerts(spark: SparkSession, sf: str) -> DataFrame:
    a = _polls(spark, sf).select(F.col("option_symbol").alias("symbol"), "day", F.col("underlying").alias("rule_key"), "ts")
    return P.first_alerts(a)


@query(
    "a15_notional",
    f"""WITH {_POLLS}, l AS (SELECT underlying, option_symbol, day, arg_max(session_volume * mark * 100, ts) AS n FROM p1 GROUP BY ALL) SELECT underlying, day, {_r('sum(n)', 3)} AS notional FROM l GROUP BY ALL""",
)
def notional(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.notional(_polls(spark, sf)), 3)


# Backtests

_RULE = [{"field": "chg_pct", "op": ">", "value": 10}]
_GRID = f"""cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS bar_no FROM (SELECT DISTINCT date FROM bars)),
  g0 AS (SELECT s.symbol, cal.date, cal.bar_no, b.open, b.high, b.low, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = cal.date),
  g1 AS (SELECT *, coalesce(100 * (close / lag(close) OVER {over(order='bar_no')} - 1) > 10, false) AS matched FROM g0),
  g2 AS (SELECT *, matched AND NOT coalesce(lag(matched) OVER {over(order='bar_no')}, false) AS onset FROM g1),
  en AS (SELECT symbol, date AS signal_date, bar_no + 1 AS entry_bar, lead(open) OVER {over(order='bar_no')} AS entry_px, onset FROM g2),
  e AS (SELECT * EXCLUDE (onset) FROM en WHERE onset AND entry_px > 0)"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return session_store(spark).once(f"replay-{hashlib.md5(sf.encode()).hexdigest()[:12]}", lambda: _replayed(spark, sf))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    g = B.grid(B.nation_bars(spark, sf))
    chg = 100 * (ratio("close", F.lag("close").over(series.over_time(order="bar_no"))) - 1)
    g = g.withColumn("chg_pct", chg)
    return backtest.replay(series.atr(g.withColumn("date", F.col("date")), 14), _RULE)


def _trades(spark: SparkSession, sf: str, model: str) -> tuple[DataFrame, DataFrame]:
    g = _grid(spark, sf)
    return backtest.exits(backtest.entries(g), g, model), g


_HOLD = """tr AS (SELECT e.symbol, e.signal_date, e.entry_bar, e.entry_px, max(b.bar_no) AS exit_bar FROM e JOIN g2 b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.entry_bar AND e.entry_bar + 9 AND b.close IS NOT NULL GROUP BY ALL),
  th AS (SELECT tr.*, x.close AS exit_px, CASE WHEN exit_bar = entry_bar + 9 THEN 'hold' ELSE 'eod' END AS exit_reason, 100 * (x.close / entry_px - 1) AS return_pct,
    (SELECT 100 * (max(high) / tr.entry_px - 1) FROM g2 WHERE g2.symbol = tr.symbol AND bar_no BETWEEN tr.entry_bar AND tr.exit_bar) AS mfe_pct FROM tr JOIN g2 x ON x.symbol = tr.symbol AND x.bar_no = exit_bar)"""


@query("b3_hold_trades", f"{_NB}, {_GRID}, {_HOLD} SELECT symbol, signal_date, entry_bar, exit_bar, exit_reason, {_r('return_pct')} AS return_pct, {_r('mfe_pct')} AS mfe_pct FROM th")
def hold_trades(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = _trades(spark, sf, "hold")
    return rounded(t.select("symbol", "signal_date", "entry_bar", "exit_bar", "exit_reason", "return_pct", "mfe_pct"))


@query("b4_atr_trades")
def atr_trades(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_trades(spark, sf, "atr")[0])


@query(
    "b5_signal_trades",
    f"""{_NB}, {_GRID}, m AS (SELECT max(bar_no) AS last FROM cal), c AS (SELECT e.*, b.bar_no, b.close, b.matched, least(e.entry_bar + 40, m.last) AS endb FROM e JOIN m ON true JOIN g2 b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.entry_bar AND least(e.entry_bar + 40, m.last)),
    h AS (SELECT symbol, signal_date, entry_bar, entry_px, endb, min(bar_no) AS exit_bar FROM c WHERE NOT matched OR bar_no = endb GROUP BY ALL)
    SELECT h.symbol, signal_date, entry_bar, exit_bar, CASE WHEN NOT x.matched THEN 'signal' ELSE 'cap' END AS exit_reason, {_r('100 * (x.close / entry_px - 1)')} AS return_pct FROM h JOIN g2 x ON x.symbol = h.symbol AND x.bar_no = h.exit_bar WHERE x.close > 0""",
)
def signal_trades(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = _trades(spark, sf, "signal")
    return rounded(t.select("symbol", "signal_date", "entry_bar", "exit_bar", "exit_reason", "return_pct"))


@query(
    "b8_trade_statistics",
    f"""{_NB}, {_GRID}, {_HOLD} SELECT exit_reason, CAST(count(*) AS BIGINT) AS n_trades, {_r('100 * avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END)')} AS win_rate, {_r('avg(return_pct)')} AS avg_return, {_r('median(return_pct)')} AS median_return,
    {_r('coalesce(sum(return_pct) FILTER (return_pct > 0), 0) / nullif(-sum(return_pct) FILTER (return_pct <= 0), 0)', 5)} AS profit_factor FROM th GROUP BY exit_reason""",
)
def trade_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = backtest.trade_statistics(_trades(spark, sf, "hold")[0], ["exit_reason"])
    return s.select("exit_reason", "n_trades", *[(F.round(c, 6) + 0.0).alias(c) for c in ("win_rate", "avg_return", "median_return")], F.round("profit_factor", 5).alias("profit_factor"))


@query(
    "b7_forward_study",
    f"""{_NB}, {_MK}, {_GRID}, mk AS (SELECT cal.bar_no, m.close FROM cal LEFT JOIN mkt m ON m.date = cal.date),
    f AS (SELECT symbol, bar_no, unnest([1, 5, 10, 20]) AS horizon, unnest([{', '.join(f'100 * (lead(close, {h}) OVER {over(order="bar_no")} / close - 1)' for h in (1, 5, 10, 20))}]) AS fwd FROM g2),
    b AS (SELECT bar_no, unnest([1, 5, 10, 20]) AS horizon, unnest([{', '.join(f'100 * (lead(close, {h}) OVER (ORDER BY bar_no) / close - 1)' for h in (1, 5, 10, 20))}]) AS mv FROM mk)
    SELECT CAST(f.horizon AS INTEGER) AS horizon, CAST(count(*) AS BIGINT) AS n, {_r('avg(fwd)')} AS mean, {_r('median(fwd)')} AS median, {_r('avg(fwd - mv)')} AS excess FROM e JOIN f ON f.symbol = e.symbol AND f.bar_no = e.entry_bar LEFT JOIN b ON b.bar_no = e.entry_bar AND b.horizon = f.horizon
    WHERE fwd IS NOT NULL GROUP BY f.horizon""",
)
def forward_study(spark: SparkSession, sf: str) -> DataFrame:
    g = _grid(spark, sf)
    days = g.select("date", "bar_no").distinct()
    market = days.join(B.market_bars(spark, sf).select("date", "close"), "date", "left").select("bar_no", "close")
    moves = backtest.forward_returns(backtest.entries(g), g, market)
    return rounded(backtest.forward_study(moves).select("horizon", "n", "mean", "median", "excess"))


@query(
    "b10_equity_curve",
    f"""{_NB}, {_GRID}, {_HOLD}, r AS (SELECT symbol, bar_no, close / lag(close) OVER {over(order='bar_no')} - 1 AS r FROM g2),
    h AS (SELECT DISTINCT r.bar_no, r.symbol, r.r FROM th JOIN r ON r.symbol = th.symbol AND r.bar_no > entry_bar AND r.bar_no <= exit_bar), d AS (SELECT bar_no, coalesce(sum(r), 0) / count(*) AS ret, count(*) AS n FROM h GROUP BY bar_no),
    c AS (SELECT cal.date, cal.bar_no, coalesce(d.ret, 0) AS ret, coalesce(d.n, 0) AS n FROM cal LEFT JOIN d ON d.bar_no = cal.bar_no), q AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY bar_no)) AS eq FROM c)
    SELECT date, CAST(n AS BIGINT) AS n_held, {_r('ret', 5)} AS ret, {_r('ln(eq)', 5)} AS log_equity, {_r('eq / max(eq) OVER (ORDER BY bar_no ROWS UNBOUNDED PRECEDING) - 1', 5)} AS drawdown FROM q""",
)
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    t, g = _trades(spark, sf, "hold")
    curve = backtest.equity_curve(t, g, g.select("date", "bar_no").distinct())
    return rounded(curve.select("date", "n_held", "ret", F.log("equity").alias("log_equity"), "drawdown"), 5)


@query("b10_performance")
def performance(spark: SparkSession, sf: str) -> DataFrame:
    t, g = _trades(spark, sf, "hold")
    p = backtest.performance(backtest.equity_curve(t, g, g.select("date", "bar_no").distinct()))
    return rounded(p.select(F.log1p(F.col("total_return") / 100).alias("log_return"), F.log1p(F.col("cagr") / 100).alias("log_cagr"), "max_drawdown", "sharpe", "in_market"), 4)


@query("b11_histogram")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.histogram(_trades(spark, sf, "hold")[0])
