"""Queries of rotation trades, ladders, books, walk-forward and the referee over a panel of calls that SQL can repeat."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, books, ladders, rankings, series
from ..sources import bars as B
from ..sources.store import session_store
from .chains import _CALLS, plain_calls
from .models import _MK, _grid
from .registry import query, rounded
from .sql import over
from .windows import _NB, _r

_NBR = _NB.replace("WITH ", "WITH RECURSIVE ", 1)
_ON = f"""cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS bar_no FROM (SELECT DISTINCT date FROM bars)), ml AS (SELECT max(bar_no) AS last_bar FROM cal),
  gr AS (SELECT s.symbol, cal.date, cal.bar_no, b.open, b.high, b.low, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = cal.date),
  {_CALLS}, os AS (SELECT *, lag(call) OVER {over()} AS pc FROM ca), ac AS (SELECT symbol, date, call, conviction, CAST((SELECT min(bar_no) FROM cal WHERE cal.date > os.date + 4) AS INTEGER) AS bar_no FROM os WHERE pc IS NULL OR pc <> call),
  act AS (SELECT * FROM ac WHERE bar_no IS NOT NULL),
  fo AS (SELECT *, first_value(CASE WHEN call IN ('ROTATE OUT', 'AVOID') THEN bar_no END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended FROM act),
  ll AS (SELECT symbol, bar_no, min(low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS leg_low FROM gr),
  cd AS (SELECT fo.symbol, fo.bar_no AS entry_bar, g.open AS entry_px, leg_low, coalesce(ended, last_bar) AS forced, ended IS NOT NULL AS by_call, last_bar FROM fo JOIN gr g ON g.symbol = fo.symbol AND g.bar_no = fo.bar_no JOIN ll ON ll.symbol = fo.symbol AND ll.bar_no = fo.bar_no, ml WHERE call = 'ROTATE IN' AND g.open > 0)"""
_SIM = """ce AS (SELECT *, least(entry_bar + 40, last_bar) AS hard, greatest(least(entry_bar + 40, last_bar, forced), entry_bar) AS exit_bar FROM cd),
  cx AS (SELECT ce.*, CASE WHEN g.open > 0 THEN g.open ELSE g.close END AS exit_px, CASE WHEN by_call AND exit_bar = forced THEN 'signal' WHEN exit_bar = hard AND hard < forced THEN 'cap' ELSE 'eod' END AS exit_reason FROM ce JOIN gr g ON g.symbol = ce.symbol AND g.bar_no = exit_bar),
  cv AS (SELECT * FROM cx WHERE exit_px > 0), nx AS (SELECT a.symbol, a.entry_bar, min(b.entry_bar) AS n FROM cv a LEFT JOIN cv b ON b.symbol = a.symbol AND b.entry_bar > a.exit_bar GROUP BY ALL),
  kp(symbol, entry_bar) AS (SELECT symbol, min(entry_bar) FROM cv GROUP BY symbol UNION ALL SELECT nx.symbol, nx.n FROM kp JOIN nx ON nx.symbol = kp.symbol AND nx.entry_bar = kp.entry_bar WHERE nx.n IS NOT NULL),
  tr AS (SELECT DISTINCT cv.symbol, cv.entry_bar, cv.exit_bar, cv.entry_px, cv.exit_px, exit_reason, 100 * (exit_px / entry_px - 1) AS return_pct FROM cv JOIN kp ON kp.symbol = cv.symbol AND kp.entry_bar = cv.entry_bar)"""


def _acts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = _grid(spark, sf)
    return session_store(spark).once(f"acts-{hashlib.md5(sf.encode()).hexdigest()[:12]}", lambda: ladders.acts(plain_calls(spark, sf), g, 4)), g


def _simulated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a, g = _acts(spark, sf)
    return ladders.simulated(ladders.candidates(a, g), g), g


def _market(spark: SparkSession, sf: str, g: DataFrame) -> DataFrame:
    return g.select("date", "bar_no").distinct().join(B.market_bars(spark, sf).select("date", "close"), "date", "left").select("bar_no", "close")


@query("b21_rotation_trades", f"{_NBR}, {_ON}, {_SIM} SELECT symbol, entry_bar, exit_bar, exit_reason, {_r('return_pct')} AS return_pct FROM tr")
def rotation_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of a symbol that do not overlap, ended by calls."""
    return rounded(_simulated(spark, sf)[0].select("symbol", "entry_bar", "exit_bar", "exit_reason", "return_pct"))


@query(
    "b22_contributions",
    f"""{_NBR}, {_ON}, {_SIM}, s AS (SELECT symbol, count(*) AS n_trades, sum(return_pct) AS t, avg(CASE WHEN return_pct > 0 THEN 100.0 ELSE 0 END) AS w FROM tr GROUP BY symbol)
    SELECT symbol, n_trades, {_r('t', 4)} AS total_return, {_r('w', 4)} AS win_rate, CAST(row_number() OVER (ORDER BY t DESC, symbol) AS INTEGER) AS place, {_r('100 * sum(t) OVER (ORDER BY t DESC, symbol ROWS UNBOUNDED PRECEDING) / sum(t) OVER ()', 4)} AS top_share FROM s""",
)
def contributions(spark: SparkSession, sf: str) -> DataFrame:
    c = ladders.contributions(_simulated(spark, sf)[0])
    return rounded(c.select("symbol", "n_trades", "total_return", "win_rate", "place", "top_share"), 4)


@query(
    "b23_matched_curve",
    f"""{_NBR}, {_MK}, {_ON}, {_SIM}, r AS (SELECT symbol, bar_no, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS r FROM gr), h AS (SELECT DISTINCT r.bar_no, r.symbol, r.r FROM tr JOIN r ON r.symbol = tr.symbol AND r.bar_no > entry_bar AND r.bar_no <= exit_bar),
    d AS (SELECT bar_no, coalesce(sum(r), 0) / count(*) AS ret, count(*) AS n FROM h GROUP BY bar_no), sp AS (SELECT min(bar_no) AS a, max(bar_no) AS b FROM d), c AS (SELECT cal.bar_no, cal.date, coalesce(d.ret, 0) AS ret, coalesce(d.n, 0) AS n, m.close AS mc FROM cal LEFT JOIN d ON d.bar_no = cal.bar_no LEFT JOIN mkt m ON m.date = cal.date, sp WHERE cal.bar_no BETWEEN a - 1 AND b),
    f AS (SELECT *, last_value(mc IGNORE NULLS) OVER (ORDER BY bar_no) AS k FROM c), x AS (SELECT *, coalesce(k / lag(k) OVER (ORDER BY bar_no) - 1, 0) AS br FROM f)
    SELECT bar_no, n AS n_held, {_r('ret', 5)} AS ret, {_r('br', 5)} AS bench_ret, {_r('sum(ln(1 + br)) OVER (ORDER BY bar_no)', 5)} AS log_bench, {_r('sum(CASE WHEN n > 0 THEN ln(1 + br) ELSE 0 END) OVER (ORDER BY bar_no)', 5)} AS log_matched FROM x""",
)
def matched_curve(spark: SparkSession, sf: str) -> DataFrame:
    t, g = _simulated(spark, sf)
    c = ladders.matched_curve(backtest.equity_curve(t, g, g.select("date", "bar_no").distinct()), _market(spark, sf, g))
    return rounded(c.select("bar_no", "n_held", "ret", "bench_ret", F.log("bench_equity").alias("log_bench"), F.log("matched_equity").alias("log_matched")), 5)


_STATES = "st AS (SELECT gr.symbol, gr.date, gr.bar_no, last_value(ca.call IGNORE NULLS) OVER w AS call, last_value(ca.conviction IGNORE NULLS) OVER w AS conviction FROM gr LEFT JOIN ca ON ca.symbol = gr.symbol AND ca.date = gr.date WINDOW w AS (PARTITION BY gr.symbol ORDER BY gr.bar_no ROWS UNBOUNDED PRECEDING))"


@query("b24_states", f"{_NB}, {_ON}, {_STATES} SELECT symbol, bar_no, call, {_r('conviction')} AS conviction FROM st WHERE call IS NOT NULL")
def states(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ladders.states(plain_calls(spark, sf), _grid(spark, sf)).select("symbol", "bar_no", "call", "conviction"))


_GATE = "gt AS (SELECT DISTINCT date, CASE WHEN month(date) % 3 = 0 THEN 'off' ELSE 'on' END AS rotation FROM bars)"


@query(
    "b25_portfolio",
    f"""{_NB}, {_MK}, {_ON}, {_STATES}, {_GATE}, al AS (SELECT st.* FROM st JOIN gt ON gt.date = st.date WHERE call IS NOT NULL AND rotation = 'on'),
    lg AS (SELECT symbol, bar_no + 1 AS bar_no, 1 AS side, 1.0::DOUBLE / count(*) OVER (PARTITION BY bar_no) AS w FROM (SELECT * FROM al WHERE call = 'ROTATE IN' QUALIFY row_number() OVER (PARTITION BY bar_no ORDER BY conviction DESC, symbol) <= 2)
      UNION ALL SELECT symbol, bar_no + 1, -1, 1.0::DOUBLE / count(*) OVER (PARTITION BY bar_no) FROM (SELECT * FROM al WHERE call = 'ROTATE OUT' QUALIFY row_number() OVER (PARTITION BY bar_no ORDER BY conviction, symbol) <= 3)),
    r AS (SELECT symbol, bar_no, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS r FROM gr), d AS (SELECT lg.bar_no, sum(CASE WHEN side = 1 THEN w * coalesce(r, 0) ELSE 0 END) AS l, sum(CASE WHEN side = -1 THEN w * coalesce(r, 0) ELSE 0 END) AS s, count(*) FILTER (side = 1) AS nl FROM lg JOIN r ON r.symbol = lg.symbol AND r.bar_no = lg.bar_no GROUP BY lg.bar_no),
    b0 AS (SELECT cal.bar_no, last_value(m.close IGNORE NULLS) OVER (ORDER BY cal.bar_no) AS k FROM cal LEFT JOIN mkt m ON m.date = cal.date), b1 AS (SELECT bar_no, k / lag(k) OVER (ORDER BY bar_no) - 1 AS br FROM b0)
    SELECT b1.bar_no AS bar_no, {_r('coalesce(l, 0)')} AS long_ret, {_r('coalesce(s, 0)')} AS short_ret, {_r('coalesce(l, 0) - coalesce(s, 0)')} AS spread_ret, {_r('coalesce(l, 0) - CASE WHEN nl > 0 THEN coalesce(br, 0) ELSE 0 END')} AS hedged_ret FROM b1 LEFT JOIN d ON d.bar_no = b1.bar_no""",
)
def portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """Gated legs and their hedge."""
    g = _grid(spark, sf)
    gate = g.select("date", F.when(F.month("date") % 3 == 0, "off").otherwise("on").alias("rotation")).distinct()
    p = ladders.rotation_portfolio(ladders.states(plain_calls(spark, sf), g), g, _market(spark, sf, g), {"mode": "long_hedged", "n_long": 2, "n_short": 3}, gate)
    return rounded(p.select("bar_no", "long_ret", "short_ret", "spread_ret", "hedged_ret"))


_LAD = """le AS (SELECT cd.*, least(entry_bar + 40, coalesce(n.nb - 1, last_bar), last_bar) AS end_bar FROM cd JOIN (SELECT symbol, bar_no, lead(bar_no) OVER (PARTITION BY symbol ORDER BY bar_no) AS nb FROM act WHERE call = 'ROTATE IN') n ON n.symbol = cd.symbol AND n.bar_no = cd.entry_bar),
  lt AS (SELECT * FROM le WHERE end_bar > entry_bar), le2 AS (SELECT lt.symbol, lt.entry_bar, lt.end_bar, act.bar_no, act.call, act.date FROM lt JOIN act ON act.symbol = lt.symbol AND act.bar_no > entry_bar AND act.bar_no <= end_bar),
  lo AS (SELECT lt.*, o.ob, coalesce(o.ob, end_bar) AS stop_bar FROM lt LEFT JOIN (SELECT symbol, entry_bar, min(bar_no) AS ob FROM le2 WHERE call IN ('ROTATE OUT', 'AVOID') GROUP BY ALL) o ON o.symbol = lt.symbol AND o.entry_bar = lt.entry_bar),
  c1 AS (SELECT symbol, entry_bar, bar_no, date, min(CASE call WHEN 'ROTATE OUT' THEN 0.4::DOUBLE WHEN 'AVOID' THEN 0.2 END) OVER w AS lf FROM le2 WHERE call IN ('ROTATE OUT', 'AVOID') WINDOW w AS (PARTITION BY symbol, entry_bar ORDER BY bar_no, date ROWS UNBOUNDED PRECEDING)),
  c2 AS (SELECT symbol, entry_bar, bar_no, coalesce(lag(lf) OVER (PARTITION BY symbol, entry_bar ORDER BY bar_no, date), 1) - lf AS frac FROM c1),
  p1 AS (SELECT symbol, entry_bar, end_bar, unnest([ob, ob + 1, ob + 2, ob + 3]) AS bar_no FROM lo WHERE ob IS NOT NULL),
  f1 AS (SELECT symbol, entry_bar, stop_bar, unnest([entry_px + m * (entry_px - leg_low) FOR m IN [0.618::DOUBLE, 1.0, 1.618, 2.0, 2.618]]) AS goal FROM lo WHERE entry_px - leg_low > 0),
  f2 AS (SELECT f1.symbol, f1.entry_bar, goal, min(gr.bar_no) AS bar_no FROM f1 JOIN gr ON gr.symbol = f1.symbol AND gr.bar_no > f1.entry_bar AND gr.bar_no <= stop_bar AND gr.high >= goal GROUP BY ALL),
  sl AS (SELECT 'calls' AS ladder, symbol, entry_bar, bar_no, frac, NULL::DOUBLE AS goal FROM c2 WHERE frac > 1e-9 UNION ALL SELECT 'post_out', symbol, entry_bar, bar_no, 0.2::DOUBLE, NULL FROM p1 WHERE bar_no < end_bar UNION ALL SELECT 'fib', symbol, entry_bar, bar_no, 0.2::DOUBLE, goal FROM f2),
  ld AS (SELECT unnest(['full', 'calls', 'post_out', 'fib']) AS ladder), tl AS (SELECT ld.ladder, lo.symbol, lo.entry_bar, CASE ld.ladder WHEN 'calls' THEN end_bar WHEN 'post_out' THEN CASE WHEN ob IS NULL THEN end_bar ELSE least(ob + 4, end_bar) END ELSE stop_bar END AS bar_no,
    1 - coalesce((SELECT sum(frac) FROM sl WHERE sl.ladder = ld.ladder AND sl.symbol = lo.symbol AND sl.entry_bar = lo.entry_bar), 0) AS frac FROM lo, ld),
  sa AS (SELECT * FROM sl UNION ALL SELECT ladder, symbol, entry_bar, bar_no, frac, NULL FROM tl WHERE frac > 1e-9),
  sp AS (SELECT sa.ladder, sa.symbol, sa.entry_bar, sa.bar_no, frac, coalesce(goal, CASE WHEN g.close > 0 THEN g.close ELSE g.open END) AS px, lt.entry_px FROM sa JOIN lt ON lt.symbol = sa.symbol AND lt.entry_bar = sa.entry_bar LEFT JOIN gr g ON g.symbol = sa.symbol AND g.bar_no = sa.bar_no),
  sc AS (SELECT ladder, symbol, entry_bar, 100 * sum(frac * (px / entry_px - 1)) AS return_pct, max(bar_no) AS exit_bar, list(struct_pack(b := bar_no, f := frac)) AS steps FROM sp GROUP BY ALL HAVING bool_and(coalesce(px > 0, false)))"""


@query("b26_ladders", f"{_NB}, {_ON}, {_LAD} SELECT ladder, symbol, entry_bar, exit_bar, {_r('return_pct', 5)} AS return_pct FROM sc")
def ladder_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The same entries sold by four ladders."""
    t = ladders.ladder_trades(*_acts(spark, sf))
    return rounded(t.select("ladder", "symbol", "entry_bar", "exit_bar", "return_pct"), 5)


_SCURVE = """wd AS (SELECT ladder, symbol, steps, unnest(range(entry_bar + 1, exit_bar + 1)) AS bar_no FROM sc), wh AS (SELECT ladder, symbol, bar_no, 1 - coalesce(list_sum([s.f FOR s IN steps IF s.b < bar_no]), 0) AS w FROM wd), rr AS (SELECT symbol, bar_no, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS r FROM gr),
  dy AS (SELECT ladder, wh.bar_no, coalesce(sum(w * r), 0) / sum(w) FILTER (r IS NOT NULL) AS ret, count(*) AS n FROM wh JOIN rr ON rr.symbol = wh.symbol AND rr.bar_no = wh.bar_no WHERE w > 1e-9 GROUP BY ALL), en AS (SELECT ladder, min(entry_bar) AS a, max(exit_bar) AS b FROM sc GROUP BY ladder),
  cu AS (SELECT en.ladder, cal.bar_no, cal.date, coalesce(dy.ret, 0) AS ret, coalesce(dy.n, 0) AS n FROM en JOIN cal ON cal.bar_no BETWEEN a AND b LEFT JOIN dy ON dy.ladder = en.ladder AND dy.bar_no = cal.bar_no),
  ce2 AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY ladder ORDER BY bar_no) AS le FROM cu), cf AS (SELECT *, exp(le - max(le) OVER (PARTITION BY ladder ORDER BY bar_no ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM ce2)"""


@query(
    "b28_ladder_table",
    f"""{_NB}, {_ON}, {_LAD}, {_SCURVE}, pf AS (SELECT ladder, arg_max(le, bar_no) AS l, 100 * min(dd) AS d, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252) AS s FROM cf GROUP BY ladder), ts AS (SELECT ladder, count(*) AS n_trades FROM sc GROUP BY ladder)
    SELECT pf.ladder AS ladder, n_trades, {_r('l', 4)} AS log_return, {_r('d', 4)} AS max_drawdown, {_r('s', 4)} AS sharpe, l = max(l) OVER () AS best_total_return, d = max(d) OVER () AS best_max_drawdown FROM pf JOIN ts ON ts.ladder = pf.ladder""",
)
def ladder_table(spark: SparkSession, sf: str) -> DataFrame:
    """Curves and marks of the four ladders."""
    table, _ = ladders.compared(*_acts(spark, sf))
    return rounded(table.select("ladder", "n_trades", F.log1p(F.col("total_return") / 100).alias("log_return"), "max_drawdown", "sharpe", "best_total_return", "best_max_drawdown"), 4)


_REC = f"""mc AS (SELECT cal.bar_no, m.close FROM cal LEFT JOIN mkt m ON m.date = cal.date), ff AS (SELECT symbol, bar_no, 100 * (lead(close, 10) OVER (PARTITION BY symbol ORDER BY bar_no) / close - 1) AS f FROM gr), fm AS (SELECT bar_no, 100 * (lead(close, 10) OVER (ORDER BY bar_no) / close - 1) AS f FROM mc),
  rc AS (SELECT act.symbol, act.call, act.conviction, act.bar_no AS entry_bar, ff.f AS fwd, ff.f - fm.f AS excess FROM act JOIN ff ON ff.symbol = act.symbol AND ff.bar_no = act.bar_no LEFT JOIN fm ON fm.bar_no = act.bar_no WHERE ff.f IS NOT NULL)"""


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a, g = _acts(spark, sf)
    moves = backtest.forward_returns(a.withColumnRenamed("bar_no", "entry_bar").select("symbol", "entry_bar", "call", "conviction"), g, _market(spark, sf, g))
    return moves.filter("horizon = 10"), g


@query(
    "b17_regime_split",
    f"""{_NB}, {_MK}, {_ON}, {_REC} SELECT call, entry_bar % 2 = 0 AS rotation_on, CAST(10 AS INTEGER) AS horizon, count(*) AS n, {_r('avg(excess)')} AS excess, {_r('100 * avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END)')} AS win_rate FROM rc WHERE call IN ('ROTATE IN', 'ROTATE OUT') GROUP BY ALL""",
)
def regime_split(spark: SparkSession, sf: str) -> DataFrame:
    """Studies of calls split by a state at the entry."""
    m = _records(spark, sf)[0].filter("call in ('ROTATE IN', 'ROTATE OUT')").withColumn("rotation_on", F.col("entry_bar") % 2 == 0)
    return rounded(backtest.forward_study(m, ["call", "rotation_on"]).select("call", "rotation_on", "horizon", "n", "excess", "win_rate"))


@query(
    "b18_confidence",
    f"""{_NB}, {_MK}, {_ON}, {_REC}, b AS (SELECT * FROM (VALUES (0, 0.0, 40.0), (1, 40.0, 55.0), (2, 55.0, 70.0), (3, 70.0, 85.0), (4, 85.0, 100.0)) v(bucket, low, high))
    SELECT b.bucket AS bucket, count(rc.symbol) AS n, {_r('avg(excess)')} AS excess FROM b LEFT JOIN rc ON conviction >= low AND (conviction < high OR (high = 100 AND conviction <= 100)) AND call = 'ROTATE IN' GROUP BY b.bucket""",
)
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.confidence_study(_records(spark, sf)[0].filter("call = 'ROTATE IN'")).select("bucket", "n", "excess"))


@query(
    "b19_separation",
    f"""{_NB}, {_MK}, {_ON}, {_REC}, x AS (SELECT * FROM rc WHERE entry_bar > 50 AND entry_bar <= 200) SELECT {_r("avg(excess) FILTER (call = 'ROTATE IN') - avg(excess) FILTER (call = 'ROTATE OUT')")} AS separation, count(excess) FILTER (call = 'ROTATE IN') AS n_in, count(excess) FILTER (call = 'ROTATE OUT') AS n_out FROM x""",
)
def separation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.separation(_records(spark, sf)[0], 50, 200))


_WF = """cb AS (SELECT unnest([0, 1, 2]) AS combo), wr AS (SELECT combo, call, entry_bar, excess FROM rc, cb WHERE call IN ('ROTATE IN', 'ROTATE OUT') AND excess IS NOT NULL AND abs(conviction) >= 10 + 10 * combo),
  fd AS (SELECT k AS fold, least(floor(last_bar * k / 5) + 1, last_bar) AS lo, least(floor(last_bar * (k + 1) / 5) + 1, last_bar) AS hi FROM (SELECT unnest([1, 2, 3, 4]) AS k), ml),
  sx AS (SELECT fold, combo, CASE WHEN count(*) FILTER (entry_bar <= lo AND call = 'ROTATE IN') >= 3 AND count(*) FILTER (entry_bar <= lo AND call = 'ROTATE OUT') >= 3 THEN avg(excess) FILTER (entry_bar <= lo AND call = 'ROTATE IN') - avg(excess) FILTER (entry_bar <= lo AND call = 'ROTATE OUT') END AS is_sep,
    CASE WHEN count(*) FILTER (entry_bar > lo AND entry_bar <= hi AND call = 'ROTATE IN') >= 3 AND count(*) FILTER (entry_bar > lo AND entry_bar <= hi AND call = 'ROTATE OUT') >= 3 THEN avg(excess) FILTER (entry_bar > lo AND entry_bar <= hi AND call = 'ROTATE IN') - avg(excess) FILTER (entry_bar > lo AND entry_bar <= hi AND call = 'ROTATE OUT') END AS oos_sep
    FROM wr, fd GROUP BY fold, combo)"""


def _walk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r, g = _records(spark, sf)
    combos = r.withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter(F.abs("conviction") >= 10 + 10 * F.col("combo"))
    n = g.agg(F.max("bar_no").alias("n_bars"))
    return ladders.walk_forward(combos.crossJoin(n), F.col("n_bars"))


@query("b30_folds", f"{_NB}, {_MK}, {_ON}, {_REC}, {_WF} SELECT CAST(fold AS INTEGER) AS fold, CAST(combo AS INTEGER) AS combo, {_r('is_sep')} AS is_sep, {_r('oos_sep')} AS oos_sep FROM sx WHERE is_sep IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold ORDER BY is_sep DESC, combo) = 1")
def folds(spark: SparkSession, sf: str) -> DataFrame:
    """The best parameters of each expanding fold, and how they did after it."""
    return rounded(_walk(spark, sf)[0])


@query("b30_recommended", f"{_NB}, {_MK}, {_ON}, {_REC}, {_WF}, m AS (SELECT combo, avg(oos_sep) AS o, count(oos_sep) AS n FROM sx WHERE fold IN (SELECT fold FROM sx WHERE is_sep IS NOT NULL) GROUP BY combo HAVING avg(oos_sep) IS NOT NULL) SELECT CAST(combo AS INTEGER) AS combo, {_r('o')} AS mean_oos, n AS n_folds, row_number() OVER (ORDER BY o DESC, combo) = 1 AS recommended FROM m")
def recommended(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_walk(spark, sf)[1])


@query(
    "b31_harness_calls",
    f"""{_NB}, {_CALLS}, rk AS (SELECT symbol, date, 100.0::DOUBLE * (rank() OVER (PARTITION BY date ORDER BY close)) / count(*) OVER (PARTITION BY date) AS rank FROM bars), sn AS (SELECT DISTINCT date, CASE WHEN month(date) % 2 = 0 THEN 'CONCENTRATE' ELSE 'ROTATE' END AS stance FROM bars),
    j AS (SELECT ca.symbol, ca.date, CASE WHEN call IN ('ROTATE IN', 'HOLD') THEN 1 WHEN call = 'ROTATE OUT' THEN -1 ELSE 0 END AS sg, conviction, rank, stance FROM ca LEFT JOIN rk ON rk.symbol = ca.symbol AND rk.date = ca.date LEFT JOIN sn ON sn.date = ca.date),
    s AS (SELECT symbol, date, round_even((sg * conviction * CASE WHEN stance = 'CONCENTRATE' THEN 0.5 ELSE 1 END + coalesce((rank - 50) * 0.6, 0)) * CASE WHEN sg <> 0 AND (sg > 0) = (rank >= 50) THEN 1.25 ELSE 1 END, 1) AS score FROM j)
    SELECT symbol, date, CASE WHEN score >= 40 THEN 'ROTATE IN' WHEN score <= -30 THEN 'ROTATE OUT' WHEN score > 0 THEN 'HOLD' ELSE 'WATCH' END AS call, round_even(least(99.0, abs(score)), 1) AS conviction FROM s""",
)
def harness_calls(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    ranks = b.select("symbol", "date", rankings.percent_rank("close").alias("rank"))
    stances = b.select("date", F.when(F.month("date") % 2 == 0, "CONCENTRATE").otherwise("ROTATE").alias("stance")).distinct()
    return rounded(ladders.harness_calls(plain_calls(spark, sf), ranks, stances), 1)


@query(
    "b33_referee",
    """WITH p AS (SELECT p_brand AS b, max(p_size) AS h, min(p_size) AS r, avg(p_size) AS m FROM part GROUP BY 1) SELECT b AS brand, h > r AS beats_rrg, h > m AS beats_market, h - 30 > r AS sharper, CASE WHEN h > m AND h > r THEN 'beats both' WHEN NOT h > m AND h - 30 > r THEN 'sharper, not better' WHEN h > m THEN 'beats the market only' ELSE 'no edge' END AS verdict FROM p WHERE b = 'Brand#2'""",
)
def referee(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").filter("p_brand = 'Brand#2'").agg(F.max("p_size").cast("double").alias("h"), F.min("p_size").cast("double").alias("r"), F.avg("p_size").alias("m"))
    none = F.lit(None).cast("double")
    row = lambda n, t, x: p.select(F.lit(n).alias("panel"), F.col(t).alias("total_return"), F.col("m").alias("matched_return"), x.alias("hedged_return"), none.alias("in_excess"))
    out = ladders.referee(row("harness", "h", F.col("h") - 30).unionByName(row("rrg", "r", F.col("r"))))
    return out.select(F.lit("Brand#2").alias("brand"), "beats_rrg", "beats_market", "sharper", "verdict")


@query("b33_panels")
def panels(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the plain panel and of the harness panel side by side (its parts are checked one by one)."""
    g = _grid(spark, sf)
    m, out = _market(spark, sf, g), None
    for name, calls in (("rrg", plain_calls(spark, sf)), ("harness", harness_calls(spark, sf))):
        r = ladders.backtest_report(calls, g, m)
        part = r["stats"].select(F.lit(name).alias("panel"), "n_trades", "win_rate", "avg_return")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query(
    "b13_strategy",
    f"""{_NB}, cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS bar_no FROM (SELECT DISTINCT date FROM bars)), g0 AS (SELECT s.symbol, cal.date, cal.bar_no, b.open, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = cal.date),
    g1 AS (SELECT *, coalesce(100 * (close / lag(close) OVER {over(order='bar_no')} - 1) > 10, false) AS m, 100 * (close / lag(close) OVER {over(order='bar_no')} - 1) AS chg_pct FROM g0), g2 AS (SELECT *, m AND NOT coalesce(lag(m) OVER {over(order='bar_no')}, false) AS onset, lead(open) OVER {over(order='bar_no')} AS entry_px FROM g1 WHERE date >= DATE '1997-01-01')
    SELECT symbol, date AS signal_date, bar_no + 1 AS entry_bar, {_r('entry_px')} AS entry_px, {_r('chg_pct')} AS chg_pct FROM g2 WHERE onset AND entry_px > 0""",
)
def strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Signals from a start date on, with indicators warmed up before it and the features of the signal bar."""
    g = B.grid(B.nation_bars(spark, sf))
    g = g.withColumn("chg_pct", 100 * (F.col("close") / F.lag("close").over(series.over_time(order="bar_no")) - 1)).withColumn("atr14", F.lit(None).cast("double"))
    found = backtest.strategy_signals(g, [{"field": "chg_pct", "op": ">", "value": 10}], "1997-01-01", ["chg_pct"])
    return rounded(found.select("symbol", "signal_date", "entry_bar", "entry_px", "features.chg_pct"))


@query("b34_target_book", "WITH s AS (SELECT p_partkey AS symbol, p_retailprice AS pick FROM part WHERE p_size % 3 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 6) SELECT symbol, round(0.75 * pick / sum(pick) OVER (), 6) AS weight FROM s")
def target_book(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("pick"), (F.col("p_size") % 3 == 0).alias("tradeable"), F.lit(None).cast("double").alias("stop"))
    return rounded(backtest.target_book(p, "ROTATE", "Lean bullish").select("symbol", "weight"))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf).filter("sector = 'ASIA' and date >= '1997-01-01' and date < '1997-07-01'")
    return b.select(F.lit("own").alias("book"), "date", "symbol", F.lit(0.2).alias("weight"), F.lit(None).cast("double").alias("stop"))


@query("b35_paper_steps")
def paper_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A book rebalanced each week; a sequence, held against a plain fold in the tests."""
    return rounded(books.run_books(_targets(spark, sf), B.nation_bars(spark, sf)), 4)


@query(
    "b37_book_state",
    f"""WITH s AS (SELECT c_mktsegment AS book, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS equity, min(o_totalprice) / 1000 AS cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), m AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS b FROM orders GROUP BY 1),
    d AS (SELECT s.*, b, equity / max(equity) OVER (PARTITION BY book ORDER BY s.date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM s LEFT JOIN m ON m.date = s.date)
    SELECT book, {_r('arg_max(equity, date) / 100000 - 1')} AS ret, {_r('min(dd)')} AS max_drawdown, {_r('sum(cost)', 4)} AS costs, {_r('arg_max(equity, date) / 100000 - arg_max(b, date) / arg_min(b, date)')} AS excess FROM d GROUP BY book""",
)
def book_state(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    s = o.join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("book"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("equity"), (F.min("o_totalprice") / 1000).alias("cost"))
    m = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    st = books.book_state(s, m)
    return rounded(st.select("book", F.col("return").alias("ret"), "max_drawdown", F.round("costs", 4).alias("costs"), "excess"))


@query(
    "b36_gap_marks",
    f"""{_NB}, a AS (SELECT 'own' AS book, 1000.0::DOUBLE AS cash, DATE '1998-05-04' AS last_date), p AS (SELECT DISTINCT 'own' AS book, symbol, CASE WHEN symbol < 'NATION_2' THEN 2.0::DOUBLE ELSE -1.0 END AS shares FROM bars), d AS (SELECT DISTINCT date FROM bars WHERE date > DATE '1998-05-04' AND date < DATE '1998-08-03')
    SELECT a.book AS book, d.date AS date, cash, {_r('cash + coalesce(sum(shares * close), 0)', 4)} AS equity, {_r('coalesce(sum(abs(shares * close)), 0)', 4)} AS gross, {_r('coalesce(sum(shares * close), 0)', 4)} AS net, count(*) FILTER (shares > 0) AS n_long FROM a JOIN d ON true LEFT JOIN p ON p.book = a.book LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = d.date GROUP BY a.book, d.date, cash""",
)
def gap_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Missed days of a book marked at their closes."""
    b = B.nation_bars(spark, sf)
    p = b.select("symbol").distinct().select(F.lit("own").alias("book"), "symbol", F.when(F.col("symbol") < "NATION_2", 2.0).otherwise(-1.0).alias("shares"))
    a = spark.range(1).select(F.lit("own").alias("book"), F.lit(1000.0).alias("cash"), F.lit("1998-05-04").cast("date").alias("last_date"))
    return rounded(ladders.gap_marks(p, a, b, "1998-08-03"), 4)


@query("b39_step_due", "SELECT event_id, event_id % 2 = 0 AND isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) >= 965 AND NOT (event_id % 3 = 0) AS due FROM events")
def step_due(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_id", F.col("ts").alias("now"), F.when(F.col("event_id") % 2 == 0, "autonomous").alias("mode"), F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).alias("last_step"))
    return e.select("event_id", ladders.step_due(e).alias("due"))


@query("b14_configs", "SELECT * FROM (VALUES (0, 'signal', 10, 40), (1, 'hold', 1, 40), (2, 'signal', 10, 7), (3, 'atr', 10, 40)) v(case_no, model, hold_days, max_hold)")
def configs(spark: SparkSession, sf: str) -> DataFrame:
    raws = [None, {"model": "hold", "hold_days": 0}, {"model": "nonsense", "max_hold": "7", "other": 1}, {"model": "atr", "atr_stop": 1}]
    rows = [(k, c["model"], c["hold_days"], c["max_hold"]) for k, c in enumerate(map(ladders.exit_config, raws))]
    return spark.createDataFrame(rows, "case_no int, model string, hold_days int, max_hold int")
