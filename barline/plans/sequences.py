"""DuckDB texts of results that depend on their own past: recursion over the next admissible row."""

from __future__ import annotations

from .models import _COMP, _GRID, _HOLD, _MK, _POOL, _RRG
from .profiles import _NBR
from .registry import oracle
from .screener import _FLAG
from .sql import over
from .windows import _AGG, _DER, _NB, _r

_FWD = ", ".join(f"100 * (lead(close, {h}) OVER {over()} / close - 1) AS fwd{h}" for h in (5, 10, 20))
_EVENTS = f"""{_FLAG}, fi AS (SELECT symbol, date, flag AS kind, row_number() OVER {over()} AS i, {_FWD} FROM fl), ev AS (SELECT * FROM fi WHERE kind IN ('bull', 'bear')),
  nx AS (SELECT a.symbol, a.i, min(b.i) AS n FROM ev a LEFT JOIN ev b ON b.symbol = a.symbol AND b.i >= a.i + 5 GROUP BY ALL),
  ke(symbol, i) AS (SELECT symbol, min(i) FROM ev GROUP BY symbol UNION ALL SELECT nx.symbol, nx.n FROM ke JOIN nx ON nx.symbol = ke.symbol AND nx.i = ke.i WHERE nx.n IS NOT NULL),
  fe AS (SELECT ev.* FROM ev JOIN ke ON ke.symbol = ev.symbol AND ke.i = ev.i)"""

oracle("c8_flag_events", f"{_NBR}, {_EVENTS} SELECT symbol, date, kind, {_r('fwd5')} AS fwd5, {_r('fwd10')} AS fwd10, {_r('fwd20')} AS fwd20 FROM fe")
oracle(
    "c9_flag_summary",
    f"""{_NBR}, {_EVENTS}, lo AS (SELECT kind, unnest([5, 10, 20]) AS horizon, unnest([fwd5, fwd10, fwd20]) AS move FROM fe)
    SELECT kind, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round_even(100 * avg(CASE WHEN (kind = 'bull' AND move > 0) OR (kind = 'bear' AND move < 0) THEN 1.0 ELSE 0 END), 1) AS success_rate,
    round_even(avg(move), 2) AS avg_move, round_even(median(move), 2) AS median_move FROM lo WHERE move IS NOT NULL GROUP BY kind, horizon""",
)
oracle(
    "c10_win_rates",
    f"""{_NBR}, {_AGG}, {_DER}, {_EVENTS}, lb AS (SELECT date, CASE WHEN score >= 3 THEN 'HEALTHY' WHEN score <= -2 THEN 'DETERIORATING' ELSE 'NEUTRAL' END AS regime FROM reg),
    wn AS (SELECT symbol, kind, CASE WHEN kind = 'bull' THEN fwd10 > 0 ELSE fwd10 < 0 END AS won FROM fe LEFT JOIN lb ON lb.date = fe.date WHERE fwd10 IS NOT NULL AND (regime IS NULL OR CASE WHEN kind = 'bear' THEN regime = 'DETERIORATING' ELSE regime <> 'DETERIORATING' END))
    SELECT symbol, {', '.join(f"{_r(f'''avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) FILTER (kind = '{k}')''')} AS {k}, count(*) FILTER (kind = '{k}') AS {k}_n" for k in ('bull', 'bear'))} FROM wn GROUP BY symbol""",
)
oracle(
    "d8_divergences",
    f"""{_NBR}, {_MK}, {_AGG}, {_DER}, d0 AS (SELECT der.date, m.close AS x, ad_line::DOUBLE AS ad_line, mcclellan, pct_above_50, row_number() OVER (ORDER BY der.date) AS i FROM der JOIN mkt m ON m.date = der.date),
    d1 AS (SELECT *, count(x) OVER w >= 63 AND max(x) OVER w <= x AS hi, count(x) OVER w >= 63 AND min(x) OVER w >= x AS lo FROM d0 WINDOW w AS (ORDER BY i ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
    d2 AS (SELECT i, date, x, ad_line, mcclellan, pct_above_50, 'bearish' AS kind, 1 AS sg FROM d1 WHERE hi UNION ALL SELECT i, date, x, ad_line, mcclellan, pct_above_50, 'bullish', -1 FROM d1 WHERE lo),
    d3 AS (SELECT a.kind, a.i, max(b.i) AS p FROM d2 a JOIN d2 b ON b.kind = a.kind AND b.i <= a.i - 10 GROUP BY ALL),
    d4 AS (SELECT a.kind, a.i, a.date, a.sg, a.x, b.x AS bx, unnest(['ad_line', 'mcclellan', 'pct_above_50']) AS measure, unnest([a.ad_line, a.mcclellan, a.pct_above_50]) AS m, unnest([b.ad_line, b.mcclellan, b.pct_above_50]) AS bm
      FROM d2 a JOIN d3 ON d3.kind = a.kind AND d3.i = a.i JOIN d2 b ON b.kind = a.kind AND b.i = d3.p),
    d5 AS (SELECT * FROM d4 WHERE sg * (x - bx) > 0 AND sg * (m - bm) < 0),
    d6 AS (SELECT a.kind, a.measure, a.i, min(b.i) AS n FROM d5 a LEFT JOIN d5 b ON b.kind = a.kind AND b.measure = a.measure AND b.i >= a.i + 10 GROUP BY ALL),
    d7(kind, measure, i) AS (SELECT kind, measure, min(i) FROM d5 GROUP BY kind, measure UNION ALL SELECT d6.kind, d6.measure, d6.n FROM d7 JOIN d6 ON d6.kind = d7.kind AND d6.measure = d7.measure AND d6.i = d7.i WHERE d6.n IS NOT NULL)
    SELECT d5.date AS date, d5.kind AS kind, d5.measure AS measure FROM d5 JOIN d7 ON d7.kind = d5.kind AND d7.measure = d5.measure AND d7.i = d5.i""",
)
oracle(
    "r5_movers",
    f"""{_NB}, {_MK}, {_COMP}, {_POOL}, k AS (SELECT symbol, rank, rank - lag(rank, 5) OVER {over()} AS delta, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM pool),
    s AS (SELECT symbol, rank, delta, CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS side FROM k WHERE k = 1 AND delta <> 0), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY side ORDER BY abs(delta) DESC, rank DESC, symbol) AS INTEGER) AS place FROM s)
    SELECT side, place, symbol, rank, delta FROM n WHERE place <= 5""",
)
oracle(
    "g6_headings",
    f"""{_NB}, {_MK}, {_COMP}, {_RRG}, p AS (SELECT symbol, date, round_even(x, 3) AS x, round_even(y, 3) AS y FROM xy), d AS (SELECT *, x - lag(x) OVER {over()} AS dx, y - lag(y) OVER {over()} AS dy FROM p),
    s AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, degrees(atan2(dy, dx)) AS deg FROM d),
    t AS (SELECT *, least(1, sum(step) OVER {over(5)} / 3) AS strength, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS age FROM s)
    SELECT symbol, date, x, y, CASE WHEN x >= 100 AND y >= 100 THEN 'LEADING' WHEN x >= 100 THEN 'WEAKENING' WHEN y >= 100 THEN 'IMPROVING' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'LAGGING' END AS quadrant,
    CASE WHEN step < 0.3 THEN 'FLAT' WHEN step IS NOT NULL THEN ['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'][CAST((CAST(floor((deg + 22.5) / 45) AS INTEGER) + 8) % 8 + 1 AS INTEGER)] END AS heading, {_r('strength')} AS strength, CAST(age AS INTEGER) AS age FROM t WHERE age < 6""",
)

#: Wilder's average on the grid, whose rows may be missing: each value with the number of rows since the last one.
_ATR = """q0 AS (SELECT *, lag(close) OVER w AS pc FROM g2 WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
  q1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM q0),
  q2 AS (SELECT *, CASE WHEN tr IS NOT NULL THEN bar_no - lag(CASE WHEN tr IS NOT NULL THEN bar_no END IGNORE NULLS) OVER w END AS gap FROM q1 WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
  q3 AS (SELECT *, list(struct_pack(v := tr, g := coalesce(gap, 1)::DOUBLE)) FILTER (tr IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS l FROM q2),
  q4 AS (SELECT symbol, date, bar_no, CASE WHEN len(l) >= 14 THEN (list_reduce(l, lambda a, b: struct_pack(v := (pow(13 / 14.0::DOUBLE, b.g) * a.v + b.v / 14) / (pow(13 / 14.0::DOUBLE, b.g) + 1 / 14.0::DOUBLE), g := 1.0::DOUBLE))).v END AS atr0 FROM q3)"""
oracle(
    "b4_atr_trades",
    f"""{_NB}, {_GRID}, {_ATR}, ml AS (SELECT max(bar_no) AS last FROM cal), et AS (SELECT e.*, q4.atr0, least(e.entry_bar + 40, ml.last) AS endb FROM e JOIN q4 ON q4.symbol = e.symbol AND q4.date = e.signal_date JOIN ml ON true WHERE q4.atr0 > 0),
    c AS (SELECT et.*, b.bar_no, b.date, b.open, b.high, b.low, b.close, coalesce(b.low <= entry_px - 2 * atr0, false) AS st, coalesce(b.high >= entry_px + 3 * atr0, false) AS wn FROM et JOIN g2 b ON b.symbol = et.symbol AND b.bar_no BETWEEN entry_bar AND endb),
    h AS (SELECT * FROM c WHERE st OR wn OR bar_no = endb QUALIFY row_number() OVER (PARTITION BY symbol, signal_date ORDER BY bar_no) = 1),
    x AS (SELECT *, CASE WHEN st THEN least(open, entry_px - 2 * atr0) WHEN wn THEN greatest(open, entry_px + 3 * atr0) ELSE close END AS exit_px, CASE WHEN st THEN 'stop' WHEN wn THEN 'target' ELSE 'cap' END AS exit_reason FROM h),
    p AS (SELECT x.symbol, x.signal_date, max(b.high) AS hh, min(b.low) AS ll FROM x JOIN g2 b ON b.symbol = x.symbol AND b.bar_no BETWEEN x.entry_bar AND x.bar_no GROUP BY ALL)
    SELECT x.symbol AS symbol, x.signal_date AS signal_date, entry_bar, {_r('entry_px')} AS entry_px, bar_no AS exit_bar, date AS exit_date, {_r('exit_px')} AS exit_px, exit_reason, {_r('100 * (exit_px / entry_px - 1)')} AS return_pct, bar_no - entry_bar + 1 AS bars_held,
    {_r('100 * (hh / entry_px - 1)')} AS mfe_pct, {_r('100 * (ll / entry_px - 1)')} AS mae_pct FROM x JOIN p ON p.symbol = x.symbol AND p.signal_date = x.signal_date WHERE exit_px > 0""",
)
CURVE = f"""r AS (SELECT symbol, bar_no, close / lag(close) OVER {over(order='bar_no')} - 1 AS r FROM g2),
    h AS (SELECT DISTINCT r.bar_no, r.symbol, r.r FROM th JOIN r ON r.symbol = th.symbol AND r.bar_no > entry_bar AND r.bar_no <= exit_bar), d AS (SELECT bar_no, coalesce(sum(r), 0) / count(*) AS ret, count(*) AS n FROM h GROUP BY bar_no),
    c AS (SELECT cal.date, cal.bar_no, coalesce(d.ret, 0) AS ret, coalesce(d.n, 0) AS n FROM cal LEFT JOIN d ON d.bar_no = cal.bar_no), q AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY bar_no)) AS eq FROM c),
    qd AS (SELECT *, eq / max(eq) OVER (ORDER BY bar_no ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q)"""
oracle(
    "b10_performance",
    f"""{_NB}, {_GRID}, {_HOLD}, {CURVE} SELECT {_r('ln(arg_max(eq, bar_no))', 4)} AS log_return, {_r('ln(arg_max(eq, bar_no)) * 252.0 / count(*)', 4)} AS log_cagr, {_r('100 * min(dd)', 4)} AS max_drawdown,
    {_r('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)', 4)} AS sharpe, {_r('avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END)', 4)} AS in_market FROM qd""",
)
oracle(
    "b11_histogram",
    f"""{_NB}, {_GRID}, {_HOLD}, cp AS (SELECT greatest(-50, least(50, return_pct)) AS r FROM th), ed AS (SELECT min(r) AS lo, max(r) AS hi FROM cp)
    SELECT CAST(coalesce(least(19, floor((r - lo) / nullif((hi - lo) / 20, 0))), 0) AS INTEGER) AS bin, count(*) AS n FROM cp, ed GROUP BY 1""",
)
