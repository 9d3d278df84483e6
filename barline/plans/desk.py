"""Queries of feeds, joins, live rows, alert passes and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import desk, feeds, patterns, rankings, rotation, scores, screen, series
from ..sources import bars as B
from ..streaming import polls as P
from .models import _COMP, _MK, _POOL
from .registry import query, rounded
from .screener import _SNAP, _snapshot
from .sql import bars, over
from .windows import _NB, _r

# Flow signals from the events table

_FLOW = """fs AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, ts, CAST(user_id AS VARCHAR) AS option_symbol, event_type AS underlying, CASE event_id % 4 WHEN 0 THEN 'conviction' WHEN 1 THEN 'notable' WHEN 2 THEN 'watch' ELSE 'noise' END AS classification,
  CASE event_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'unclear' END AS direction, CASE event_id % 5 WHEN 0 THEN 'swing' WHEN 1 THEN 'weekly' ELSE 'leaps' END AS bucket, value AS conviction, event_id * 10.0::DOUBLE AS notional,
  CAST(event_id % 77 AS BIGINT) AS session_volume, CASE WHEN event_id % 13 > 0 THEN event_id % 13 END AS open_interest FROM events)"""


def _pick(x: Column, values: list[str], otherwise: str) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in enumerate(values):
        out = out.when(x == k, v)
    return out.otherwise(otherwise)


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    e, k = B.table(spark, sf, "events"), F.col("event_id")
    return e.select(
        k.alias("id"), F.to_date("ts").alias("day"), "ts", F.col("user_id").cast("string").alias("option_symbol"), F.col("event_type").alias("underlying"),
        _pick(k % 4, ["conviction", "notable", "watch"], "noise").alias("classification"), _pick(k % 3, ["bullish", "bearish"], "unclear").alias("direction"),
        _pick(k % 5, ["swing", "weekly"], "leaps").alias("bucket"), F.col("value").alias("conviction"), (k * 10.0).alias("notional"),
        (k % 77).alias("session_volume"), F.when(k % 13 > 0, k % 13).alias("open_interest"),
    )


@query("f7_flow_feed", f"WITH {_FLOW} SELECT id, underlying, conviction, notional FROM fs WHERE conviction >= 5 AND classification = 'conviction' AND direction = 'bullish' ORDER BY conviction DESC, notional DESC LIMIT 200")
def flow_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.flow_feed(_flow(spark, sf), 5, direction="bullish").select("id", "underlying", "conviction", "notional")


@query("f8_ticker_feed", f"WITH {_FLOW} SELECT id, underlying, classification, conviction FROM fs WHERE conviction >= 0 AND upper(underlying) IN ('CLICK', 'ERROR') AND bucket = 'weekly' ORDER BY conviction DESC, notional DESC LIMIT 50")
def ticker_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.flow_feed(_flow(spark, sf), bucket="weekly", tickers=["click", "error"], limit=50).select("id", "underlying", "classification", "conviction")


@query("a13_class_counts", f"WITH {_FLOW} SELECT day, classification, count(*) AS n FROM fs GROUP BY ALL")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.class_counts(_flow(spark, sf))


@query(
    "h1_flow_totals",
    f"WITH {_FLOW} SELECT count(*) AS n, sum(notional) AS premium, sum(notional) FILTER (direction = 'bullish') AS bullish, sum(notional) FILTER (direction = 'bearish') AS bearish, CAST(sum(session_volume) AS BIGINT) AS size, CAST(sum(open_interest) AS BIGINT) AS open_interest FROM fs",
)
def flow_totals(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.flow_totals(_flow(spark, sf))


@query(
    "h2_feed_order",
    f"WITH {_FLOW}, o AS (SELECT id, session_volume / open_interest::DOUBLE AS vol_oi FROM fs), k AS (SELECT id, vol_oi FROM o ORDER BY coalesce(vol_oi, 'inf'::DOUBLE) DESC, id LIMIT 300) SELECT id, {_r('vol_oi')} AS vol_oi FROM k",
)
def feed_order(spark: SparkSession, sf: str) -> DataFrame:
    f = _flow(spark, sf).withColumn("vol_oi", F.col("session_volume") / F.col("open_interest"))
    return rounded(feeds.feed_order(f, "vol_oi", True, "id").limit(300).select("id", "vol_oi"))


@query("h3_known_keys", "SELECT p_partkey, CAST(CASE WHEN p_size % 2 > 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END + 1 AS INTEGER) AS n FROM part")
def known_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 > 0, 1).alias("a"), F.when(F.col("p_size") % 3 > 0, 1).alias("b"), "p_brand")
    return p.select("p_partkey", feeds.present("a", "b", "p_brand").alias("n"))


_ALERTS = "al AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, event_type AS rule_key, event_id % 4 = 0 AS acked FROM events)"


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date"), F.col("event_type").alias("rule_key"), (F.col("event_id") % 4 == 0).alias("acked"))


@query("a14_alerts_summary", f"WITH {_ALERTS} SELECT symbol, count(*) AS n, count(*) FILTER (NOT acked) AS unacked, array_to_string(list_sort(list(DISTINCT rule_key)), ',') AS rules FROM al WHERE date = DATE '2024-01-10' GROUP BY symbol")
def alerts_summary(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.alerts_summary(_alerts(spark, sf), "2024-01-10").withColumn("rules", F.concat_ws(",", "rules"))


@query(
    "t7_alert_log",
    f"WITH {_ALERTS} SELECT id, date, acked OR id % 3 = 0 AS acked, id % 7 = 0 AS delivered FROM al WHERE date >= DATE '2024-01-20' - 60 AND date > DATE '2024-01-20' - 5",
)
def alert_log(spark: SparkSession, sf: str) -> DataFrame:
    """T-7: acknowledged, pruned, then the last five days with what was delivered."""
    a = _alerts(spark, sf)
    a = feeds.pruned(feeds.acknowledged(a, a.filter("id % 3 = 0").select("id")), "2024-01-20")
    return desk.alert_log(a, "2024-01-20", 5, a.filter("id % 7 = 0")).select("id", "date", "acked", "delivered")


@query(
    "t8_screen_memory",
    """WITH n AS (SELECT DISTINCT c_nationkey AS screen_id, c_name AS symbol FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_nationkey AS screen_id, c_name AS symbol, CAST(DATE '2024-01-01' + CAST(c_custkey % 5 AS INTEGER) AS DATE) AS first_matched FROM customer WHERE c_custkey % 3 = 0)
    SELECT n.screen_id AS screen_id, n.symbol AS symbol, coalesce(first_matched, DATE '2024-02-01') AS first_matched FROM n LEFT JOIN b ON b.screen_id = n.screen_id AND b.symbol = n.symbol""",
)
def screen_memory(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("screen_id"), F.col("c_name").alias("symbol"), "c_custkey")
    before = c.filter("c_custkey % 3 = 0").withColumn("first_matched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 5).cast("int")))
    return feeds.screen_memory(before, c.filter("c_custkey % 2 = 0"), "2024-02-01")


@query(
    "a17_sentiment",
    """WITH v AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' ELSE 'negative' END AS label, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL),
    w AS (SELECT *, max(CASE WHEN label <> 'neutral' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS d FROM v)
    SELECT conv_id AS article_id, label AS sentiment FROM w WHERE d = 0 OR label <> 'neutral' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1""",
)
def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "conversations")
    return feeds.sentiment(c.select(F.col("conv_id").alias("article_id"), F.col("turn").alias("pos"), _pick(F.col("turn") % 3, ["neutral", "positive"], "negative").alias("label")))


@query("f9_weekdays", f"WITH {bars('market', 'day', 'mkt')} SELECT date, {_r('close')} AS close FROM mkt WHERE isodow(date) < 6")
def weekdays(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(desk.weekdays(B.market_bars(spark, sf, "day")).select("date", "close"))


@query("f10_split", "SELECT o_orderkey, date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE))::INTEGER AS days_until, CAST(o_orderdate AS DATE) >= DATE '1997-06-01' AS upcoming FROM orders")
def split_calendar(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("event_date"))
    return feeds.split_calendar(o, "1997-06-01").select("o_orderkey", "days_until", "upcoming")


@query("f11_focus", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 IN (3, 7) OR o_orderkey % 10 IN (3, 7)")
def focused(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda c: F.concat(F.lit("T"), (F.col(c) % 10).cast("string"))
    o = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("published"), F.array(tag("o_custkey"), tag("o_orderkey")).alias("tickers"))
    return feeds.focused(o, ["T3", "T7"]).select("o_orderkey")


@query("f12_sides", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'offensive' WHEN 1 THEN 'defensive' WHEN 2 THEN 'other' ELSE 'offensive' END AS side FROM part")
def sides(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "part").select("p_partkey", desk.side(_pick(F.col("p_partkey") % 4, ["XLK", "XLU", "XLE"], "XLC")).alias("side"))


_VALID = [
    ([{"field": "close", "op": ">", "value": 1}], 0),
    ([{"field": "close", "op": "in", "value": [1]}], 1),
    ([{"field": "nothing", "op": ">", "value": 1}, {"field": "flag", "op": "in", "value": []}], 2),
    ([{"field": "rvol_10d", "op": "between", "value": [1, 2]}], 0),
    ([{"field": "rvol_10d", "op": "between", "value": [1]}], 1),
    ([{"field": "chg_pct", "op": ">=", "value": "x"}], 1),
    (["close > 1"], 1),
    ({"field": "close"}, 1),
    ([], 0),
]


@query("f2_validation", f"SELECT * FROM (VALUES {', '.join(f'({k}, {n})' for k, (_, n) in enumerate(_VALID))}) v(case_no, n_problems)")
def validation(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, len(screen.validate(c))) for k, (c, _) in enumerate(_VALID)], "case_no int, n_problems int")


@query("f3_fields", f"SELECT * FROM (VALUES {', '.join(f'''('{n}', 'num')''' for n in screen.NUMBERS)}, {', '.join(f'''('{n}', 'str')''' for n in screen.TEXTS)}) v(field, kind)")
def fields(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(screen.FIELDS.items()), "field string, kind string")


# Snapshot joined with fundamentals, calls and live values

_FRAME = f"""{_SNAP}, fd AS (SELECT n_name AS symbol, r_name AS sector_etf, sum(s_acctbal) AS market_cap FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE n_name <> 'NATION_9' GROUP BY ALL),
  cl AS (SELECT * FROM (VALUES ('ASIA', 'HOLD'), ('EUROPE', 'ROTATE IN'), ('AMERICA', 'AVOID')) v(sector_etf, call)),
  lv AS (SELECT DISTINCT symbol, 1234.5::DOUBLE AS close, CASE WHEN symbol < 'NATION_15' THEN 7.5::DOUBLE END AS chg_pct FROM bars WHERE symbol < 'NATION_20'),
  fr AS (SELECT snap.symbol, fd.sector_etf, fd.market_cap, cl.call AS rrg_call, coalesce(lv.close, snap.close) AS close, coalesce(lv.chg_pct, snap.chg_pct) AS chg_pct, 100 * (coalesce(lv.close, snap.close) / sma20 - 1) AS price_vs_sma20_pct, rvol_10d
    FROM snap LEFT JOIN fd ON fd.symbol = snap.symbol LEFT JOIN cl ON cl.sector_etf = fd.sector_etf LEFT JOIN lv ON lv.symbol = snap.symbol)"""


def _fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(B.table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.filter("n_name <> 'NATION_9'").groupBy(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector_etf")).agg(F.sum("s_acctbal").alias("market_cap"))


def _calls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ASIA", "HOLD"), ("EUROPE", "ROTATE IN"), ("AMERICA", "AVOID")], "sector_etf string, call string")


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    snap = _snapshot(spark, sf)
    live = snap.filter("symbol < 'NATION_20'").select("symbol", F.lit(1234.5).alias("close"), F.when(F.col("symbol") < "NATION_15", 7.5).alias("chg_pct"), *[F.lit(None).cast("double").alias(c) for c in ("gap_pct", "volume", "rvol_10d")])
    return screen.frame(snap, _fundamentals(spark, sf), _calls(spark), "2001-11-05", live)


@query("j1_frame", f"{_NB}, {_FRAME} SELECT symbol, sector_etf, {_r('market_cap', 2)} AS market_cap, rrg_call, {_r('close')} AS close, {_r('chg_pct')} AS chg_pct, {_r('price_vs_sma20_pct')} AS price_vs_sma20_pct FROM fr")
def frame(spark: SparkSession, sf: str) -> DataFrame:
    """Fundamentals, sector calls and live values beside the snapshot; derived columns after them."""
    f = _frame(spark, sf).select("symbol", "sector_etf", F.round("market_cap", 2).alias("market_cap"), "rrg_call", "close", "chg_pct", "price_vs_sma20_pct")
    return rounded(f)


@query("f5_members", f"{_NB}, {_FRAME}, m AS (SELECT n_name AS symbol FROM nation WHERE n_nationkey % 2 = 0) SELECT symbol, {_r('chg_pct', 4)} AS chg_pct, rrg_call FROM fr WHERE symbol IN (SELECT symbol FROM m) AND close > 0 ORDER BY chg_pct ASC NULLS LAST, symbol LIMIT 5")
def member_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan within a universe, shown as rounded columns; an unknown sort column falls back."""
    m = B.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("symbol"))
    found = screen.scan(_frame(spark, sf), [{"field": "close", "op": ">", "value": 0}], "no_such", False, 5, m)
    return desk.projected(found, ["symbol", "chg_pct", "rrg_call", "absent"])


@query("j22_comps", f"{_NB}, {_FRAME} SELECT symbol, {_r('close', 4)} AS close, rrg_call FROM fr WHERE symbol IN ('NATION_7', 'NATION_9', 'NATION_11')")
def comps(spark: SparkSession, sf: str) -> DataFrame:
    peers = spark.createDataFrame([("NATION_7",), ("NATION_9",), ("NATION_11",), ("NATION_7",), ("NATION_99",)], "symbol string")
    return rounded(desk.comps(_frame(spark, sf), peers, ["close", "rrg_call"]), 4)


@query(
    "j6_channels",
    """WITH w AS (SELECT n_name AS symbol, unnest(CASE WHEN n_regionkey % 2 = 0 THEN [lower(r_name), 'all'] ELSE [lower(r_name)] END) AS channel FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'small' FROM nation WHERE n_nationkey < 4)
    SELECT symbol, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM w GROUP BY symbol""",
)
def channels(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.lower("r_name")
    lists = n.groupBy("n_regionkey", "r_name").agg(F.collect_list("n_name").alias("symbols")).select("symbols", F.when(F.col("n_regionkey") % 2 == 0, F.array(name, F.lit("all"))).otherwise(F.array(name)).alias("channels"))
    small = n.filter("n_nationkey < 4").groupBy().agg(F.collect_list("n_name").alias("symbols")).withColumn("channels", F.array(F.lit("small")))
    return screen.channels(n.select(F.col("n_name").alias("symbol")), lists.unionByName(small)).withColumn("channels", F.concat_ws(",", "channels"))


@query("j8_exact", f"WITH {bars('nation', 'day')}, {bars('market', name='mkt')}, d AS (SELECT date, count(*) AS n FROM bars GROUP BY date) SELECT d.date AS date, n, {_r('m.close')} AS index_close FROM d LEFT JOIN mkt m ON m.date = d.date")
def exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(desk.matched(B.nation_bars(spark, sf, "day").groupBy("date").agg(F.count("*").alias("n")), B.market_bars(spark, sf)))


_QUARTERS = "l AS (SELECT date, 'Q' || quarter(date) AS label, lag('Q' || quarter(date)) OVER (ORDER BY date) AS before FROM mkt WHERE day(date) <= 7)"


@query(
    "j10_shifted",
    f"""WITH {bars('nation', 'day')}, {bars('market', name='mkt')}, {_QUARTERS} SELECT symbol, bars.date AS date, coalesce(l.before, 'none') AS label FROM bars ASOF LEFT JOIN l ON bars.date >= l.date""",
)
def shifted(spark: SparkSession, sf: str) -> DataFrame:
    labels = B.market_bars(spark, sf).filter(F.dayofmonth("date") <= 7).select("date", F.concat(F.lit("Q"), F.quarter("date")).alias("label"))
    return series.as_of(B.nation_bars(spark, sf, "day").select("symbol", "date"), labels, "label", lag_rows=1, fill="none")


@query(
    "j11_dialects",
    f"""WITH {bars('market', 'day', 'mkt')}, l AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date, 'M' || month(date) AS label FROM mkt) SELECT mkt.date AS date, l.label AS label FROM mkt ASOF LEFT JOIN l ON mkt.date >= l.date""",
)
def dialect_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels dated by text, aligned to dates and carried forward."""
    days = B.market_bars(spark, sf, "day").select("date")
    texts = days.select(F.date_format(F.trunc("date", "MM"), "yyyyMMdd").alias("d"), F.concat(F.lit("M"), F.month("date")).alias("label")).distinct()
    return series.as_of(days, texts.select(F.to_date("d", "yyyyMMdd").alias("date"), "label"), "label")


@query("j15_prior_interest", "SELECT CAST(user_id AS VARCHAR) AS option_symbol, arg_max(event_id, ts) AS open_interest FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY 1")
def prior_interest(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("option_symbol"), F.col("ts").alias("day"), F.col("event_id").alias("open_interest"))
    return feeds.prior_interest(e, "2024-01-15")


_POS = "ps AS (SELECT s_suppkey AS id, n_name AS symbol, s_acctbal AS market_value FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "supplier").join(B.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("symbol"), F.col("s_acctbal").alias("market_value"))


@query(
    "j17_position_actions",
    f"""WITH {_POS}, s AS (SELECT n_name AS symbol, r_name AS sector_etf FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT * FROM (VALUES ('ASIA', 'HOLD'), ('EUROPE', 'ROTATE IN'), ('AMERICA', 'AVOID')) v(sector_etf, call))
    SELECT id, ps.symbol AS symbol, c.call AS call, CASE c.call WHEN 'HOLD' THEN 'HOLD' WHEN 'ROTATE IN' THEN 'BUY' WHEN 'AVOID' THEN 'AVOID' ELSE 'WATCH' END AS action FROM ps LEFT JOIN s ON s.symbol = ps.symbol LEFT JOIN c ON c.sector_etf = s.sector_etf""",
)
def position_actions(spark: SparkSession, sf: str) -> DataFrame:
    sectors = B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector_etf"))
    return feeds.position_signals(_positions(spark, sf), sectors, _calls(spark)).select("id", "symbol", "call", "action")


@query("k39_actions", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'BUY' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'SELL' WHEN 3 THEN 'AVOID' WHEN 4 THEN 'WATCH' WHEN 5 THEN 'TRIM' ELSE 'WATCH' END AS action FROM part")
def actions(spark: SparkSession, sf: str) -> DataFrame:
    call = _pick(F.col("p_partkey") % 7, ["ROTATE IN", "HOLD", "ROTATE OUT", "AVOID", "WATCH", "⚠️ w5 extended"], "other")
    return B.table(spark, sf, "part").select("p_partkey", rotation.action(call).alias("action"))


@query("h4_portfolio", f"WITH {_POS} SELECT round(sum(market_value), 2) AS market_value, round(sum(market_value * 0.1), 2) AS open_gain, round(sum(market_value) FILTER (id % 9 = 0), 2) AS liquidation_value FROM ps")
def portfolio_totals(spark: SparkSession, sf: str) -> DataFrame:
    p = _positions(spark, sf).withColumn("open_gain", F.col("market_value") * 0.1)
    b = p.filter("id % 9 = 0").select(F.col("market_value").alias("liquidation_value")).unionByName(p.limit(3).select(F.lit(0.0).alias("liquidation_value")))
    return rounded(feeds.portfolio_totals(p, b), 2)


@query(
    "h5_csv",
    f"WITH {_POS} SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS line_no, chr(34) || id || chr(34) || ',' || chr(34) || symbol || ' ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) AS line FROM ps "
    "UNION ALL SELECT 0, chr(34) || 'id' || chr(34) || ',' || chr(34) || 'symbol' || chr(34)",
)
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = _positions(spark, sf).withColumn("symbol", F.concat("symbol", F.lit(' "x"')))
    return desk.csv_lines(p, ["id", "symbol"], ["id"])


@query(
    "h6_board_order",
    f"""{_NB}, {_MK}, {_COMP}, {_POOL}, k AS (SELECT symbol, rank, lag(rank, 5) OVER {over()} AS rank_1w, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM pool), l AS (SELECT symbol, CASE WHEN symbol < 'NATION_12' THEN NULL ELSE rank END AS rank, rank_1w FROM k WHERE k = 1)
    SELECT symbol, rank, rank - rank_1w AS rank_delta, CAST(row_number() OVER (ORDER BY rank ASC NULLS FIRST, symbol) AS INTEGER) AS place FROM l""",
)
def board_order(spark: SparkSession, sf: str) -> DataFrame:
    board = rankings.leaderboard(B.nation_bars(spark, sf), B.market_bars(spark, sf)).withColumn("rank", F.when(F.col("symbol") >= "NATION_12", F.col("rank")))
    return desk.board_order(board, "rank", False).select("symbol", "rank", "rank_delta", "place")


@query("h7_rotating_in", "SELECT count(*) FILTER (p_partkey % 7 = 0) AS n FROM part")
def rotating_in(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.rotating_in(B.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 7 == 0, "ROTATE IN").otherwise("HOLD").alias("call")))


@query("h8_axis", "SELECT 100 - 0.08 * (x - 100) AS x_from, x + 0.08 * (x - 100) AS x_to, 0.0::DOUBLE - 0.08 * (y - 0) AS y_from, y + 0.08 * y AS y_to FROM (SELECT max(p_size) + 100.0::DOUBLE AS x, greatest(100.0::DOUBLE, max(p_size)) AS y FROM part)")
def axis(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    points = p.select((F.col("p_size") + 100.0).alias("x"), F.col("p_size").cast("double").alias("y")).unionByName(p.limit(1).select(F.lit(101.0).alias("x"), F.lit(0.0).alias("y")))
    return rounded(desk.axis(points))


@query("h9_shares", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CAST(floor(1000 / (p_size % 3 * 1.5)) AS BIGINT) END AS shares FROM part")
def shares(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "part").select("p_partkey", feeds.shares(F.lit(1000.0), F.col("p_size") % 3 * 1.5).alias("shares"))


@query("t10_market_hours", "SELECT event_id, isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 AS open FROM events")
def market_hours(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", P.market_open(F.col("ts")).alias("open"))


@query("t11_universe", "SELECT DISTINCT symbol FROM (SELECT n_name AS symbol FROM nation UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 5)")
def universe(spark: SparkSession, sf: str) -> DataFrame:
    """T-11, D15, B43: the distinct symbols of several lists."""
    n = B.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), "n_nationkey")
    return feeds.merged_universe(n, B.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol")), n.filter("n_nationkey < 5"))


@query("t12_due", "SELECT CAST(user_id AS VARCHAR) AS source, coalesce(date_diff('second', date_trunc('second', max(ts) FILTER (event_id % 3 > 0)), TIMESTAMP '2024-01-30 00:00:00') >= 3600, true) AS due FROM events GROUP BY user_id")
def due(spark: SparkSession, sf: str) -> DataFrame:
    s = B.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("source")).agg(F.max(F.when(F.col("event_id") % 3 > 0, F.col("ts"))).alias("fetched_at"))
    return desk.due(s, "2024-01-30 00:00:00", 3600).select("source", "due")


@query(
    "j19_release_period",
    """WITH o AS (SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, max(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY m) AS p FROM o),
    e AS (SELECT o_orderkey, c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 20 = 0)
    SELECT o_orderkey, v AS actual, p AS previous FROM e LEFT JOIN l ON l.series_id = e.series_id AND l.m = e.m""",
)
def release_period(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("event_date"))
    obs = o.groupBy("series_id", F.to_date(F.trunc("event_date", "MM")).alias("date")).agg(F.max("o_totalprice").alias("value"))
    return feeds.release_period(o.filter("o_orderkey % 20 = 0").select("o_orderkey", "series_id", "event_date"), obs).select("o_orderkey", "actual", "previous")


@query(
    "j20_series_match",
    "SELECT doc_id, CASE WHEN contains(lower(text), 'ther') THEN 'A' WHEN contains(lower(text), 'the') THEN 'B' WHEN contains(lower(text), 'a') THEN 'C' END AS series_id FROM documents",
)
def series_match(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", feeds.match_series(F.col("text"), [("ther", "A"), ("the", "B"), ("a", "C")]).alias("series_id"))


@query(
    "j21_overlay",
    f"""WITH {bars('nation', 'day')}, c AS (SELECT symbol AS curve, date, close AS equity FROM bars), g AS (SELECT n.curve, d.date FROM (SELECT DISTINCT curve FROM c) n CROSS JOIN (SELECT DISTINCT date FROM c) d)
    SELECT g.curve AS curve, g.date AS date, {_r('coalesce(last_value(c.equity IGNORE NULLS) OVER (PARTITION BY g.curve ORDER BY g.date ROWS UNBOUNDED PRECEDING), 1.0)')} AS equity FROM g LEFT JOIN c ON c.curve = g.curve AND c.date = g.date""",
)
def overlay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(desk.overlay(B.nation_bars(spark, sf, "day").select(F.col("symbol").alias("curve"), "date", F.col("close").alias("equity"))))


@query(
    "j18_contexts",
    f"""{_NB}, {_SNAP}, u AS (SELECT DISTINCT upper(n_name) AS symbol FROM nation WHERE n_nationkey % 3 > 0)
    SELECT u.symbol AS symbol, CASE r_name WHEN 'ASIA' THEN 'HOLD' WHEN 'EUROPE' THEN 'ROTATE IN' WHEN 'AMERICA' THEN 'AVOID' END AS sector_call, CASE WHEN close > sma20 THEN 'premium' WHEN close <= sma20 THEN 'discount' END AS vp_zone, CASE WHEN rvol_10d > 0.3 THEN true END AS golden_pocket,
      CASE WHEN chg_pct > 0 THEN 'A' WHEN chg_pct <= 0 THEN 'D' END AS accumulation, 'HEALTHY' AS regime
    FROM u JOIN nation ON n_name = u.symbol JOIN region ON n_regionkey = r_regionkey LEFT JOIN snap ON snap.symbol = u.symbol""",
)
def contexts(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    snap = _snapshot(spark, sf)
    return desk.context(
        n.filter("n_nationkey % 3 > 0").select(F.lower("n_name").alias("symbol")),
        n.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector_etf")),
        _calls(spark),
        spark.createDataFrame([("HEALTHY",)], "regime string"),
        snap.select("symbol", F.when(F.col("close") > F.col("sma20"), "premium").when(F.col("close") <= F.col("sma20"), "discount").alias("zone")),
        snap.select("symbol", F.when(F.col("rvol_10d") > 0.3, 1.0).otherwise(0.0).alias("in_pocket")),
        snap.select("symbol", F.when(F.col("chg_pct") > 0, "A").when(F.col("chg_pct") <= 0, "D").alias("letter")),
    )


@query(
    "w23_relative_history",
    f"""{_NB}, {_MK}, j AS (SELECT bars.symbol, bars.close, m.close AS b, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.date DESC) - 1 AS k FROM bars JOIN mkt m ON m.date = bars.date)
    SELECT a.symbol AS symbol, CAST(a.k AS INTEGER) AS back, {_r('100 * (z.close / a.close - z.b / a.b)')} AS rel FROM j a JOIN j z ON z.symbol = a.symbol AND z.k = 0 WHERE a.k BETWEEN 1 AND 12""",
)
def relative_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(desk.relative_history(B.nation_bars(spark, sf), B.market_bars(spark, sf)))


_LIVE = """qt AS (SELECT symbol, close * 1.01 AS last, CASE WHEN symbol < 'NATION_5' THEN open END AS open, close AS prev, CASE WHEN symbol < 'NATION_16' THEN 2.5::DOUBLE END AS net, volume AS vol FROM bars WHERE date = (SELECT max(date) FROM bars)),
  lr AS (SELECT qt.symbol, last AS close, coalesce(net, 100 * (last / prev - 1)) AS chg_pct, 100 * (qt.open / prev - 1) AS gap_pct, vol AS volume, vol / (av * greatest(least(100 / 390.0::DOUBLE, 1), 0.02)) AS rvol_10d FROM qt LEFT JOIN snap ON snap.symbol = qt.symbol)"""


def _live(spark: SparkSession, sf: str) -> DataFrame:
    b = B.nation_bars(spark, sf)
    last = b.join(b.agg(F.max("date").alias("date")), "date")
    quotes = last.select("symbol", (F.col("close") * 1.01).alias("last"), F.when(F.col("symbol") < "NATION_5", F.col("open")).alias("open"), F.col("close").alias("prev_close"), F.when(F.col("symbol") < "NATION_16", 2.5).alias("net_pct_chg"), F.col("volume").alias("total_volume"))
    return desk.live_rows(quotes, _snapshot(spark, sf), F.lit(100))


@query("t9_live_rows", f"{_NB}, {_SNAP}, {_LIVE} SELECT symbol, {', '.join(_r(c) + f' AS {c}' for c in ('close', 'chg_pct', 'gap_pct', 'volume', 'rvol_10d'))} FROM lr")
def live_rows(spark: SparkSession, sf: str) -> DataFrame:
    """T-9, C26: live rows of the last quotes against the snapshot's volumes."""
    return rounded(_live(spark, sf))


@query(
    "k15_alert_pass",
    f"""{_NB}, {_SNAP}, h AS (SELECT symbol, unnest([CASE WHEN gap_pct >= 4 THEN {{'k': 'gap_up', 'n': 'pump'}} END, CASE WHEN gap_pct <= -4 THEN {{'k': 'gap_down', 'n': 'dump'}} END]) AS x FROM snap WHERE symbol >= 'NATION_12'),
    f AS (SELECT symbol, x.k AS rule_key, x.n AS kind FROM h WHERE x IS NOT NULL UNION ALL SELECT symbol, 'screen:up', 'info' FROM snap WHERE chg_pct > 0 AND symbol >= 'NATION_15')
    SELECT symbol, rule_key, kind, DATE '2001-11-05' AS date FROM f WHERE NOT (symbol < 'NATION_2' AND rule_key = 'gap_up')""",
)
def alert_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on the focus list and an armed screen, less what was matched or sent before."""
    rows = _snapshot(spark, sf).select("symbol", "close", "chg_pct", "gap_pct")
    screens = [{"id": 1, "name": "up", "conditions": [{"field": "chg_pct", "op": ">", "value": 0}]}]
    before = rows.filter("symbol < 'NATION_15'").select(F.lit(1).cast("long").alias("screen_id"), "symbol")
    sent = rows.filter("symbol < 'NATION_2'").select("symbol", F.lit("gap_up").alias("rule_key"))
    return desk.alert_pass(rows, rows.filter("symbol >= 'NATION_12'"), screens, before, sent, "2001-11-05")


@query(
    "s49_messages",
    f"""WITH {_ALERTS}, r AS (SELECT id, symbol, rule_key, unnest(CASE WHEN id % 2 = 0 THEN ['mail', 'hook'] ELSE ['hook'] END) AS channel FROM al WHERE id < 60)
    SELECT channel, count(*) AS n, string_agg(symbol || ' ' || rule_key, chr(10) ORDER BY symbol || ' ' || rule_key) AS text FROM (SELECT a.symbol, a.rule_key, c.channel FROM (SELECT * FROM al WHERE id < 60) a JOIN (SELECT DISTINCT symbol, channel FROM r) c ON c.symbol = a.symbol) GROUP BY channel""",
)
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """One message a channel for the alerts of routed symbols."""
    a = _alerts(spark, sf).filter("id < 60")
    routes = a.groupBy("symbol").agg(F.max(F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("m")).select("symbol", F.when(F.col("m") == 1, F.array(F.lit("mail"), F.lit("hook"))).otherwise(F.array(F.lit("hook"))).alias("channels"))
    return desk.messages(a, routes)


@query(
    "k23_series",
    f"""{_NB}, f AS (SELECT symbol, date, close FROM bars WHERE symbol = 'NATION_7'), r AS (SELECT a.date, a.close / b.close AS ratio FROM bars a JOIN bars b ON b.date = a.date WHERE a.symbol = 'NATION_7' AND b.symbol = 'NATION_11')
    SELECT f.date AS date, {_r('f.close')} AS close, {_r('r.ratio')} AS ratio FROM f LEFT JOIN r ON r.date = f.date""",
)
def price_series(spark: SparkSession, sf: str) -> DataFrame:
    """The first series that exists, and a ratio of two."""
    b = B.nation_bars(spark, sf)
    f = desk.first_series(b, ["NATION_99", "NATION_7", "NATION_11"]).select("date", "close")
    return rounded(f.join(desk.price_ratio(b, "NATION_7", "NATION_11"), "date", "left"))


@query(
    "t2_sweep_alerts",
    """WITH pl AS (SELECT user_id::VARCHAR AS option_symbol, event_type AS underlying, CAST(ts AS DATE) AS day, ts, event_id, CAST(floor(value * 100) AS BIGINT) AS v, 1.0 + (event_id % 10) / 10.0::DOUBLE AS mark FROM events),
    p1 AS (SELECT *, v * mark * 100 AS notional FROM pl QUALIFY row_number() OVER (PARTITION BY option_symbol, ts ORDER BY event_id) = 1),
    d AS (SELECT *, greatest(v - coalesce(lag(v) OVER (PARTITION BY option_symbol, day ORDER BY ts), 0), 0) AS vd FROM p1),
    c AS (SELECT *, sum(CASE WHEN vd * mark * 100 >= 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY option_symbol, day ORDER BY ts) AS n FROM d),
    s AS (SELECT *, CASE WHEN notional >= 250000 THEN least(100, greatest(0, 34 + CASE WHEN notional >= 1000000 THEN 13 ELSE 0 END + CASE WHEN n > 1 THEN 14 * least(1, (n - 1) / 3.0::DOUBLE) ELSE 0 END + 10)) ELSE 0 END AS score FROM c),
    a AS (SELECT day, ts, option_symbol AS symbol, CASE WHEN score >= 72 THEN 'flow:conviction' ELSE 'flow:notable' END AS rule_key, round_even(score, 1) AS conviction FROM s WHERE score >= 55)
    SELECT day, symbol, rule_key, 'bull' AS kind, conviction FROM a QUALIFY row_number() OVER (PARTITION BY day, symbol, rule_key ORDER BY ts) = 1""",
)
def sweep_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """T-2, K16: a sweep over polled calls without open interest, and its alerts."""
    from .models import _polls

    p = _polls(spark, sf).withColumns({"put_call": F.lit("CALL"), "open_interest": F.lit(0), "dte": F.lit(30), "last": F.lit(None).cast("double"), "bid": F.lit(None).cast("double"), "ask": F.lit(None).cast("double"), "strike": F.lit(100.0), "spot": F.lit(100.0)})
    nothing = spark.createDataFrame([], "underlying string, baseline_notional double, align double")
    flagged = desk.sweep(p, nothing.select("underlying", "baseline_notional"), nothing.select("underlying", "align"))
    return rounded(desk.sweep_alerts(flagged).select("day", "symbol", "rule_key", "kind", "conviction"), 1)


@query("c26_session", "SELECT event_id, round(greatest(least((event_id % 500) / 390.0::DOUBLE, 1), 0.02), 6) AS fraction, CASE WHEN event_id % 7 > 0 THEN round(100 / (event_id % 7 * greatest(least((event_id % 500) / 390.0::DOUBLE, 1), 0.02)), 6) END AS rvol FROM events")
def session(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    f = patterns.session_fraction(F.col("event_id") % 500)
    return rounded(e.select("event_id", f.alias("fraction"), patterns.live_rvol(F.lit(100.0), (F.col("event_id") % 7).cast("double"), f).alias("rvol")))


@query("k27_posture", "SELECT p_partkey, CASE WHEN p_size * 4 - 100 >= 40 THEN 'Risk-on' WHEN p_size * 4 - 100 >= 15 THEN 'Lean bullish' WHEN p_size * 4 - 100 > -15 THEN 'Neutral' WHEN p_size * 4 - 100 > -40 THEN 'Lean bearish' ELSE 'Risk-off' END AS posture, CASE WHEN p_size * 4 - 100 >= 40 THEN 'ROTATE IN' WHEN p_size * 4 - 100 <= -30 THEN 'ROTATE OUT' WHEN p_size * 4 - 100 > 0 THEN 'HOLD' ELSE 'WATCH' END AS call FROM part")
def posture(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of a combined score, as posture and as a call."""
    x = F.col("p_size") * 4 - 100
    return B.table(spark, sf, "part").select("p_partkey", scores.posture(x).alias("posture"), scores.call_of(x).alias("call"))
