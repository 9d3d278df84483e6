"""Queries of tables and loads: members, states, snapshots, staleness, lists and outside feeds.

Customers stand in for symbols (their market segment for a universe) and order
dates for loads; outside texts are made from the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import feeds
from ..sources import adapters as A
from ..sources import bars as B
from ..sources import store as S
from .registry import query, rounded
from .sql import bars
from .windows import _r


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("universe"), "c_acctbal")


def _members(spark: SparkSession, sf: str) -> DataFrame:
    old = _symbols(spark, sf).filter("k % 5 <> 0")
    return old.select("universe", "symbol", F.date_add(_day("2020-01-01"), (F.col("k") % 9).cast("int")).alias("first_seen"), _day("2020-02-01").alias("last_seen"), (F.col("k") % 7 > 0).alias("active"))


_MEMBERS = "m AS (SELECT c_mktsegment AS universe, c_name AS symbol, CAST(DATE '2020-01-01' + CAST(c_custkey % 9 AS INTEGER) AS DATE) AS first_seen, DATE '2020-02-01' AS last_seen, c_custkey % 7 > 0 AS active FROM customer WHERE c_custkey % 5 <> 0)"


@query(
    "s9_membership",
    f"""WITH {_MEMBERS}, n AS (SELECT c_mktsegment AS universe, c_name AS symbol FROM customer WHERE c_custkey % 3 <> 0)
    SELECT coalesce(m.universe, n.universe) AS universe, coalesce(m.symbol, n.symbol) AS symbol, coalesce(first_seen, DATE '2020-03-01') AS first_seen, CASE WHEN n.symbol IS NOT NULL THEN DATE '2020-03-01' ELSE last_seen END AS last_seen, n.symbol IS NOT NULL AS active
    FROM m FULL OUTER JOIN n ON m.universe = n.universe AND m.symbol = n.symbol""",
)
def membership(spark: SparkSession, sf: str) -> DataFrame:
    return B.membership(_members(spark, sf), _symbols(spark, sf).filter("k % 3 <> 0").select("universe", "symbol"), "2020-03-01")


@query("s10_members", f"WITH {_MEMBERS} SELECT universe, symbol FROM m WHERE active AND universe = 'BUILDING'")
def members(spark: SparkSession, sf: str) -> DataFrame:
    return S.active_members(_members(spark, sf), "BUILDING")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").join(_symbols(spark, sf), F.col("o_custkey") == F.col("k"))
    last = o.groupBy("symbol").agg(F.max(F.to_date("o_orderdate")).alias("last_bar"), F.max("k").alias("k"))
    return last.select("symbol", "last_bar", F.when(F.col("k") % 11 == 0, "failed").otherwise("ok").alias("status"))


_STATES = "st AS (SELECT c_name AS symbol, max(CAST(o_orderdate AS DATE)) AS last_bar, CASE WHEN max(c_custkey) % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name)"


@query(
    "s11_universe_status",
    f"""WITH {_MEMBERS}, {_STATES} SELECT universe, count(*) AS n_members, count(*) FILTER (status = 'ok') AS n_synced, count(*) FILTER (status = 'failed') AS n_failed, max(last_bar) AS last_bar
    FROM m LEFT JOIN st ON st.symbol = m.symbol WHERE active GROUP BY universe""",
)
def universe_status(spark: SparkSession, sf: str) -> DataFrame:
    return S.universe_status(_members(spark, sf), _states(spark, sf))


@query(
    "s12_sync_states",
    f"""WITH {_STATES} SELECT symbol, CASE WHEN last_bar < DATE '1998-01-01' THEN DATE '1999-01-01' ELSE last_bar END AS last_bar, CASE WHEN last_bar < DATE '1998-01-01' THEN 'ok' ELSE status END AS status FROM st""",
)
def sync_states(spark: SparkSession, sf: str) -> DataFrame:
    """States are stored, those behind a date are loaded again and upserted, the setting tells the date."""
    store, states = S.session_store(spark), _states(spark, sf)
    store.replace("sync", states)
    store.set("sync_behind", "1998-01-01")
    behind = store.read("sync").filter(F.col("last_bar") < _day(store.get("sync_behind")))
    store.upsert("sync", behind.select("symbol", _day("1999-01-01").alias("last_bar"), F.lit("ok").alias("status")), ["symbol"])
    return store.read("sync")


@query(
    "s7_replaced_parts",
    "SELECT c_custkey, c_mktsegment AS universe, CASE WHEN c_mktsegment = 'BUILDING' THEN -1.0 ELSE c_acctbal END AS value FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 2 = 0",
)
def replaced_parts(spark: SparkSession, sf: str) -> DataFrame:
    """One universe of a derived table is written again, the others stay; then the table is read."""
    store = S.session_store(spark)
    rows = B.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("universe"))
    store.replace_parts("derived", rows, "universe")
    store.replace_parts("derived", rows.filter("universe = 'BUILDING' and c_custkey % 2 = 0").withColumn("value", F.lit(-1.0)), "universe")
    return store.read("derived").select("c_custkey", "universe", "value")


@query(
    "s5_staleness",
    f"WITH {bars('market', name='mkt')} SELECT max(date) AS bars_date, DATE '2001-01-01' AS stored_date, max(date) > DATE '2001-01-01' AS stale FROM mkt",
)
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    """The stored snapshot's date against the newest bar."""
    store = S.session_store(spark)
    store.replace("stamp", spark.range(1).select(_day("2001-01-01").alias("date")))
    return S.needs_refresh(B.market_bars(spark, sf), store.read("stamp"))


_FUND = "f AS (SELECT p_partkey AS symbol, nullif(p_size % 5, 0)::DOUBLE AS beta, p_retailprice AS market_cap, CASE WHEN p_size % 4 > 0 THEN p_size / 100.0::DOUBLE END AS eps FROM part)"


def _fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    beta = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 5).cast("double"))
    return p.select(F.col("p_partkey").alias("symbol"), beta.alias("beta"), F.col("p_retailprice").alias("market_cap"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / F.lit(100.0)).alias("eps"))


@query(
    "s14_partial_upsert",
    f"""WITH {_FUND}, n AS (SELECT symbol + 10 AS symbol, CASE WHEN symbol % 3 > 0 THEN 9.5::DOUBLE END AS beta FROM f WHERE symbol % 2 = 0)
    SELECT coalesce(f.symbol, n.symbol) AS symbol, CASE WHEN n.symbol IS NOT NULL THEN n.beta ELSE f.beta END AS beta, market_cap, eps FROM f FULL OUTER JOIN n ON n.symbol = f.symbol""",
)
def partial_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = _fundamentals(spark, sf)
    new = old.filter("symbol % 2 = 0").select((F.col("symbol") + 10).alias("symbol"), F.when(F.col("symbol") % 3 > 0, 9.5).alias("beta"))
    return S.merged_columns(old, new, "symbol", ["beta"])


@query("s15_coverage", f"WITH {_FUND} SELECT count(*) AS n, count(beta) AS n_beta, count(market_cap) AS n_market_cap, count(eps) AS n_eps FROM f")
def fundamentals_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return S.known_counts(_fundamentals(spark, sf), ["beta", "market_cap", "eps"])


@query(
    "s16_stale",
    f"""WITH {_STATES} SELECT c_name AS symbol FROM customer WHERE c_name NOT IN (SELECT symbol FROM st WHERE last_bar >= DATE '1998-06-01' AND status <> 'failed')""",
)
def stale(spark: SparkSession, sf: str) -> DataFrame:
    return B.stale(_states(spark, sf), _symbols(spark, sf), "1998-06-01", "last_bar")


_OWN = "h AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date_reported, round(max(o_totalprice) / 500000, 6) AS pct_held FROM orders GROUP BY ALL)"


def _ownership(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    held = F.max("o_totalprice") / 500000
    # SQL rounds the binary value; Spark would round its shortest decimal text, which differs at a last digit of 5.
    pct = F.round(held * 1e6) / 1e6
    return o.groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date_reported")).agg(pct.alias("pct_held"))


@query(
    "s17_ownership",
    f"""WITH {_OWN}, w AS (SELECT *, lag(pct_held) OVER s AS prev_pct, lag(date_reported) OVER s AS prev_date, row_number() OVER (PARTITION BY symbol ORDER BY date_reported DESC) AS k FROM h WINDOW s AS (PARTITION BY symbol ORDER BY date_reported))
    SELECT symbol, date_reported, pct_held, prev_date, prev_pct FROM w WHERE k = 1""",
)
def ownership(spark: SparkSession, sf: str) -> DataFrame:
    """Appended history, read back as the newest pair of each symbol."""
    store, h = S.session_store(spark), _ownership(spark, sf)
    store.replace("ownership", h.filter("date_reported < date'1997-01-01'"))
    store.upsert("ownership", h.filter("date_reported >= date'1997-01-01'"), ["symbol", "date_reported"])
    return S.ownership_pair(store.read("ownership"))


@query(
    "s19_constituents",
    f"""WITH {_MEMBERS}, g AS (SELECT universe, CASE universe WHEN 'BUILDING' THEN DATE '2020-02-25' ELSE DATE '2020-01-05' END AS seen FROM m GROUP BY universe)
    SELECT m.universe AS universe, m.symbol AS symbol FROM m JOIN g ON g.universe = m.universe WHERE seen >= DATE '2020-02-23' OR m.universe = 'MACHINERY'
    UNION ALL SELECT c_mktsegment, c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def constituents(spark: SparkSession, sf: str) -> DataFrame:
    """One universe is cached and young, one could not be fetched, the rest is fetched anew."""
    cached = _members(spark, sf).withColumn("fetched_at", F.when(F.col("universe") == "BUILDING", _day("2020-02-25")).otherwise(_day("2020-01-05")))
    fetched = _symbols(spark, sf).filter("k % 3 <> 0 and universe not in ('BUILDING', 'MACHINERY')")
    return S.fresh_or_cached(fetched, cached, "2020-03-01", 7)


@query(
    "s24_backfill",
    f"""WITH {_STATES}, j AS (SELECT c_name AS symbol, last_bar, last_bar IS NULL OR status = 'failed' AS full_ FROM customer LEFT JOIN st ON st.symbol = c_name)
    SELECT symbol, CASE WHEN full_ THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN NOT full_ THEN CAST(last_bar - 7 AS DATE) END AS start FROM j WHERE full_ OR last_bar < DATE '1998-06-01'""",
)
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    return S.backfill_plan(_symbols(spark, sf), _states(spark, sf), "1998-06-01")


@query(
    "s30_phases",
    f"""WITH {_STATES}, p AS (SELECT c_name AS symbol, unnest([{{'n': 'bars', 'd': date_diff('day', last_bar, DATE '1998-09-01'), 'a': 30}}, {{'n': 'growth', 'd': date_diff('day', CASE WHEN status = 'ok' THEN last_bar END, DATE '1998-09-01'), 'a': 90}}]) AS x FROM customer LEFT JOIN st ON st.symbol = c_name)
    SELECT symbol, x.n AS phase FROM p WHERE coalesce(x.d > x.a, true)""",
)
def refresh_phases(spark: SparkSession, sf: str) -> DataFrame:
    known = _states(spark, sf).select("symbol", F.col("last_bar").alias("bars"), F.when(F.col("status") == "ok", F.col("last_bar")).alias("growth"))
    return S.phases(_symbols(spark, sf), known, "1998-09-01", {"bars": 30, "growth": 90})


@query("s31_first_known", f"WITH {_FUND} SELECT symbol, coalesce(eps, beta) AS growth, coalesce(beta, eps, market_cap) AS any_value FROM f")
def first_known(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_known(_fundamentals(spark, sf), {"growth": ["eps", "missing", "beta"], "any_value": ["beta", "eps", "market_cap"]}).select("symbol", "growth", "any_value")


@query("s29_cleaned", "SELECT p_partkey AS symbol, nullif((p_size % 5)::DOUBLE, 0) AS beta, (p_size % 5)::DOUBLE AS div_yield FROM part")
def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("p_size") % 5).cast("double")
    return A.fundamentals(B.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), x.alias("beta"), x.alias("div_yield")))


@query(
    "s36_observations",
    """WITH o AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS date, max(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT series_id, date, value FROM o WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 30""",
)
def observations(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = o.groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.max(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice"))).alias("v"))
    text = v.select("series_id", F.col("date").cast("string").alias("date"), F.coalesce(F.col("v").cast("string"), F.lit(".")).alias("value"))
    return A.observations(text, 30)


@query(
    "s18_listing",
    "SELECT DISTINCT trim(upper(substr(p_name, 1, 4))) AS symbol FROM part WHERE p_size % 3 > 0 AND p_partkey % 10 > 0 AND regexp_full_match(trim(upper(substr(p_name, 1, 4))), '[A-Z]{1,5}')",
)
def listing(spark: SparkSession, sf: str) -> DataFrame:
    sym = F.upper(F.substring("p_name", 1, 4))
    test = F.when(F.col("p_partkey") % 10 == 0, "Y").otherwise("N")
    lines = B.table(spark, sf, "part").select("p_size", F.concat_ws("|", sym, F.col("p_name"), F.lit("Q"), test, F.lit("N")).alias("line"))
    footer = spark.range(1).select(F.lit("File Creation Time: 0102|||").alias("line"))
    return A.listing(lines.filter("p_size % 3 > 0").select("line").unionByName(footer))


@query("s18_html_table", "SELECT CAST(s_suppkey % 7 AS BIGINT) AS page, replace(s_name, '.', '-') AS symbol, CAST(s_nationkey AS VARCHAR) AS sector FROM supplier")
def html_table(spark: SparkSession, sf: str) -> DataFrame:
    """Constituents from the first table of a page, by its cells."""
    s = B.table(spark, sf, "supplier")
    row = F.concat(F.lit("<tr><td><a href='/q'>"), F.col("s_name"), F.lit("</a></td>\n<td>"), F.col("s_nationkey").cast("string"), F.lit("</td></tr>"))
    pages = s.groupBy((F.col("s_suppkey") % 7).alias("page")).agg(F.concat_ws("\n", F.collect_list(row)).alias("rows"))
    html = F.concat(F.lit("<html><table class='w'><tr><th>Symbol</th><th>Sector</th></tr>"), F.col("rows"), F.lit("</table><table><tr><td>x</td><td>y</td></tr></table></html>"))
    return A.html_table(pages.select("page", html.alias("html")), "page", ["symbol", "sector"])


@query(
    "s21_long_prices",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1)
    SELECT symbol, date, close FROM (UNPIVOT d ON O, F, P INTO NAME symbol VALUE close) WHERE close IS NOT NULL""",
)
def long_prices(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    wide = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(*[F.max(F.when(F.col("o_orderstatus") == k, F.col("o_totalprice"))).alias(k) for k in "OFP"])
    return A.long_prices(wide, ["O", "F", "P"])


@query(
    "s25_last_closed",
    """WITH t AS (SELECT event_id, ts, ts + INTERVAL 1 HOUR * (event_id % 31) AS u FROM events), l AS (SELECT event_id, ((u AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS n FROM t),
    d AS (SELECT event_id, CAST(n AS DATE) - CASE WHEN hour(n) < 16 THEN 1 ELSE 0 END AS d FROM l)
    SELECT event_id, CAST(d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS DATE) AS last_bar FROM d""",
)
def last_closed(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    now = F.timestamp_seconds(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 3600 * (F.col("event_id") % 31))
    return e.select("event_id", A.last_closed(now).alias("last_bar"))


@query(
    "s34_meetings",
    """WITH m AS (SELECT DATE '1997-02-05' AS d UNION ALL SELECT DATE '1997-03-25' UNION ALL SELECT DATE '1997-05-20'), e AS (SELECT d AS event_date, 'FOMC rate decision' AS title, 'high' AS importance FROM m UNION ALL SELECT CAST(d + 21 AS DATE), 'FOMC minutes', 'med' FROM m)
    SELECT * FROM e WHERE event_date BETWEEN DATE '1997-02-01' AND DATE '1997-04-20'""",
)
def meetings(spark: SparkSession, sf: str) -> DataFrame:
    return A.meetings(spark, ["1997-02-05", "1997-03-25", "1997-05-20"], "1997-02-01", "1997-04-20")


@query(
    "s35_approximate",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'),
    f AS (SELECT month, CAST(month + ((12 - isodow(month)) % 7)::INTEGER AS DATE) AS ff, CAST(last_day(month) - CASE isodow(last_day(month)) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS DATE) AS lb FROM m)
    SELECT ff AS event_date, 'Employment Situation' AS title FROM f UNION ALL SELECT CAST(month + 11 AS DATE), 'Consumer Price Index' FROM f UNION ALL SELECT CAST(month + 12 AS DATE), 'Producer Price Index' FROM f
    UNION ALL SELECT CAST(month + 15 AS DATE), 'Retail Sales' FROM f UNION ALL SELECT lb, 'Personal Income and Outlays' FROM f UNION ALL SELECT CAST(month + 27 AS DATE), 'Gross Domestic Product' FROM f WHERE month(month) % 3 = 1""",
)
def approximate_calendar(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").filter("o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'")
    return A.approximate_calendar(o.select(F.to_date("o_orderdate").alias("month")))


@query("s37_feed", "SELECT o_orderkey AS feed_id, 'Order ' || o_orderkey || ' of ' || o_orderpriority AS title, 'http://x/' || o_orderkey AS link, CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderkey % 50 = 0")
def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Items of RSS texts."""
    o = B.table(spark, sf, "orders").filter("o_orderkey % 50 = 0")
    item = F.concat(
        F.lit("<item><title>Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_orderpriority"), F.lit("</title><link>http://x/"), F.col("o_orderkey").cast("string"),
        F.lit("</link><pubDate>"), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" 08:30:00 GMT</pubDate></item>"),
    )
    texts = o.select(F.col("o_orderkey").alias("feed_id"), F.concat(F.lit("<rss><channel><title>t</title>"), item, F.lit("</channel></rss>")).alias("xml"))
    return A.feed_items(texts, "feed_id")


@query(
    "s38_earnings",
    """WITH e AS (SELECT c_name AS symbol, CAST(o_orderdate AS DATE) AS event_date, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-01-15'),
    r AS (SELECT c_name AS symbol FROM customer WHERE c_acctbal > 5000) SELECT DISTINCT symbol, event_date FROM e WHERE symbol IN (SELECT symbol FROM r) OR NOT EXISTS (SELECT 1 FROM r)""",
)
def earnings(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").join(_symbols(spark, sf), F.col("o_custkey") == F.col("k"))
    e = o.select("symbol", F.to_date("o_orderdate").alias("event_date")).distinct()
    return A.earnings(e, _symbols(spark, sf).filter("c_acctbal > 5000"), "1998-01-01", "1998-01-14")


@query("s40_first_tickers", "SELECT doc_id, array_to_string(list_slice(string_split(substr(coalesce(text, ''), 1, 200), ' '), 1, 6), '|') AS tickers FROM documents")
def first_tickers(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents").select("doc_id", F.split(F.substring(F.coalesce("text", F.lit("")), 1, 200), " ").alias("tickers"))
    return A.first_tickers(d).select("doc_id", F.concat_ws("|", "tickers").alias("tickers"))


@query(
    "s39_newest_filing",
    """WITH f AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS filed, max(o_orderkey) AS id FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT symbol, filed, id FROM f WHERE filed = (SELECT max(filed) FROM f AS g WHERE g.symbol = f.symbol) AND filed BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""",
)
def newest_filing(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").withColumn("form", F.when(F.col("o_orderstatus") == "P", "10-Q").otherwise("8-K"))
    f = o.groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("filed"), "form").agg(F.max("o_orderkey").alias("id"))
    return feeds.newest_filing(f, "1998-01-01", "1998-06-30").select("symbol", "filed", "id")


@query(
    "s41_news",
    """SELECT min(o_orderkey) AS pos, CAST(o_orderdate AS DATE) AS published, o_orderpriority AS publisher FROM orders
    GROUP BY CAST(o_orderdate AS DATE), o_orderpriority, CASE WHEN o_custkey % 3 > 0 THEN 'T' || o_custkey % 4 ELSE o_orderstatus END""",
)
def news(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    t = F.when(F.col("o_custkey") % 3 > 0, F.array(F.concat(F.lit("T"), (F.col("o_custkey") % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    n = o.select(F.col("o_orderkey").alias("pos"), F.to_date("o_orderdate").alias("published"), F.col("o_orderpriority").alias("publisher"), t.alias("tickers"), F.col("o_orderstatus").alias("title"))
    return feeds.deduplicated_news(n).select("pos", "published", "publisher")


@query(
    "s44_positions",
    "SELECT CAST(o_custkey AS VARCHAR) AS account, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'EQUITY' ELSE 'OPTION' END AS asset_type, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END - CASE WHEN o_orderstatus <> 'O' THEN o_totalprice ELSE 0 END AS quantity, o_totalprice AS market_value FROM orders",
)
def positions(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    is_open = F.col("o_orderstatus") == "O"
    p = F.struct(
        F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "EQUITY").otherwise("OPTION").alias("asset_type"),
        F.when(is_open, F.col("o_totalprice")).alias("long_qty"), F.when(~is_open, F.col("o_totalprice")).alias("short_qty"), F.col("o_totalprice").alias("market_value"),
    )
    return A.positions(o.groupBy(F.col("o_custkey").cast("string").alias("account")).agg(F.collect_list(p).alias("positions")))


@query("s54_held", "SELECT DISTINCT o_orderpriority AS symbol FROM orders WHERE o_orderkey % 2 = 0")
def held(spark: SparkSession, sf: str) -> DataFrame:
    return A.held_symbols(positions(spark, sf))


@query(
    "s45_watchlist",
    """WITH c AS (SELECT p_brand AS file, upper(substr(p_type, 1, 5)) AS t, min(p_partkey) AS k FROM part WHERE p_size % 7 > 0 GROUP BY ALL)
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY k) AS INTEGER) AS position, t AS symbol FROM c""",
)
def watchlist(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.when(F.col("p_size") % 7 == 0, "### section").otherwise(F.concat(F.lit("NYSE:"), F.lower(F.substring("p_type", 1, 5))))
    lines = B.table(spark, sf, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", cell.alias("c")))).alias("x"))
    return A.watchlist(lines.select("file", F.concat_ws("\n", F.transform("x", lambda e: e["c"])).alias("text")))


@query(
    "s46_dialects",
    """SELECT p_partkey, replace(p_brand || '.B', '.', '/') AS vendor, p_brand || '.B' AS own, CASE WHEN p_size % 2 = 0 THEN '$' || p_brand || '.X' ELSE replace(p_brand || '.X', '.', '/') END AS guarded FROM part""",
)
def dialects(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    own = F.concat(F.col("p_brand"), F.lit(".B"))
    mixed = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("$"), F.col("p_brand"), F.lit(".X"))).otherwise(F.concat(F.col("p_brand"), F.lit(".X")))
    return p.select("p_partkey", A.to_vendor(own).alias("vendor"), A.from_vendor(A.to_vendor(own)).alias("own"), A.to_vendor(mixed).alias("guarded"))


@query(
    "s53_sector_funds",
    f"""SELECT p_partkey, CASE p_partkey % 14 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate([*A.SECTOR_ETF.values(), 'XLK']))} END AS fund FROM part""",
)
def sector_funds(spark: SparkSession, sf: str) -> DataFrame:
    names = [*A.SECTOR_ETF, "XLK", "Shipping"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return B.table(spark, sf, "part").select("p_partkey", A.sector_etf(name).alias("fund"))


@query(
    "s32_contracts",
    """SELECT c_custkey AS id, 'C' || c_custkey AS option_symbol, CASE WHEN c_custkey % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS put_call, round(abs(c_acctbal), 2) AS strike, DATE '2024-03-15' AS expiry, CASE WHEN c_custkey % 5 > 0 THEN 1.5::DOUBLE END AS bid, c_custkey % 9 AS session_volume, 100.0::DOUBLE AS spot FROM customer""",
)
def contracts(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer")
    bid = F.when(F.col("c_custkey") % 5 > 0, 1.5).otherwise(-999.0)
    kind = F.when(F.col("c_custkey") % 2 == 0, "CALL").otherwise("PUT")
    exp = F.when(F.col("c_custkey") % 3 == 0, "1710460800000").otherwise("2024-03-15T20:00:00.000+00:00")
    one = F.format_string('[{"symbol":"C%d","putCall":"%s","strikePrice":%s,"expirationDate":"%s","daysToExpiration":9,"bid":%s,"totalVolume":%d}]', "c_custkey", kind, F.round(F.abs("c_acctbal"), 2).cast("string"), exp, bid.cast("string"), F.col("c_custkey") % 9)
    side = F.concat(F.lit('{"2024-03-15:9":{"1":'), one, F.lit("}}"))
    call = F.when(F.col("c_custkey") % 2 == 0, side).otherwise(F.lit("{}"))
    put = F.when(F.col("c_custkey") % 2 == 0, F.lit("{}")).otherwise(side)
    raw = F.concat(F.lit('{"underlyingPrice":-999.0,"underlying":{"last":100.0},"callExpDateMap":'), call, F.lit(',"putExpDateMap":'), put, F.lit("}"))
    chains = c.select(F.col("c_custkey").cast("string").alias("underlying"), F.lit("2024-03-06").alias("ts"), raw.alias("raw"))
    return A.contracts(chains).select(F.col("underlying").cast("long").alias("id"), "option_symbol", "put_call", "strike", "expiry", "bid", "session_volume", "spot")


@query("s58_conformed", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(NULL AS DOUBLE) AS added FROM orders")
def conformed(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType().add("o_orderkey", "long").add("o_custkey", "string").add("added", "double")
    return S.conform(B.table(spark, sf, "orders"), schema)


@query(
    "s59_persisted",
    """WITH f AS (SELECT c_name AS symbol, min(c_custkey) AS k FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), s AS (SELECT c_name AS symbol, min(c_custkey) AS k FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1),
    u AS (SELECT symbol, 0 AS part, k FROM f UNION ALL SELECT symbol, 1, k FROM s WHERE symbol NOT IN (SELECT symbol FROM f)) SELECT symbol, CAST(row_number() OVER (ORDER BY part, k) AS INTEGER) AS position FROM u""",
)
def persisted(spark: SparkSession, sf: str) -> DataFrame:
    store, s = S.session_store(spark), _symbols(spark, sf)
    ranked = lambda cond: s.filter(cond).select("symbol", F.row_number().over(Window.orderBy("k")).alias("position"))
    store.replace("watchlist", feeds.merged_list(None, ranked("k % 2 = 0")))
    store.replace("watchlist", feeds.merged_list(store.read("watchlist"), ranked("k % 3 = 0")))
    return store.read("watchlist")


@query(
    "s26_filled_closes",
    f"""WITH {bars('nation', 'day')}, k AS (SELECT symbol, min(date) AS f FROM bars GROUP BY symbol), g AS (SELECT k.symbol, d.date FROM k JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= k.f), j AS (SELECT g.symbol, g.date, b.close FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.date = g.date)
    SELECT symbol, date, {_r('last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS close FROM j""",
)
def filled_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Closes as scanned, carried forward on the dates of all."""
    return rounded(S.closes_grid(B.nation_bars(spark, sf, "day")))


@query(
    "s55_macro_bundle",
    """WITH l AS (SELECT 'closes' AS leg, CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem), r AS (SELECT 'rates', CAST(o_orderdate AS DATE) FROM orders)
    SELECT leg, count(DISTINCT date) AS n, count(*) > 0 AS ok FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY leg UNION ALL SELECT 'breadth', 0, false""",
)
def macro_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Legs that could not be read are empty and marked."""
    rates = B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    legs = A.bundle({"closes": lambda: B.market_bars(spark, sf), "rates": lambda: rates, "breadth": lambda: B.table(spark, sf, "no_such_table")}, spark)
    return S.union_all([df.select("date").agg(F.countDistinct("date").alias("n")).select(F.lit(n).alias("leg"), "n", F.lit(ok).alias("ok")) for n, (df, ok) in legs.items()])


@query(
    "s56_flow_store",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id AS contract, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN 'opened' END AS entry_exit FROM events GROUP BY ALL)
    SELECT day, contract, n, CASE WHEN entry_exit IS NULL AND user_id_ % 2 = 0 THEN 'flat' ELSE entry_exit END AS entry_exit, day = (SELECT max(day) FROM s) AS latest FROM (SELECT *, contract AS user_id_ FROM s)""",
)
def flow_store(spark: SparkSession, sf: str) -> DataFrame:
    """Unconfirmed signals get a result, the latest day is marked."""
    e = B.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("contract")).agg(F.count("*").alias("n"))
    s = e.withColumn("entry_exit", F.when(F.col("contract") % 3 == 0, "opened"))
    results = feeds.unconfirmed(s, "2100-01-01").filter("contract % 2 = 0").select("day", "contract", F.lit("flat").alias("result"))
    return feeds.with_results(s, results, ["day", "contract"])


@query(
    "s52_win_rate_gate",
    "SELECT c_name AS symbol FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE d IS NULL OR d < DATE '1998-07-01'",
)
def win_rate_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols whose win rates were not computed on or after the day."""
    done = _states(spark, sf).withColumn("status", F.lit("ok"))
    return B.stale(done, _symbols(spark, sf), "1998-07-01", "last_bar")


@query("s22_sources", "SELECT * FROM (VALUES (0, 'bulk', true), (1, 'bulk', false), (2, 'files', false)) v(case_no, source, preferred)")
def sources(spark: SparkSession, sf: str) -> DataFrame:
    """The source that is used, by what is available."""
    cases = [("bulk", ["bulk", "files"]), ("paid", ["bulk", "files"]), (None, ["files"])]
    return spark.createDataFrame([(k, *A.resolved(p, a, ("bulk", "files"))) for k, (p, a) in enumerate(cases)], "case_no int, source string, preferred boolean")


@query("s47_day_cache", "SELECT * FROM (VALUES ('2024-01-02', 'kept'), ('2024-01-03', 'made')) v(day, text)")
def day_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A text is made once a day and read back after that."""
    store, made = S.session_store(spark), []

    def brief(day: str, text: str) -> str:
        if store.get(f"brief-{day}") is None:
            store.set(f"brief-{day}", {"text": text})
        return store.get(f"brief-{day}")["text"]

    made.append(("2024-01-02", brief("2024-01-02", "kept")))
    brief("2024-01-02", "ignored")
    made[0] = ("2024-01-02", brief("2024-01-02", "ignored again"))
    made.append(("2024-01-03", brief("2024-01-03", "made")))
    return spark.createDataFrame(made, "day string, text string")


@query("s20_history", "SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY ALL")
def history(spark: SparkSession, sf: str) -> DataFrame:
    """Histories written as files and read through the adapter, without the rows that have no close."""
    o = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"))
    gaps = o.limit(20).withColumn("close", F.lit(float("nan"))).withColumn("date", F.lit("1990-01-01").cast("date"))
    store = S.session_store(spark)
    store.replace("history", o.unionByName(gaps))
    return A.clean_bars(store.read("history"))
