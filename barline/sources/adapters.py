"""Readers and normalisers for outside data that lies in files: chains, lists, series, calendars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clean

#: Sector names and their funds.
SECTOR_ETF = {
    "Technology": "XLK",
    "Energy": "XLE",
    "Healthcare": "XLV",
    "Health Care": "XLV",
    "Financial Services": "XLF",
    "Consumer Cyclical": "XLY",
    "Consumer Defensive": "XLP",
    "Industrials": "XLI",
    "Basic Materials": "XLB",
    "Utilities": "XLU",
    "Real Estate": "XLRE",
    "Communication Services": "XLC",
}
_CONTRACT = (
    "symbol: string, putCall: string, strikePrice: double, expirationDate: string, daysToExpiration: int, bid: double, ask: double, last: double, "
    "mark: double, totalVolume: bigint, openInterest: bigint, volatility: double, delta: double"
)
_SIDE = f"map<string, map<string, array<struct<{_CONTRACT}>>>>"
CHAIN = f"underlyingPrice double, underlying struct<last: double>, callExpDateMap {_SIDE}, putExpDateMap {_SIDE}"


def sector_etf(sector: Column) -> Column:
    """The fund of a sector; a fund's own symbol maps to itself, anything else to NULL."""
    out = F.when(sector.isin(sorted(set(SECTOR_ETF.values()))), sector)
    for k, v in SECTOR_ETF.items():
        out = out.when(sector == k, v)
    return out


def to_vendor(symbol: Column) -> Column:
    """Class shares with a slash; index symbols stay."""
    return F.when(symbol.rlike(r"^[$^]"), symbol).otherwise(F.replace(symbol, F.lit("."), F.lit("/")))


def from_vendor(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("/"), F.lit("."))


def known(x: Column) -> Column:
    """Vendor sentinels (-998 and below) and NaN as NULL."""
    x = clean(x)
    return F.when(x > -998.0, x)


def contracts(chains: DataFrame) -> DataFrame:
    """One row for each option contract of raw chain texts (``underlying, ts, raw``)."""
    j = chains.select(F.col("underlying").alias("u"), "ts", F.from_json("raw", CHAIN).alias("c"))
    spot = F.coalesce(known(F.col("c.underlyingPrice")), known(F.col("c.underlying.last")))
    out = None
    for side in ("callExpDateMap", "putExpDateMap"):
        part = j.select("u", "ts", spot.alias("spot"), F.explode(F.map_values(f"c.{side}")).alias("m"))
        part = part.select("u", "ts", "spot", F.explode(F.map_values("m")).alias("ks")).select("u", "ts", "spot", F.explode("ks").alias("k"))
        out = part if out is None else out.unionByName(part)
    epoch = F.col("k.expirationDate").rlike(r"^\d{11,}$")
    expiry = F.when(epoch, F.to_date(F.timestamp_millis(F.expr("try_cast(k.expirationDate as bigint)")))).otherwise(F.expr("try_cast(substring(k.expirationDate, 1, 10) as date)"))
    return out.select(
        F.col("u").alias("underlying"), F.col("k.symbol").alias("option_symbol"), F.col("k.putCall").alias("put_call"), known(F.col("k.strikePrice")).alias("strike"),
        expiry.alias("expiry"), F.col("k.daysToExpiration").alias("dte"), *[known(F.col(f"k.{n}")).alias(n) for n in ("bid", "ask", "last", "mark")],
        F.coalesce("k.totalVolume", F.lit(0)).alias("session_volume"), F.coalesce("k.openInterest", F.lit(0)).alias("open_interest"),
        known(F.col("k.volatility")).alias("iv"), known(F.col("k.delta")).alias("delta"), "spot", "ts",
    )


def fundamentals(raw: DataFrame) -> DataFrame:
    """Zero means missing, but for the dividend yield."""
    keep = ("div_yield",)
    return raw.withColumns({n: F.when(clean(n) != 0, F.col(n)) if n not in keep else clean(n) for n, t in raw.dtypes if t == "double"})


def observations(lines: DataFrame, newest: int | None = None) -> DataFrame:
    """Series rows (``series_id, date, value`` texts); "." is dropped; at most the newest n of each series."""
    s = lines.select("series_id", F.to_date("date").alias("date"), F.expr("try_cast(value as double)").alias("value")).filter("value is not null")
    if newest is None:
        return s
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    return s.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= newest).drop("__k")


def rates(series: DataFrame) -> DataFrame:
    """Last value of each series and its changes over 1, 5 and 21 observations in basis points."""
    w = Window.partitionBy("series_id").orderBy("date")
    d = series.withColumns({f"d{n}": F.bround(100 * (F.col("value") - F.lag("value", n).over(w))).cast("long") for n in (1, 5, 21)})
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("date").desc()))).filter("__k = 1")
    return d.select("series_id", "date", F.bround("value", 2).alias("value"), "d1", "d5", "d21", (F.col("value") < 0).alias("below_zero"))


def long_prices(wide: DataFrame, symbols: list[str]) -> DataFrame:
    """One row for each date and symbol of a wide table; rows without a price go."""
    return wide.unpivot(["date"], symbols, "symbol", "close").select("symbol", F.to_date("date").alias("date"), clean("close").alias("close")).filter("close is not null")


def watchlist(files: DataFrame) -> DataFrame:
    """Tickers of uploaded texts (``file, text``) in order, each once: ``file, position, symbol``.

    A header cell named ticker or symbol picks its column; otherwise every cell counts.
    Exchange prefixes go, section marks and other shapes are skipped, dots become dashes.
    """
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("row", "line")).filter(F.trim("line") != "")
    cells = lines.withColumns({"cells": F.transform(F.split("line", ","), lambda c: F.trim(F.regexp_replace(F.trim(c), "[\"']", ""))), "first": F.min("row").over(Window.partitionBy("file"))})
    header = F.transform(F.col("cells"), lambda c: F.lower(c))
    at = F.coalesce(*[F.nullif(F.array_position(header, k), F.lit(0)) for k in ("ticker", "symbol", "symbols")])
    picked = F.max(F.when(F.col("row") == F.col("first"), at)).over(Window.partitionBy("file"))
    cells = cells.withColumn("col", picked).filter("col is null or row > first")
    each = cells.select("file", "row", "col", F.posexplode("cells").alias("c", "cell")).filter("col is null or c + 1 = col")
    token = F.upper(F.col("cell"))
    token = F.when(token.contains(":"), F.trim(F.element_at(F.split(token, ":"), -1))).otherwise(token)
    good = each.withColumn("t", token).filter(~F.col("cell").startswith("#") & F.col("t").rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"))
    named = good.withColumn("symbol", F.replace("t", F.lit("."), F.lit("-")))
    first = named.groupBy("file", "symbol").agg(F.min(F.struct("row", "c")).alias("o"))
    return first.select("file", F.row_number().over(Window.partitionBy("file").orderBy("o")).alias("position"), "symbol")


def listing(lines: DataFrame) -> DataFrame:
    """Symbols of a pipe-separated listing (``line``): no test issues, no odd shapes, no footer."""
    p = F.split("line", r"\|")
    s = lines.filter(~F.col("line").startswith("File Creation Time")).select(F.trim(p[0]).alias("symbol"), F.trim(F.element_at(p, 4)).alias("test"))
    return s.filter((F.col("test") != "Y") & F.col("symbol").rlike(r"^[A-Z]{1,5}$")).select("symbol").distinct()


def last_closed(now: Column) -> Column:
    """The last date with a closed bar: today from 16:00 New York on, never a weekend."""
    local = F.from_utc_timestamp(now, "America/New_York")
    d = F.date_sub(F.to_date(local), F.when(F.hour(local) < 16, 1).otherwise(0))
    return F.date_sub(d, F.when(F.dayofweek(d) == 7, 1).when(F.dayofweek(d) == 1, 2).otherwise(0))


def month_marks(months: DataFrame) -> DataFrame:
    """First Friday and last business day of each month (``month``, any date in it)."""
    first = F.trunc("month", "MM")
    end = F.last_day("month")
    back = F.when(F.dayofweek(end) == 7, 1).when(F.dayofweek(end) == 1, 2).otherwise(0)
    return months.select(first.alias("month"), F.next_day(F.date_sub(first, 1), "Fri").alias("first_friday"), F.date_sub(end, back).alias("last_business_day")).distinct()


def events(rows: DataFrame, start: str, end: str, importance: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Calendar rows of a date range; importance sorts as text, descending."""
    out = rows.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    out = out.filter(F.col("importance").isin(importance)) if importance else out
    out = out.filter(F.col("kind").isin(kinds)) if kinds else out
    return out.orderBy("event_date", F.col("importance").desc())


def positions(accounts: DataFrame) -> DataFrame:
    """One row for each position of nested accounts; quantity is long less short."""
    p = accounts.select("account", F.explode("positions").alias("p"))
    return p.select("account", F.col("p.symbol").alias("symbol"), F.col("p.asset_type").alias("asset_type"), (F.coalesce("p.long_qty", F.lit(0.0)) - F.coalesce("p.short_qty", F.lit(0.0))).alias("quantity"), F.col("p.market_value").alias("market_value"))


def held_symbols(rows: DataFrame) -> DataFrame:
    """Distinct symbols of shares and funds, in order."""
    return rows.filter(F.col("asset_type").isin("EQUITY", "ETF")).select("symbol").distinct().orderBy("symbol")


def html_table(pages: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the first table of each page (``html``) as texts without tags; header rows have no cells."""
    first = F.regexp_extract("html", r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = pages.select(key, F.explode(F.regexp_extract_all(first, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("r"))
    cells = rows.select(key, F.regexp_extract_all("r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1).alias("c")).filter(F.size("c") >= len(columns))
    text = lambda k: F.trim(F.regexp_replace(F.col("c")[k], r"<[^>]*>", ""))
    named = cells.select(key, *[text(k).alias(n) for k, n in enumerate(columns)])
    return named.withColumn("symbol", F.replace("symbol", F.lit("."), F.lit("-"))) if "symbol" in columns else named


def meetings(spark: SparkSession, days: list[str], start: str, end: str) -> DataFrame:
    """Rate decisions, and their minutes three weeks on, within a range."""
    d = spark.createDataFrame([(x,) for x in days], "d string").select(F.to_date("d").alias("d"))
    both = d.select(F.col("d").alias("event_date"), F.lit("FOMC rate decision").alias("title"), F.lit("high").alias("importance"))
    both = both.unionByName(d.select(F.date_add("d", 21).alias("event_date"), F.lit("FOMC minutes").alias("title"), F.lit("med").alias("importance")))
    return both.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def approximate_calendar(months: DataFrame) -> DataFrame:
    """Releases on their usual days of each month (``month``, any date in it)."""
    m = month_marks(months)
    cells = [
        ("Employment Situation", F.col("first_friday")),
        ("Consumer Price Index", F.date_add("month", 11)),
        ("Producer Price Index", F.date_add("month", 12)),
        ("Retail Sales", F.date_add("month", 15)),
        ("Personal Income and Outlays", F.col("last_business_day")),
        ("Gross Domestic Product", F.when(F.month("month") % 3 == 1, F.date_add("month", 27))),
    ]
    each = F.explode(F.array(*[F.struct(day.alias("event_date"), F.lit(title).alias("title")) for title, day in cells]))
    return m.select(each.alias("x")).select("x.*").filter("event_date is not null")


def feed_items(texts: DataFrame, key: str) -> DataFrame:
    """Items of RSS texts (``xml``): title, link and date."""
    item = "struct<title: string, link: string, pubDate: string>"
    parsed = texts.select(key, F.from_xml("xml", f"channel struct<item: array<{item}>>").alias("x"))
    i = parsed.select(key, F.explode("x.channel.item").alias("i"))
    day = F.to_date(F.regexp_extract("i.pubDate", r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy")
    return i.select(key, F.col("i.title").alias("title"), F.col("i.link").alias("link"), day.alias("event_date"))


def earnings(calendar: DataFrame, relevant: DataFrame, start: str, end: str, most: int = 250) -> DataFrame:
    """Dates of relevant symbols; where nothing is known to be relevant, the first ``most``."""
    inside = calendar.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("symbol", "event_date")
    if relevant.limit(1).count():
        return inside.join(relevant.select("symbol").distinct(), "symbol", "left_semi")
    return inside.orderBy("event_date", "symbol").limit(most)


def first_tickers(news: DataFrame, n: int = 6) -> DataFrame:
    """The first tickers of each article."""
    return news.withColumn("tickers", F.slice("tickers", 1, n))


def bundle(legs: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> dict[str, tuple[DataFrame, bool]]:
    """Each leg with whether it could be read; a missing one is an empty table of dates."""
    out = {}
    for name, read in legs.items():
        try:
            out[name] = (read(), True)
        except AnalysisException:
            out[name] = (spark.createDataFrame([], "date date"), False)
    return out


#: What each kind of option source can tell.
CAPABILITIES = {"chains": {"tier": "snapshot", "aggressor": "estimated"}, "tape": {"tier": "paid", "aggressor": "reported"}}


def resolved(preferred: str | None, available: list[str], order: tuple[str, ...]) -> tuple[str, bool]:
    """The preferred source if it is there, else the first of ``order`` that is; and whether it is the preferred one."""
    if preferred in available:
        return str(preferred), True
    for name in order:
        if name in available:
            return name, False
    raise LookupError(f"none of {', '.join(order)} is available")


class Pace:
    """Spaces calls evenly: ``wait`` tells how long to wait before the next one."""

    def __init__(self, per_minute: int) -> None:
        self.gap, self.next = 60.0 / per_minute, 0.0

    def wait(self, now: float) -> float:
        delay = max(0.0, self.next - now)
        self.next = max(now, self.next) + self.gap
        return delay


def history(spark: SparkSession, paths: list[str], attempts: int = 3) -> DataFrame:
    """Price histories that lie in files, one row a bar; a path that cannot be read is tried again."""
    for attempt in range(attempts):
        try:
            return clean_bars(spark.read.parquet(*paths))
        except AnalysisException:
            if attempt + 1 == attempts:
                raise
    raise ValueError("no attempt")


def clean_bars(rows: DataFrame) -> DataFrame:
    """Prices without NaN and infinities, rows without a close dropped, one row for each symbol and date."""
    numbers = {n: clean(n) for n, t in rows.dtypes if t == "double"}
    return rows.withColumns(numbers).filter("close is not null").dropDuplicates(["symbol", "date"])
