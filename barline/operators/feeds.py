"""Feeds and stores: flow signals, alerts, news, positions, screen memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rotation import action


def flow_feed(signals: DataFrame, least: float = 0.0, classes: list[str] | None = None, direction: str | None = None, bucket: str | None = None, tickers: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Signals by conviction; naming tickers lifts the conviction-only default."""
    out = signals.filter(F.col("conviction") >= least)
    if tickers:
        out = out.filter(F.upper("underlying").isin([t.upper() for t in tickers]))
    elif classes is None:
        classes = ["conviction"]
    for name, chosen in (("classification", classes), ("direction", [direction] if direction else None), ("bucket", [bucket] if bucket else None)):
        out = out.filter(F.col(name).isin(chosen)) if chosen else out
    return out.orderBy(F.col("conviction").desc(), F.col("notional").desc()).limit(limit)


def class_counts(signals: DataFrame) -> DataFrame:
    """A13."""
    return signals.groupBy("day", "classification").agg(F.count("*").alias("n"))


def flow_totals(signals: DataFrame) -> DataFrame:
    """H1: contracts, premium by direction, size and open interest."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("notional"))), F.lit(0.0))
    return signals.agg(F.count("*").alias("n"), F.coalesce(F.sum("notional"), F.lit(0.0)).alias("premium"), side("bullish").alias("bullish"), side("bearish").alias("bearish"), F.sum("session_volume").alias("size"), F.sum("open_interest").alias("open_interest"))


def feed_order(signals: DataFrame, by: str, descending: bool = True, then: str | None = None) -> DataFrame:
    """H2: an unknown volume-to-interest ratio is infinite, other unknowns are 0 or empty."""
    rest = F.lit("") if dict(signals.dtypes)[by] == "string" else F.lit(0.0)
    key = F.coalesce(F.col(by), F.lit(float("inf")) if by == "vol_oi" else rest)
    return signals.orderBy(key.desc() if descending else key.asc(), *([then] if then else []))


def present(*columns: str) -> Column:
    """H3: how many of the columns are known."""
    return sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def alerts_summary(alerts: DataFrame, today: str) -> DataFrame:
    """Alerts of the day, how many are not acknowledged, and the rules of each symbol."""
    d = alerts.filter(F.col("date") == F.lit(today).cast("date"))
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("acked"), 1).otherwise(0)).alias("unacked"), F.array_sort(F.collect_set("rule_key")).alias("rules"))


def acknowledged(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """T-7: alerts with those of ``ids`` acknowledged."""
    known = ids.select("id").distinct().withColumn("__a", F.lit(True))
    return alerts.join(known, "id", "left").withColumn("acked", F.coalesce("__a", "acked")).drop("__a")


def pruned(alerts: DataFrame, today: str, days: int = 60) -> DataFrame:
    """T-7: alerts of the last ``days`` days."""
    return alerts.filter(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days))


def screen_memory(before: DataFrame, now: DataFrame, on: str) -> DataFrame:
    """T-8: current matches; those that matched before keep their first date, the gone ones leave."""
    old = before.select("screen_id", "symbol", "first_matched")
    return now.select("screen_id", "symbol").distinct().join(old, ["screen_id", "symbol"], "left").withColumn("first_matched", F.coalesce("first_matched", F.lit(on).cast("date")))


def sentiment(insights: DataFrame) -> DataFrame:
    """Majority label of each article; directional labels beat neutral, ties go to the first seen."""
    votes = insights.groupBy("article_id", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    some = F.max(F.when(F.col("label") != "neutral", 1).otherwise(0)).over(Window.partitionBy("article_id"))
    votes = votes.withColumn("__d", some).filter("__d = 0 or label <> 'neutral'")
    return votes.groupBy("article_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("sentiment"))


def deduplicated_news(news: DataFrame) -> DataFrame:
    """One row for each instant, publisher and set of tickers (or title without tickers), the first."""
    who = F.when(F.size("tickers") > 0, F.concat_ws(",", F.array_sort("tickers"))).otherwise(F.col("title"))
    w = Window.partitionBy("published", "publisher", "__who").orderBy("pos")
    return news.withColumn("__who", who).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__who")


def focused(news: DataFrame, focus: list[str]) -> DataFrame:
    """news that names a ticker in focus, newest first."""
    return news.filter(F.arrays_overlap("tickers", F.array(*[F.lit(x) for x in focus]))).orderBy(F.col("published").desc())


def split_calendar(events: DataFrame, today: str) -> DataFrame:
    """days until each event and whether it is upcoming."""
    days = F.datediff("event_date", F.lit(today).cast("date"))
    return events.withColumns({"days_until": days, "upcoming": days >= 0})


def newest_filing(filings: DataFrame, start: str, end: str) -> DataFrame:
    """The newest 8-K of each symbol, kept only if it lies in the range (in this order)."""
    w = Window.partitionBy("symbol").orderBy(F.col("filed").desc())
    newest = filings.filter("form = '8-K'").withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    return newest.filter(F.col("filed").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def prior_interest(interest: DataFrame, before: str) -> DataFrame:
    """The last open interest of each contract before a date."""
    return interest.filter(F.col("day") < F.lit(before).cast("date")).groupBy("option_symbol").agg(F.max_by("open_interest", "day").alias("open_interest"))


def position_signals(positions: DataFrame, sectors: DataFrame, calls: DataFrame) -> DataFrame:
    """Positions with the call of their sector's fund and what to do; WATCH where unknown."""
    j = positions.join(sectors.select("symbol", "sector_etf"), "symbol", "left").join(calls.select("sector_etf", "call"), "sector_etf", "left")
    return j.withColumn("action", action(F.coalesce("call", F.lit("WATCH"))))


def portfolio_totals(positions: DataFrame, balances: DataFrame) -> DataFrame:
    """H4: market value, open gain and liquidation value (market value where no account has one)."""
    p = positions.agg(F.sum("market_value").alias("market_value"), F.sum("open_gain").alias("open_gain"))
    b = balances.filter("liquidation_value <> 0").agg(F.sum("liquidation_value").alias("liq"))
    return p.crossJoin(b).select("market_value", "open_gain", F.coalesce("liq", "market_value").alias("liquidation_value"))


def rotating_in(calls: DataFrame) -> DataFrame:
    """H7: number of ROTATE IN calls."""
    return calls.agg(F.sum(F.when(F.col("call") == "ROTATE IN", 1).otherwise(0)).alias("n"))


def shares(risk: Column, atr: Column) -> Column:
    """H9: whole shares whose true range is the risk."""
    return F.floor(risk / F.when(atr > 0, atr))


def merged_universe(*parts: DataFrame) -> DataFrame:
    """T-11, D15: distinct symbols of all parts."""
    out = parts[0].select("symbol")
    for p in parts[1:]:
        out = out.union(p.select("symbol"))
    return out.distinct()


def release_period(events: DataFrame, observations: DataFrame) -> DataFrame:
    """A release's own month is the one before its date; the value there and in the month before."""
    e = events.withColumn("__m", F.add_months(F.trunc("event_date", "MM"), -1))
    o = observations.select("series_id", F.trunc("date", "MM").alias("__m"), "value")
    w = Window.partitionBy("series_id").orderBy("__m")
    o = o.withColumn("previous", F.lag("value").over(w))
    return e.join(o, ["series_id", "__m"], "left").withColumnRenamed("value", "actual").drop("__m")


def match_series(title: Column, keywords: list[tuple[str, str]]) -> Column:
    """Series of the first keyword that the title holds; the order of the list decides."""
    out = F.when(F.lit(False), F.lit(""))
    for word, series in keywords:
        out = out.when(F.lower(title).contains(word), series)
    return out


def merged_list(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """A list (``symbol, position``) with another one behind it; each symbol once, where it came first."""
    rows = new.select("symbol", F.lit(1).alias("part"), "position")
    if old is not None:
        rows = rows.unionByName(old.select("symbol", F.lit(0).alias("part"), "position"))
    first = rows.groupBy("symbol").agg(F.min(F.struct("part", "position")).alias("o"))
    return first.select("symbol", F.row_number().over(Window.orderBy("o")).alias("position"))  # one person's list


def unconfirmed(signals: DataFrame, before: str) -> DataFrame:
    """Signals of earlier days without a result."""
    return signals.filter(F.col("entry_exit").isNull() & (F.col("day") < F.lit(before).cast("date")))


def with_results(signals: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results (``result``) set where there was none; ``latest`` marks the newest day."""
    j = signals.join(results.select(*keys, "result"), keys, "left").withColumn("entry_exit", F.coalesce("entry_exit", "result")).drop("result")
    newest = signals.agg(F.max("day").alias("__d"))
    return j.crossJoin(newest).withColumn("latest", F.col("day") == F.col("__d")).drop("__d")


def reference_period(day: Column, kind: Column) -> Column:
    """The month or the quarter before a release's date, in words."""
    month, quarter = F.add_months(day, -1), F.add_months(day, -3)
    return F.when(kind == "month", F.date_format(month, "MMM yyyy")).otherwise(F.concat(F.lit("Q"), F.quarter(quarter), F.lit(" "), F.year(quarter)))


def relative_day(day: Column, today: str) -> Column:
    """A date as seen from today."""
    n = F.datediff(day, F.lit(today).cast("date"))
    far = F.when(n > 0, F.concat(F.lit("in "), n, F.lit(" days"))).otherwise(F.concat(-n, F.lit(" days ago")))
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").otherwise(far)
