"""Time-axis operators per symbol: windows over ``partition by symbol order by date``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import carried, col, guarded, last_n, over_time, ratio, until_now
from ..functions.recursive import averages


def change(x: Column | str, n: int = 1, key: str | list[str] = "symbol", order: str = "date") -> Column:
    """X over its value n rows ago, less one (no fill)."""
    return ratio(x, F.lag(col(x), n).over(over_time(key, order))) - 1


def simple_average(x: Column | str, n: int, key: str | list[str] = "symbol", order: str = "date") -> Column:
    """Mean of n rows, all of which must be there."""
    return guarded(F.avg(col(x)), x, last_n(n, key, order), n)


def rsi(bars: DataFrame, n: int = 14, source: str = "close", name: str = "rsi14") -> DataFrame:
    """Wilder's index; only rises give 100, no move at all NULL."""
    step = F.col(source) - F.lag(source).over(over_time())
    moved = bars.withColumns({"__up": F.greatest(step, F.lit(0.0)), "__down": F.greatest(-step, F.lit(0.0))})
    moved = moved.withColumns({c: F.when(step.isNotNull(), F.col(c)) for c in ("__up", "__down")})
    out = averages(moved, [("__au", "__up", 1 / n, n), ("__ad", "__down", 1 / n, n)])
    value = F.when((F.col("__ad") == 0) & (F.col("__au") > 0), 100.0).otherwise(100 - 100 / (1 + ratio("__au", "__ad")))
    return out.withColumn(name, value).drop("__up", "__down", "__au", "__ad")


def true_range() -> Column:
    """The widest of three ranges, missing ones skipped (the first bar has high less low)."""
    before = F.lag("close").over(over_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def strict_true_range() -> Column:
    """The same, NULL while any part is missing."""
    before = F.lag("close").over(over_time())
    return F.when(before.isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull(), true_range())


def atr(bars: DataFrame, n: int = 14, name: str = "atr14", strict: bool = False) -> DataFrame:
    """Wilder's average of the true range."""
    ranged = bars.withColumn("__tr", strict_true_range() if strict else true_range())
    return averages(ranged, [(name, "__tr", 1 / n, n)]).drop("__tr")


def simple_atr(n: int = 14) -> Column:
    """Plain mean of n strict true ranges; use as a column over a frame with ``tr``."""
    return guarded(F.avg("tr"), "tr", last_n(n), n)


def relative_volume(bars: DataFrame) -> DataFrame:
    """Ten-row average volume, and volume over the average of the row before."""
    out = bars.withColumn("avg_vol_10d", simple_average("volume", 10))
    return out.withColumn("rvol_10d", ratio("volume", F.lag("avg_vol_10d").over(over_time())))


def levels(bars: DataFrame) -> DataFrame:
    """Extremes of earlier rows, and the distance from the 252-row extremes."""
    w20, w252 = last_n(20), last_n(252)
    out = bars.withColumns(
        {
            "__h20": guarded(F.max("high"), "high", w20, 20),
            "__l20": guarded(F.min("low"), "low", w20, 20),
            "__h252": guarded(F.max("high"), "high", w252, 60),
            "__l252": guarded(F.min("low"), "low", w252, 60),
        }
    )
    shifted = {f"{n}": F.lag(c).over(over_time()) for n, c in (("high_20d", "__h20"), ("low_20d", "__l20"), ("high_252", "__h252"), ("low_252", "__l252"))}
    out = out.withColumns(shifted)
    out = out.withColumns(
        {"pct_from_52w_high": 100 * (ratio("close", "__h252") - 1), "pct_from_52w_low": 100 * (ratio("close", "__l252") - 1)}
    )
    return out.drop("__h20", "__l20", "__h252", "__l252")


def aligned(bars: DataFrame, benchmark: DataFrame, name: str = "bench") -> DataFrame:
    """The benchmark's close on the bars' dates, carried forward over its gaps."""
    days = bars.select("date").distinct().join(benchmark.select("date", F.col("close").alias("__b")), "date", "left")
    filled = days.select("date", carried("__b", Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    return bars.join(filled, "date", "left")


STRENGTH = (("rs_1m_pct", 21), ("rs_3m_pct", 63))


def strength_columns(horizons: tuple[tuple[str, int], ...] = STRENGTH) -> dict[str, Column]:
    """W12 on rows that have the benchmark's close in ``bench``."""
    return {name: 100 * (change("close", n) - change("bench", n)) for name, n in horizons}


def relative_strength(bars: DataFrame, benchmark: DataFrame, horizons: tuple[tuple[str, int], ...] = STRENGTH) -> DataFrame:
    """Change over n rows less the benchmark's, in percent."""
    return aligned(bars, benchmark).withColumns(strength_columns(horizons)).drop("bench")


def scaled(x: Column | str, window: int, centre: float, key: str | list[str] = "symbol") -> Column:
    """Distance from a centre in trailing population deviations."""
    w = last_n(window, key)
    sd = guarded(F.stddev_pop(col(x)), x, w, max(20, window // 2))
    return (col(x) - centre) / F.when(sd != 0, sd)


def z_level(x: Column | str, lookback: int = 180, least: int = 30, key: str | list[str] = "symbol") -> Column:
    """Level against its trailing mean in sample deviations."""
    w = last_n(lookback, key)
    sd = F.stddev_samp(col(x)).over(w)
    return F.when(F.count(col(x)).over(w) >= least, (col(x) - F.avg(col(x)).over(w)) / F.when(sd != 0, sd))


def z_momentum(df: DataFrame, x: str, win: int = 21, lookback: int = 180, name: str = "z_mom", key: str = "symbol") -> DataFrame:
    """The same for n-row momentum; NULL before ``win + 30`` rows."""
    out = df.withColumns({"__m": change(x, win, key), "__n": F.row_number().over(over_time(key))})
    return out.withColumn(name, F.when(F.col("__n") >= win + 30, z_level("__m", lookback, 30, key))).drop("__m", "__n")


def realized_volatility(df: DataFrame, n: int = 20, name: str = "realized_vol", key: str = "symbol") -> DataFrame:
    """Annualised sample deviation of n log returns, in percent."""
    out = df.withColumn("__r", F.log(ratio("close", F.lag("close").over(over_time(key)))))
    return out.withColumn(name, guarded(F.stddev_samp("__r"), "__r", last_n(n, key), n) * math.sqrt(252) * 100).drop("__r")


def weekly_last(df: DataFrame, key: str = "symbol") -> DataFrame:
    """The last row of each ISO week."""
    iso = [F.expr("extract(YEAROFWEEK FROM date)"), F.weekofyear("date")]
    w = Window.partitionBy(key, *iso).orderBy(F.col("date").desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def onsets(df: DataFrame, x: str = "call", key: str = "ticker") -> DataFrame:
    """Rows whose value differs from the row before (or that have none before)."""
    before = F.lag(x).over(over_time(key))
    return df.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("__b") != F.col(x))).drop("__b")


def set_onsets(df: DataFrame, matched: str = "matched", key: str = "symbol") -> Column:
    """Matched now and not in the row before; the first evaluated row counts."""
    return F.col(matched) & ~F.coalesce(F.lag(matched).over(over_time(key)), F.lit(False))


def baseline(x: Column | str, n: int = 20, key: str = "symbol") -> Column:
    """Average of the n rows before this one, zeros left out."""
    x = col(x)
    return F.avg(F.when(x != 0, x)).over(over_time(key).rowsBetween(-n, -1))


def drawdown(x: Column | str, key: str = "symbol") -> Column:
    """Distance from the running peak."""
    return ratio(x, F.max(col(x)).over(until_now(key))) - 1


def compounded(r: Column, key: str = "symbol") -> Column:
    """Running product of one plus a return (returns above -100 %)."""
    return F.exp(F.sum(F.log1p(F.coalesce(r, F.lit(0.0)))).over(until_now(key)))


def turnover(weights: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes by date (``symbol, date, weight``)."""
    step = F.abs(F.col("weight") - F.lag("weight").over(over_time()))
    return weights.withColumn("__d", F.coalesce(step, F.lit(0.0))).groupBy("date").agg((F.sum("__d") / 2).alias("turnover"))


def year_to_date(key: str = "symbol") -> Column:
    """Close over the year's first close, less one, in percent."""
    w = Window.partitionBy(key, F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return 100 * (ratio("close", F.first("close").over(w)) - 1)


def as_of(left: DataFrame, labels: DataFrame, value: str, name: str | None = None, lag_rows: int = 0, fill: object = None) -> DataFrame:
    """The last label at or before each date (optionally shifted and filled).

    Both sides meet on a date axis, so there is no inequality join: ``labels(date, value)``.
    """
    label = labels.groupBy("date").agg(F.max(value).alias("__v"))
    if lag_rows:
        label = label.withColumn("__v", F.lag("__v", lag_rows).over(Window.orderBy("date")))
    days = left.select("date").distinct().withColumn("__want", F.lit(True)).join(label, "date", "full_outer")
    filled = days.select("date", "__want", carried("__v", Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("__v"))
    value_out = F.col("__v") if fill is None else F.coalesce("__v", F.lit(fill))
    return left.join(filled.filter("__want").select("date", value_out.alias(name or value)), "date", "left")


def next_bar(events: DataFrame, calendar: DataFrame, lag_days: int = 0) -> DataFrame:
    """The first calendar row strictly after ``date + lag_days``: adds ``bar_no``.

    Event dates and calendar dates are merged on one small date axis.
    """
    wanted = events.select(F.date_add("date", lag_days).alias("__d")).distinct()
    axis = wanted.select("__d", F.lit(None).cast("int").alias("bar_no")).unionByName(calendar.select(F.col("date").alias("__d"), F.col("bar_no").cast("int").alias("bar_no")))
    by_day = axis.groupBy("__d").agg(F.min("bar_no").alias("own"))
    after = Window.orderBy("__d").rowsBetween(1, Window.unboundedFollowing)
    found = by_day.select("__d", F.min("own").over(after).alias("bar_no"))
    return events.withColumn("__d", F.date_add("date", lag_days)).join(found, "__d", "left").drop("__d")


def forward(x: Column | str, n: int, key: str = "symbol", order: str = "bar_no") -> Column:
    """The value n calendar rows ahead (on the grid)."""
    return F.lead(col(x), n).over(over_time(key, order))
