"""Price and volume bars in long format.

``bars(symbol, date, open, high, low, close, volume)``; a symbol's hierarchy is in
``sector``.  The test tables are orders, not prices, so bars are built from order
lines: unit price, first and last by a total order of the lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import session_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame, grain: str) -> DataFrame:
    day = F.to_date("l_shipdate") if grain == "day" else F.to_date(F.date_trunc(grain, "l_shipdate"))
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    keys = [c for c in ("symbol", "sector") if c in lines.columns]
    return lines.groupBy(*keys, day.alias("date")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def _kept(spark: SparkSession, sf_dir: str, kind: str, grain: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Bars are built once in an application and kept as a table, as they would be in production."""
    return session_store(spark).once(f"bars-{kind}-{grain}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}", build)


def brand_bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    return _kept(spark, sf_dir, "brand", grain, lambda: _brand_bars(spark, sf_dir, grain))


def nation_bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    return _kept(spark, sf_dir, "nation", grain, lambda: _nation_bars(spark, sf_dir, grain))


def market_bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """The benchmark: all lines as one symbol."""
    return _kept(spark, sf_dir, "market", grain, lambda: _market_bars(spark, sf_dir, grain))


def _brand_bars(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return _bars(table(spark, sf_dir, "lineitem").select(*_LINE).join(part, "l_partkey"), grain)


def _nation_bars(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    dims = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    return _bars(table(spark, sf_dir, "lineitem").select(*_LINE).join(dims, "l_suppkey"), grain)


def _market_bars(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "lineitem").select(*_LINE).withColumn("symbol", F.lit("MKT")), grain)


def series(bars: DataFrame, symbol: str, start: str | None = None, columns: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """One symbol's rows from a date on, in order; filters and columns reach the scan."""
    out = bars.filter(F.col("symbol") == symbol)
    out = out.filter(F.col("date") >= F.lit(start).cast("date")) if start else out
    return out.select("date", *columns).orderBy("date")


def panel(bars: DataFrame, symbols: DataFrame, start: str | None = None) -> DataFrame:
    """Rows of the listed symbols (long, never pivoted)."""
    out = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return out.filter(F.col("date") >= F.lit(start).cast("date")) if start else out


def coverage(bars: DataFrame) -> DataFrame:
    """Rows and last date of each symbol."""
    return bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("date").alias("last_date"))


def keep_latest(rows: DataFrame, keys: list[str], by: Column | str) -> DataFrame:
    """S6, S42, T-4: the row with the largest ``by`` for each key (an upsert of unioned loads)."""
    by = F.col(by) if isinstance(by, str) else by
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("row"))
    return best.select(*keys, "row.*")


def grid(bars: DataFrame) -> DataFrame:
    """Every symbol on every date of the union calendar, with ``bar_no`` and ``last_bar``.

    Dense on purpose: positions count calendar rows.  The dates, one row each (a
    few thousand in any market), are numbered alone and sent to every task; a
    symbol without a bar has NULLs.
    """
    dates = bars.select("date").distinct().withColumn("bar_no", F.row_number().over(Window.orderBy("date")))
    dates = dates.withColumn("last_bar", F.max("bar_no").over(Window.partitionBy()))
    symbols = bars.select(*[c for c in ("symbol", "sector") if c in bars.columns]).distinct()
    values = bars.select("symbol", "date", "open", "high", "low", "close", "volume")
    return symbols.crossJoin(F.broadcast(dates)).join(values, ["symbol", "date"], "left")


def membership(old: DataFrame, now: DataFrame, on: str) -> DataFrame:
    """Members after a refresh: new ones appear, present ones are seen, absent ones go inactive.

    ``old(universe, symbol, first_seen, last_seen, active)``, ``now(universe, symbol)``.
    """
    day = F.lit(on).cast("date")
    here = now.select("universe", "symbol").distinct().withColumn("here", F.lit(True))
    out = old.join(here, ["universe", "symbol"], "full_outer")
    return out.select(
        "universe",
        "symbol",
        F.coalesce("first_seen", day).alias("first_seen"),
        F.when(F.col("here"), day).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("here", F.lit(False)).alias("active"),
    )


def stale(known: DataFrame, wanted: DataFrame, before: str, column: str = "updated_at") -> DataFrame:
    """Wanted symbols that are missing, failed or older than a date (anti join on the fresh ones)."""
    fresh = known.filter((F.col(column) >= F.lit(before)) & (F.coalesce(F.col("status"), F.lit("ok")) != "failed"))
    return wanted.select("symbol").distinct().join(fresh.select("symbol").distinct(), "symbol", "left_anti")
