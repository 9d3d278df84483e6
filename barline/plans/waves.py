"""Queries of the wave structure; path-dependent, so they have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators import backtest, breadth, rotation, series, wave
from ..sources import bars as B
from .registry import query, rounded


def _waves(spark: SparkSession, sf: str) -> DataFrame:
    b = series.aligned(B.nation_bars(spark, sf), B.market_bars(spark, sf)).withColumn("rs", 100 * ratio("close", "bench"))
    return wave.waves(b.filter("rs is not null").select("symbol", "date", "rs", "close"))


@query("v8_waves")
def waves(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_waves(spark, sf))


@query("v10_wave_signal")
def wave_signal(spark: SparkSession, sf: str) -> DataFrame:
    w = _waves(spark, sf)
    both = wave.combined_divergence(F.col("div_rs"), F.col("div_px"))
    return rounded(w.select("symbol", "date", "wave_label", wave.signal().alias("signal"), both.alias("divergence")))


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    b, market = B.nation_bars(spark, sf), B.market_bars(spark, sf)
    labels = breadth.concentration(b.groupBy("date").agg(F.avg("close").alias("close")), market).select("date", "rotation")
    return rotation.timeline(_waves(spark, sf), labels)


@query("g13_timeline")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    t = _timeline(spark, sf)
    return rounded(t.select("symbol", "date", "wave_label", "conviction", "call", F.size("factors").alias("n_factors")))


@query("b16_event_study")
def event_study(spark: SparkSession, sf: str) -> DataFrame:
    """Forward moves after each change of call, by call and horizon."""
    g = B.grid(B.nation_bars(spark, sf))
    days = g.select("date", "bar_no").distinct()
    market = days.join(B.market_bars(spark, sf).select("date", "close"), "date", "left").select("bar_no", "close")
    changed = series.onsets(_timeline(spark, sf).select("symbol", "date", "call", "conviction"), "call", "symbol")
    entered = series.next_bar(changed, days, 4).filter("bar_no is not null").withColumnRenamed("bar_no", "entry_bar").drop("date")
    moves = backtest.forward_returns(entered, g, market)
    return rounded(backtest.forward_study(moves, ["call"]))
