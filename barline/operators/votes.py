"""Votes of nine domains on the market, each a row: direction, conviction, weight, whether it answered.

A domain without data gives a row with ``ok`` false, so it neither counts nor fails the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from .desk import DEFENSIVE, OFFENSIVE

#: Weights of the domains, calls that add and cut, and words of alert rules.
WEIGHTS = {"breadth": 30, "macro": 18, "rrg": 20, "rankings": 15, "canslim": 15, "news": 12, "flow": 10, "screener": 8, "themes": 6}
ADDING, CUTTING = ("ROTATE IN", "HOLD"), ("ROTATE OUT", "AVOID")
RISING = ("breakout", "building", "thrust", "gap_up", "high_break", "golden")
FALLING = ("dump", "overbought", "stretch", "gap_down", "low_break", "climax")


def sign(x: Column) -> Column:
    """1, -1, or 0 within rounding."""
    return F.when(x > 1e-9, 1).when(x < -1e-9, -1).otherwise(0)


def direction_of(x: Column) -> Column:
    """A direction given as a word or as a number in text."""
    return F.when(F.lower(x) == "bullish", 1).when(F.lower(x) == "bearish", -1).otherwise(sign(x.try_cast("double")))


def vote(row: DataFrame, domain: str, direction: Column, conviction: Column, ok: Column) -> DataFrame:
    """The vote of one row; conviction within 0 to 100."""
    good = F.coalesce(ok, F.lit(False))
    return row.select(
        F.lit(domain).alias("domain"),
        F.when(good, direction).otherwise(0).cast("int").alias("direction"),
        F.when(good, F.bround(clamp(conviction.cast("double"), 0.0, 100.0), 1)).otherwise(0.0).alias("conviction"),
        F.lit(WEIGHTS[domain]).cast("double").alias("weight"),
        good.alias("ok"),
    )


def breadth(regime: DataFrame) -> DataFrame:
    """``regime(regime, score)``: at most one row."""
    one = regime.agg(F.first("regime").alias("r"), F.first("score").alias("s"))
    d = F.when(F.col("r") == "HEALTHY", 1).when(F.col("r") == "DETERIORATING", -1).otherwise(0)
    return vote(one, "breadth", d, F.when(d != 0, 40 + 18 * F.abs(F.coalesce("s", F.lit(0)))).otherwise(20), F.col("r").isin("HEALTHY", "NEUTRAL", "DETERIORATING"))


def macro(read: DataFrame) -> DataFrame:
    """``read(equity_tilt, confidence)``."""
    one = read.agg(F.first("equity_tilt").alias("t"), F.first("confidence").alias("c"))
    return vote(one, "macro", sign(F.col("t")), F.abs("t") * 70 + F.greatest(F.lit(0), F.col("c") - 30), F.col("t").isNotNull())


def rrg(calls: DataFrame) -> DataFrame:
    """``calls(call, conviction)``: conviction of adding calls less that of cutting calls, a call."""
    good = F.col("call").isin(*ADDING) | F.col("call").contains("extended")
    side = F.when(good, 1).when(F.col("call").isin(*CUTTING), -1)
    one = calls.agg(F.sum(side * F.coalesce("conviction", F.lit(0.0))).alias("net"), F.count(side).alias("n"), F.count("*").alias("all"))
    net = F.coalesce("net", F.lit(0.0))
    return vote(one, "rrg", sign(net), F.abs(net) / F.greatest(F.lit(1), F.col("n")), F.col("all") > 0)


def rankings(board: DataFrame) -> DataFrame:
    """``board(symbol, rank)``: mean rank of offensive less that of defensive sectors."""
    mean = lambda names: F.avg(F.when(F.col("symbol").isin(*names), F.col("rank")))
    one = board.agg((mean(OFFENSIVE) - mean(DEFENSIVE)).alias("s"))
    return vote(one, "rankings", sign(F.col("s")), F.abs("s") * 1.4, F.col("s").isNotNull())


def canslim(scores: DataFrame) -> DataFrame:
    """``scores(rating)`` of the leaders."""
    one = scores.agg(F.count("*").alias("n"), F.sum(F.when(F.col("rating") >= 70, 1).otherwise(0)).alias("k"), F.coalesce(F.max("rating"), F.lit(0.0)).alias("top"))
    return vote(one, "canslim", F.when((F.col("k") >= 3) | (F.col("top") >= 65), 1).otherwise(0), F.col("k") * 11 + F.greatest(F.lit(0.0), F.col("top") - 50), F.col("n") > 0)


def flow(signals: DataFrame) -> DataFrame:
    """``signals(classification, direction, conviction, notional)`` of the last day: the strongest of the highest class."""
    best = F.col("classification") == "conviction"
    one = signals.agg(F.count("*").alias("n"), F.count(F.when(best, 1)).alias("k"), F.max(F.when(best, F.struct("conviction", "notional", "direction"))).alias("t"))
    d = F.when(F.lower("t.direction") == "bullish", 1).when(F.lower("t.direction") == "bearish", -1).otherwise(0)
    return vote(one, "flow", d, F.coalesce("t.conviction", F.least(F.lit(60.0), F.col("k") * 8.0)), F.col("n") > 0)


def news(event: DataFrame, inverted: DataFrame) -> DataFrame:
    """``event(days_until, flagged)`` of at most one row, ``inverted(inverted)`` of one row: caution only."""
    one = event.agg(F.first("days_until").alias("d"), F.first("flagged").alias("f")).crossJoin(inverted.agg(F.coalesce(F.max("inverted"), F.lit(False)).alias("i")))
    near = F.when(F.col("f"), 60).when(F.col("d").isNotNull(), F.greatest(F.lit(0), 30 - 3 * F.col("d"))).otherwise(0)
    x = near + F.when(F.col("i"), 25).otherwise(0)
    return vote(one, "news", F.when(x > 0, -1).otherwise(0), x, F.lit(True))


def screener(alerts: DataFrame) -> DataFrame:
    """``alerts(rule_key, kind)`` that are not acknowledged; words count where they stand, rising ones first."""
    text = F.lower(F.concat_ws(" ", "rule_key", "kind"))
    up, down = text.rlike("|".join(RISING)), text.rlike("|".join(FALLING))
    one = alerts.agg(F.count("*").alias("n"), F.sum(F.when(up, 1).when(down, -1).otherwise(0)).alias("net"))
    net = F.coalesce("net", F.lit(0))
    return vote(one, "screener", sign(net), F.least(F.lit(60), F.abs(net) * 6 + 15), F.lit(True))


def themes(board: DataFrame) -> DataFrame:
    """``board(rank)`` of themes: the best one's distance from the middle."""
    one = board.agg((F.max("rank") - 50).alias("s"))
    return vote(one, "themes", sign(F.col("s")), F.least(F.lit(60.0), F.abs("s") * 1.4), F.col("s").isNotNull())
