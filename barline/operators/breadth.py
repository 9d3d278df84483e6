"""Market breadth: cross-sections by date, derived chains, regimes and events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, guarded, last_n, over_time, ratio
from ..functions.recursive import averages, span
from .series import atr, change, simple_average

# Fixed values.
AVERAGES, EMAS, EXTREME = (20, 50, 200), (5, 10, 20), 252
FAST, SLOW = 19, 39
THRUST_SPAN, THRUST_LOW, THRUST_HIGH, THRUST_BARS = 10, 0.40, 0.615, 10
SLOPE, BROAD, NARROW = 5, 60.0, 50.0
LOOKBACK, GAP, ACTIVE = 63, 10, 21

def _days():
    return Window.orderBy("date")


def _over_days(n: int):
    return _days().rowsBetween(-(n - 1), 0)


def aggregates(bars: DataFrame, extreme: int = EXTREME) -> DataFrame:
    """A1-A5: one row a date: advances, declines, volumes, shares above averages, new extremes."""
    w = averages(bars.select("symbol", "date", "close", "volume"), [(f"__e{n}", "close", span(n), n) for n in EMAS])
    w = w.withColumns(
        {
            "__chg": F.col("close") - F.lag("close").over(over_time()),
            **{f"__s{n}": simple_average("close", n) for n in AVERAGES},
            "__hi": guarded(F.max("close"), "close", last_n(extreme), extreme),
            "__lo": guarded(F.min("close"), "close", last_n(extreme), extreme),
        }
    )
    up, down, close = F.col("__chg") > 0, F.col("__chg") < 0, F.col("close")
    out = [
        count_if(up).alias("advances"),
        count_if(down).alias("declines"),
        count_if(F.col("__chg") == 0).alias("unchanged"),
        F.coalesce(F.sum(F.when(up, F.col("volume"))), F.lit(0.0)).alias("up_vol"),
        F.coalesce(F.sum(F.when(down, F.col("volume"))), F.lit(0.0)).alias("down_vol"),
    ]
    for n in AVERAGES:
        both = F.col(f"__s{n}").isNotNull() & close.isNotNull()
        out.append((100.0 * ratio(count_if(close > F.col(f"__s{n}")), count_if(both))).alias(f"pct_above_{n}"))
    for n in EMAS:
        above, both = count_if(close > F.col(f"__e{n}")), F.col(f"__e{n}").isNotNull() & close.isNotNull()
        out += [above.alias(f"n_above_{n}ema"), (100.0 * ratio(above, count_if(both))).alias(f"pct_above_{n}ema")]
    out += [
        count_if(close >= F.col("__hi")).alias("new_highs"),
        count_if(close <= F.col("__lo")).alias("new_lows"),
        count_if(F.col("__chg").isNotNull()).alias("n_symbols"),
    ]
    return w.groupBy("date").agg(*out).filter("n_symbols > 0")


def monitor(bars: DataFrame) -> DataFrame:
    """Big-move counts, their rolling ratios, momentum counts, extension above the average."""
    w = bars.withColumns(
        {
            "__r1": change("close"),
            "__r20": change("close", 20),
            "__r34": change("close", 34),
            "__r65": change("close", 65),
            "__s50": simple_average("close", 50),
        }
    )
    w = atr(w, 14, "__atr", strict=True)

    def at_least(c: str, x: float) -> Column:
        return count_if(F.col(c) >= x) if x > 0 else count_if(F.col(c) <= x)

    day = w.groupBy("date").agg(
        at_least("__r1", 0.04).alias("up4"),
        at_least("__r1", -0.04).alias("down4"),
        at_least("__r65", 0.25).alias("up25q"),
        at_least("__r65", -0.25).alias("down25q"),
        at_least("__r20", 0.25).alias("up25m"),
        at_least("__r20", -0.25).alias("down25m"),
        at_least("__r20", 0.50).alias("up50m"),
        at_least("__r20", -0.50).alias("down50m"),
        at_least("__r34", 0.13).alias("up13"),
        at_least("__r34", -0.13).alias("down13"),
        count_if(F.col("close") >= F.col("__s50") + 10 * F.col("__atr")).alias("atr_ext"),
        count_if(F.col("__r1").isNotNull()).alias("n_symbols"),
    )
    for n in (5, 10):
        w_n = _over_days(n)
        full = F.count("*").over(w_n) >= n
        day = day.withColumn(f"ratio{n}", F.when(full, ratio(F.sum("up4").over(w_n), F.sum("down4").over(w_n))))
    return day.filter("n_symbols > 0")  # after the rolling ratios (T16)


def derived(days: DataFrame) -> DataFrame:
    """Oscillator, summation, volume measures, cumulative lines, high-low index, thrust average."""
    total = F.col("advances") + F.col("declines")
    d = days.withColumns(
        {
            "rana": 1000.0 * ratio(F.col("advances") - F.col("declines"), total),
            "__share": ratio("advances", total),
            "__all": F.lit(1),
        }
    )
    d = averages(d, [("__f", "rana", span(FAST), 0), ("__s", "rana", span(SLOW), 0), ("zbt_ema", "__share", span(THRUST_SPAN), 0)], "__all")
    so_far = _days().rowsBetween(Window.unboundedPreceding, 0)
    highs = F.col("new_highs") + F.col("new_lows")
    return d.withColumns(
        {
            "mcclellan": F.col("__f") - F.col("__s"),
            "summation": 19.0 * F.col("__s") - 9.0 * F.col("__f"),  # closed form of the cumulated oscillator
            "trin": ratio(ratio("advances", "declines"), ratio("up_vol", "down_vol")),
            "vol_ratio": ratio("up_vol", "down_vol"),
            "net_up_vol": F.col("up_vol") - F.col("down_vol"),
            "ad_line": F.sum(F.col("advances") - F.col("declines")).over(so_far),
            "ad_vol_line": F.sum(F.col("up_vol") - F.col("down_vol")).over(so_far),
            "nh_nl": F.col("new_highs") - F.col("new_lows"),
            "__hl": 100.0 * ratio("new_highs", highs),
        }
    ).withColumn("hl_index", F.avg("__hl").over(_over_days(10))).drop("__f", "__s", "__share", "__all", "__hl")


def thrusts(days: DataFrame) -> DataFrame:
    """Dates on which the thrust average crosses the upper bound after a low within the bars before."""
    x, before = F.col("zbt_ema"), F.lag("zbt_ema").over(_days())
    low = F.min("zbt_ema").over(_days().rowsBetween(-THRUST_BARS, -1))
    marked = days.withColumn("__e", (x >= THRUST_HIGH) & (before < THRUST_HIGH) & (low <= THRUST_LOW))
    return marked.filter("__e").drop("__e")


def divergences(days: DataFrame, index: str, measures: list[str], lookback: int = LOOKBACK, gap: int = GAP) -> DataFrame:
    """Index extremes that a breadth measure does not confirm (``date, kind, measure``).

    The extremes and the comparison are windows; only the rule that events keep
    ``gap`` rows apart is sequential, over one measure's events.
    """
    rows = days.filter(F.col(index).isNotNull()).withColumn("__i", F.row_number().over(_days()))
    w = _over_days(lookback)
    rows = rows.withColumns(
        {"__hi": guarded(F.max(index), index, w, lookback) <= F.col(index), "__lo": guarded(F.min(index), index, w, lookback) >= F.col(index)}
    )
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("m")) for m in measures]))
    found = None
    for kind, mark, sign in (("bearish", "__hi", 1), ("bullish", "__lo", -1)):
        prior = F.last(F.when(F.col(mark), F.struct("__i", F.col(index).alias("x"), *measures)), True).over(_days().rowsBetween(Window.unboundedPreceding, -gap))
        own = rows.withColumn("__p", prior).filter(mark).filter("__p is not null").select("date", "__i", F.col(index).alias("x"), "__p", cells.alias("c"))
        before = F.coalesce(*[F.when(F.col("c.measure") == m, F.col(f"__p.{m}").cast("double")) for m in measures])
        part = own.withColumn("b", before).filter((sign * (F.col("x") - F.col("__p.x")) > 0) & (sign * (F.col("c.m") - F.col("b")) < 0))
        part = part.select("date", F.col("__i").alias("i"), F.lit(kind).alias("kind"), F.col("c.measure").alias("measure"))
        found = part if found is None else found.unionByName(part)

    def apart(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        kept, last = [], -np.inf
        for i in group["i"]:
            kept.append(i - last >= gap)
            last = i if kept[-1] else last
        return group[np.array(kept, bool)]

    return found.groupBy("kind", "measure").applyInPandas(apart, found.schema).drop("i")


def active(events: DataFrame, days: DataFrame, n: int = ACTIVE) -> DataFrame:
    """Events on one of the last n dates."""
    recent = days.select("date").orderBy(F.col("date").desc()).limit(n)
    return events.join(recent, "date", "left_semi")


def regime_labels(days: DataFrame, summation: str = "summation", pct: str = "pct_above_200") -> DataFrame:
    """HEALTHY, NEUTRAL or DETERIORATING for each date, from sign, slope and breadth."""
    s = F.col(summation)
    slope = F.coalesce(s - F.lag(summation, SLOPE).over(_days()), F.lit(0.0))  # W17
    score = (
        F.when(s > 0, 1).otherwise(-1)
        + F.when(slope > 0, 1).otherwise(-1)
        + F.when(F.col(pct) >= BROAD, 1).when(F.col(pct) < NARROW, -1).otherwise(0)
    )
    return days.withColumn("regime_score", score).withColumn("regime", F.when(score >= 3, "HEALTHY").when(score <= -2, "DETERIORATING").otherwise("NEUTRAL"))


def concentration(equal: DataFrame, weighted: DataFrame, n: int = 50) -> DataFrame:
    """On where the ratio of two closes lies above its average of span n, else off."""
    both = equal.select("date", F.col("close").alias("a")).join(weighted.select("date", F.col("close").alias("b")), "date")
    both = both.withColumns({"ratio": ratio("a", "b"), "__all": F.lit(1)}).filter("ratio is not null")
    out = averages(both, [("ema", "ratio", span(n), 0)], "__all")
    return out.select("date", "ratio", "ema", F.when(F.col("ratio") > F.col("ema"), "on").otherwise("off").alias("rotation"))


def gauges(days: DataFrame) -> DataFrame:
    """Shares of advances and of new highs, in percent."""
    return days.select(
        "date",
        (100.0 * ratio("advances", F.col("advances") + F.col("declines"))).alias("adv_pct"),
        (100.0 * ratio("new_highs", F.col("new_highs") + F.col("new_lows"))).alias("nh_pct"),
    )


def regime_state(days: DataFrame, active_events: DataFrame) -> DataFrame:
    """One row: score of the last known day with its parts, less active divergences (two at most), and the state."""
    s = F.col("summation")
    known = days.filter("summation is not null").withColumn("__d", s - F.lag(s, SLOPE).over(_days()))
    last = known.agg(F.max_by(F.struct("date", "summation", F.coalesce("__d", F.lit(0.0)).alias("slope")), "date").alias("x"))
    pct = days.filter("pct_above_200 is not null").agg(F.max_by("pct_above_200", "date").alias("p"))
    n = active_events.agg(F.count("*").alias("n_divergences"))
    one = last.crossJoin(pct).crossJoin(n).select("x.*", F.col("p").alias("pct_above_200"), "n_divergences").filter("date is not null")
    parts = {
        "level_part": F.when(s > 0, 1).otherwise(-1),
        "slope_part": F.when(F.col("slope") > 0, 1).otherwise(-1),
        "breadth_part": F.when(F.col("pct_above_200") >= BROAD, 1).when(F.col("pct_above_200") < NARROW, -1).otherwise(0),
        "divergence_part": -F.least(F.col("n_divergences"), F.lit(2)).cast("int"),
    }
    one = one.withColumns(parts).withColumn("score", sum((F.col(c) for c in parts), F.lit(0)))
    return one.withColumn("regime", F.when(F.col("score") >= 3, "HEALTHY").when(F.col("score") <= -2, "DETERIORATING").otherwise("NEUTRAL"))


#: Extremes of the oscillator, of the volume index and of the short average.
OVERSOLD, OVERBOUGHT, PANIC, EUPHORIA, WASHOUT, STRETCH, RECENT = -70.0, 70.0, 2.0, 0.5, 20.0, 85.0, 21


def extremes(days: DataFrame, state: DataFrame, thrust_dates: DataFrame) -> DataFrame:
    """One row: the last day's extremes as tags, read in the light of the regime."""
    last = days.agg(F.max_by(F.struct("mcclellan", "trin", "pct_above_20"), "date").alias("x")).select("x.*")
    recent = days.select("date").orderBy(F.col("date").desc()).limit(RECENT)
    fired = thrust_dates.join(recent, "date", "left_semi").agg(F.max("date").alias("thrust"))
    j = last.crossJoin(state.select("regime")).crossJoin(fired)
    tags = F.array(
        F.when(F.col("mcclellan") <= OVERSOLD, "oversold").when(F.col("mcclellan") >= OVERBOUGHT, "overbought"),
        F.when(F.col("trin") >= PANIC, "panic").when(F.col("trin") <= EUPHORIA, "euphoria"),
        F.when(F.col("pct_above_20") <= WASHOUT, "washout").when(F.col("pct_above_20") >= STRETCH, "stretch"),
        F.when(F.col("thrust").isNotNull(), F.concat(F.lit("thrust "), F.col("thrust").cast("string"))),
    )
    return j.select("regime", F.concat_ws(", ", F.array_compact(tags)).alias("tags"))


def tape(monitor_days: DataFrame, index: DataFrame, n: int = 60) -> DataFrame:
    """The newest n days of the monitor, newest first, beside the index's close of the same day."""
    close = index.select("date", F.col("close").alias("index_close"))
    return monitor_days.orderBy(F.col("date").desc()).limit(min(250, max(5, n))).join(close, "date", "left").orderBy(F.col("date").desc())


def dashboard(days: DataFrame, equal: DataFrame, weighted: DataFrame, n: int = 250) -> DataFrame:
    """The last n days of breadth and its chains with the concentration ratio (no value is carried)."""
    a, b = equal.select("date", F.col("close").alias("__a")), weighted.select("date", F.col("close").alias("__b"))
    tail = days.orderBy(F.col("date").desc()).limit(n)
    return tail.join(a, "date", "left").join(b, "date", "left").withColumn("concentration", ratio("__a", "__b")).drop("__a", "__b")
