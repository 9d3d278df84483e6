"""Every indicator of the screener on every bar; windows share one partitioning by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over_time, ratio
from ..functions.recursive import averages, span
from . import patterns, series

SMAS, EMAS = (20, 50, 150, 200), (5, 10, 20, 50, 100, 200)


def indicators(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars with averages, oscillators, levels, relative strength, pockets, flags, climaxes and letters.

    All exponential averages of a symbol are one grouped pass over four input columns,
    taken first, so that only the bars themselves travel with them.
    """
    before = F.lag("close").over(over_time())
    step = F.col("close") - before
    b = bars.withColumns(
        {
            "__tr": series.true_range(),
            "__gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
            "__loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
        }
    )
    specs = [(f"ema{n}", "close", span(n), n) for n in EMAS]
    specs += [("atr14", "__tr", 1 / 14, 14), ("__au", "__gain", 1 / 14, 14), ("__ad", "__loss", 1 / 14, 14)]
    b = series.aligned(averages(b, specs).drop("__tr", "__gain", "__loss"), benchmark)
    rsi = F.when((F.col("__ad") == 0) & (F.col("__au") > 0), 100.0).otherwise(100 - 100 / (1 + ratio("__au", "__ad")))
    b = b.withColumns(
        {
            "rsi14": rsi,
            "atr_pct": 100 * ratio("atr14", "close"),
            "chg_pct": 100 * series.change("close"),
            "vol_chg_pct": 100 * series.change("volume"),
            "gap_pct": 100 * (ratio("open", before) - 1),
            **{f"sma{n}": series.simple_average("close", n) for n in SMAS},
            **series.strength_columns(),
        }
    )
    b = patterns.accumulation(patterns.exhaustion(patterns.flags(patterns.golden_pocket(series.levels(series.relative_volume(b))))))
    return b.drop("__au", "__ad", "bench", "adl_dir", "accum_days", "distrib_days", "divergence", "ad_strength", "ud_ratio")
