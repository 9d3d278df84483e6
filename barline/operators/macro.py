"""The macro panel: named lines to their last readings, indicator rows, summaries and regime features.

A line is a series of values by name.  Each line's changes and z-scores are
windows; the last row of each is collected into one map, so that all indicators are
expressions over a single row.  Indicators whose inputs are missing are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, ratio
from . import series
from .rankings import baskets

STABLE, WATCH, TURNED, COMPLACENT = "STABLE", "WATCH", "TURNED", "COMPLACENT"
#: Members of the baskets.
GROWTH, DEFENSIVE, CYCLICAL = ("XLK", "XLY", "XLC"), ("XLU", "XLP", "XLV"), ("XLE", "XLF", "XLI")

#: Key, panel, value, unit, change, unit of the change, and the states in the order in which they
#: are tried (the last one holds otherwise).  Expressions over the readings ``<line>_<what>`` and the breadth values.
INDICATORS: tuple[tuple[str, str, str, str, str, str, tuple[tuple[str, str], ...]], ...] = (
    ("yield_curve", "leading", "curve_v", "pp", "100 * curve_d20", "bps", (("curve_v < 0", TURNED), ("curve_v < 0.25", WATCH), ("true", STABLE))),
    ("credit_spreads", "leading", "credit_v", "%", "100 * credit_d20", "bps", (("credit_v > 5.0", TURNED), ("credit_v > 3.75 or coalesce(credit_d20 > 0.5, false)", WATCH), ("true", STABLE))),
    ("sector_leadership", "leading", "lead_p63", "%", "lead_p20", "%", (("lead_z > 1.0", COMPLACENT), ("lead_z < -1.0", WATCH), ("true", STABLE))),
    ("market_breadth", "leading", "pct_above_50", "%", "null", "", (("pct_above_50 >= 60", STABLE), ("pct_above_50 >= 45", WATCH), ("true", TURNED))),
    ("volatility_vix", "leading", "vix_v", "", "vix_d20", "pts", (("vix_v < 14", COMPLACENT), ("vix_v > 28", TURNED), ("vix_v > 20", WATCH), ("true", STABLE))),
    ("market_momentum", "leading", "spy_m200", "%", "spy_p20", "%", (("spy_m200 < 0", TURNED), ("spy_m200 > 15", COMPLACENT), ("true", STABLE))),
    ("small_caps", "leading", "small_p63", "%", "small_p20", "%", (("small_z > 1.0", COMPLACENT), ("small_z < -1.0", WATCH), ("true", STABLE))),
    ("tech_leadership", "leading", "tech_p63", "%", "tech_p20", "%", (("tech_z > 1.2", COMPLACENT), ("true", STABLE))),
    ("new_highs_lows", "macro", "nh_nl", "x", "null", "", (("nh_nl >= 2", STABLE), ("nh_nl >= 1", WATCH), ("true", TURNED))),
    ("advance_decline", "macro", "adv_dec", "x", "null", "", (("adv_dec >= 1.0", STABLE), ("adv_dec >= 0.7", WATCH), ("true", TURNED))),
    ("copper_gold", "macro", "cg_v", "", "cg_p20", "%", (("cg_p20 < -4", WATCH), ("true", STABLE))),
    ("volatility_spread", "macro", "vix_v - spy_rv", "pts", "null", "", (("vix_v - spy_rv > 7", WATCH), ("vix_v - spy_rv < -2", COMPLACENT), ("true", STABLE))),
    ("yield_10y2y", "macro", "curve_v", "pp", "null", "", (("curve_v < 0", TURNED), ("true", STABLE))),
    ("vix_term_structure", "macro", "vix_v / vix3m_v", "x", "null", "", (("vix_v / vix3m_v >= 1.0", TURNED), ("true", STABLE))),
    ("jobless_claims", "macro", "claims_v / 1000", "K", "claims_d4 / 1000", "K", (("claims_v / 1000 < 260", STABLE), ("claims_v / 1000 < 300", WATCH), ("true", TURNED))),
    ("mcclellan", "macro", "mcclellan", "", "null", "", (("mcclellan <= -70", TURNED), ("mcclellan >= 70", COMPLACENT), ("true", STABLE))),
    ("hyg_spy", "macro", "hs_v", "", "hs_p20", "%", (("spy_p20 > 0 and hyg_p20 < 0", WATCH), ("spy_p20 < 0 and hyg_p20 < 0", WATCH), ("true", STABLE))),
    ("dxy", "macro", "dxy_v", "", "dxy_p20", "%", (("coalesce(dxy_z > 1.0, false) or coalesce(dxy_p20 > 2.5, false)", WATCH), ("true", STABLE))),
    ("bitcoin", "macro", "btc_v", "", "btc_p20", "%", (("coalesce(btc_z < -1.0, false) or coalesce(btc_p20 < -12, false)", WATCH), ("true", STABLE))),
)
#: Inputs of the growth and inflation axes (label, expression over the readings).
GROWTH_INPUTS = (
    ("Copper/gold", "cg_z"),
    ("Credit spreads (tight)", "-credit_zl"),
    ("Cyclicals vs defensives", "cyc_z"),
    ("Small-cap risk appetite", "small_z"),
    ("Jobless claims (falling)", "-claims_z4"),
    ("Breadth participation", "(pct_above_200 - 55) / 15.0"),
    ("Bitcoin liquidity", "btc_z"),
    ("US dollar (weaker)", "-dxy_z"),
)
INFLATION_INPUTS = (("10Y breakeven", "breakeven_zl"), ("Copper", "copper_z"), ("Energy leadership", "energy_z"), ("Gold", "gold_z"), ("US dollar (weaker)", "-dxy_z"))
LINES = ("curve", "credit", "breakeven", "claims", "vix", "vix3m", "spy", "hyg", "dxy", "btc", "copper", "gold", "lead", "cyc", "small", "tech", "energy", "cg", "hs")
READINGS = ("v", "d4", "d20", "p20", "p63", "z", "z4", "zl", "m200", "rv")
#: Price symbols of the lines (the first that has prices), and the pairs of the ratio lines.
PRICES = {"vix": ("^VIX",), "vix3m": ("^VIX3M",), "spy": ("SPY",), "hyg": ("HYG",), "dxy": ("DX-Y.NYB", "UUP"), "btc": ("BTC-USD",), "copper": ("HG=F", "CPER"), "gold": ("GC=F", "GLD")}
RATIOS = {"small": ("IWM", "SPY"), "tech": ("XLK", "SPY"), "energy": ("XLE", "SPY"), "hs": ("HYG", "SPY")}
RATES = {"curve": "T10Y2Y", "credit": "BAMLH0A0HYM2", "breakeven": "T10YIE", "claims": "ICSA"}


def lines(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """All lines (``line, date, value``) of the panel from prices (``symbol, date, close``) and series (``series_id, date, value``)."""
    p = prices.filter("close is not null").select("symbol", "date", "close")
    names = [(line, s, k) for line, symbols in PRICES.items() for k, s in enumerate(symbols)] + [(line, s, 0) for line, s in RATES.items()]
    known = prices.sparkSession.createDataFrame(names, "line string, symbol string, k int")
    both = p.withColumnRenamed("close", "value").unionByName(rates.select(F.col("series_id").alias("symbol"), "date", "value")).join(known, "symbol")
    own = both.withColumn("__k", F.min("k").over(Window.partitionBy("line"))).filter("k = __k").select("line", "date", "value")
    themes = prices.sparkSession.createDataFrame([("g", list(GROWTH)), ("d", list(DEFENSIVE)), ("c", list(CYCLICAL))], "theme string, symbols array<string>")
    named = p.unionByName(baskets(p, themes).select(F.col("theme").alias("symbol"), "date", "close"))
    pairs = [*((line, a, b) for line, (a, b) in RATIOS.items()), ("lead", "g", "d"), ("cyc", "c", "d")]
    wanted = prices.sparkSession.createDataFrame(pairs, "line string, a string, b string")
    top = named.join(wanted.select("line", F.col("a").alias("symbol")), "symbol").select("line", "date", F.col("close").alias("x"))
    base = named.join(wanted.select("line", F.col("b").alias("symbol")), "symbol").select("line", "date", F.col("close").alias("y"))
    quotients = top.join(base, ["line", "date"]).select("line", "date", ratio("x", "y").alias("value"))
    metal = own.filter("line = 'copper'").select("date", F.col("value").alias("x")).join(own.filter("line = 'gold'").select("date", F.col("value").alias("y")), "date")
    out = own.unionByName(quotients).unionByName(metal.select(F.lit("cg").alias("line"), "date", ratio("x", "y").alias("value")))
    return out.filter("value is not null")


def readings(all_lines: DataFrame) -> DataFrame:
    """One row with the last readings of every line, as columns ``<line>_<what>``."""
    w = Window.partitionBy("line").orderBy("date")
    x = series.z_momentum(all_lines, "value", 20, name="z", key="line")
    x = series.z_momentum(x, "value", 4, name="z4", key="line")
    x = series.realized_volatility(x.withColumn("close", F.when(F.col("line") == "spy", F.col("value"))), name="rv", key="line")
    back = lambda n: F.lag("value", n).over(w)
    mean = F.avg("value").over(w.rowsBetween(-199, 0))
    x = x.withColumns(
        {
            "v": F.col("value"),
            **{f"d{n}": F.col("value") - back(n) for n in (4, 20)},
            **{f"p{n}": 100 * (ratio("value", back(n)) - 1) for n in (20, 63)},
            "zl": series.z_level("value", key="line"),
            "m200": F.when(F.count("value").over(w.rowsBetween(-200, 0)) > 200, 100 * (ratio("value", mean) - 1)),
        }
    )
    last = x.groupBy("line").agg(F.max_by(F.struct(*READINGS), "date").alias("r"))
    one = last.agg(F.map_from_entries(F.collect_list(F.struct("line", "r"))).alias("m"))
    return one.select(*[F.col("m")[line][what].alias(f"{line}_{what}") for line in LINES for what in READINGS])


def indicator_rows(inputs: DataFrame) -> DataFrame:
    """A row for each indicator whose value is known: key, panel, value, change and state, in order."""
    cells = []
    for k, (key, panel, value, unit, change, change_unit, states) in enumerate(INDICATORS):
        state = F.expr("case " + " ".join(f"when {test} then '{name}'" for test, name in states) + " end")
        cells.append(
            F.struct(
                F.lit(k).alias("place"), F.lit(key).alias("key"), F.lit(panel).alias("panel"), F.bround(F.expr(value).cast("double"), 3).alias("value"), F.lit(unit).alias("unit"),
                F.bround(F.expr(change).cast("double"), 2).alias("delta"), F.lit(change_unit).alias("delta_unit"), state.alias("state"),
            )
        )
    return inputs.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("value is not null")


def panel_summary(rows: DataFrame) -> DataFrame:
    """By panel: rows, cautious ones, complacent ones, and how the panel reads as a whole."""
    s = rows.groupBy("panel").agg(F.count("*").alias("n"), F.sum(F.when(F.col("state") != STABLE, 1).otherwise(0)).alias("n_caution"), F.sum(F.when(F.col("state") == COMPLACENT, 1).otherwise(0)).alias("n_complacent"))
    mostly = (F.col("n_complacent") >= 2) & (F.col("n_complacent") >= F.col("n_caution") - 1)
    return s.withColumn("reading", F.when(F.col("n_caution") == 0, "healthy").when(mostly, "complacent").otherwise("mixed"))


def _axis(inputs: tuple[tuple[str, str], ...]) -> Column:
    cells = F.array(*[F.struct(F.lit(label).alias("label"), clamp(F.expr(e), -3.0, 3.0).alias("z")) for label, e in inputs])
    return F.filter(cells, lambda c: c["z"].isNotNull())


def regime_features(inputs: DataFrame) -> DataFrame:
    """Mean z-scores of growth and inflation (0 where nothing is known) and the three strongest inputs."""
    x = inputs.select(_axis(GROWTH_INPUTS).alias("g"), _axis(INFLATION_INPUTS).alias("i"))
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, e: a + e["z"]) / F.size(c)).otherwise(0.0)
    ranked = F.sort_array(F.transform(F.concat("g", "i"), lambda e, k: F.struct(F.abs(F.bround(e["z"], 2)).alias("a"), (-k).alias("k"), e["label"].alias("label"))), asc=False)
    return x.select(F.bround(mean("g"), 3).alias("growth_z"), F.bround(mean("i"), 3).alias("inflation_z"), F.concat_ws(" · ", F.transform(F.slice(ranked, 1, 3), lambda e: e["label"])).alias("driver"))
