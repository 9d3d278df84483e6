"""Relative rotation: ratio and momentum of price against a benchmark, quadrants, tails and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, over_time, ratio
from ..functions.recursive import averages, span
from .series import aligned, as_of, scaled
from .wave import NONE as NO_WAVE
from .wave import signal

#: Fast, slow, difference, smoothing, trend, ratio and momentum deviations of each lens.
LENSES = {"week": (10, 40, 5, 3, 12, 52, 26), "day": (50, 140, 15, 3, 60, 140, 60)}
GAIN_RATIO, GAIN_MOMENTUM, FLAT = 4.0, 2.2, 0.30
CALL_TO_ACTION = {"ROTATE IN": "BUY", "HOLD": "HOLD", "ROTATE OUT": "SELL", "AVOID": "AVOID", "WATCH": "WATCH"}


def ratio_line(bars: DataFrame, benchmark: DataFrame, lens: str = "week") -> DataFrame:
    """G1: fast over slow average of price over benchmark, times 100 (``rs_ratio``)."""
    fast, slow, *_ = LENSES[lens]
    b = aligned(bars, benchmark).withColumn("rs", ratio("close", "bench")).filter("rs is not null")
    b = averages(b, [("__f", "rs", span(fast), 0), ("__s", "rs", span(slow), 0)])
    return b.withColumn("rs_ratio", 100 * ratio("__f", "__s")).drop("__f", "__s", "bench")


def coordinates(bars: DataFrame, benchmark: DataFrame, lens: str = "week") -> DataFrame:
    """G2 (without the wave part): ratio and momentum scaled about 100."""
    _, _, diff, smooth, _, ratio_n, momentum_n = LENSES[lens]
    b = ratio_line(bars, benchmark, lens)
    b = b.withColumn("__d", F.col("rs_ratio") - F.lag("rs_ratio", diff).over(over_time()))
    b = averages(b, [("__m", "__d", span(smooth), 0)])
    return b.withColumns(
        {
            "x": 100 + GAIN_RATIO * scaled("rs_ratio", ratio_n, 100.0),
            "y": 100 + GAIN_MOMENTUM * scaled("__m", momentum_n, 0.0),
        }
    ).drop("__d", "__m")


def quadrant(x: Column, y: Column) -> Column:
    """The boundary 100 belongs to the stronger side."""
    return F.when((x >= 100) & (y >= 100), "LEADING").when(x >= 100, "WEAKENING").when(y >= 100, "IMPROVING").when(x.isNotNull() & y.isNotNull(), "LAGGING")


def headings(points: DataFrame, tail: int = 6) -> DataFrame:
    """Heading of the last step on an 8-point compass and the path length of the tail, capped at 1."""
    w = over_time()
    p = points.withColumns({"x": F.bround("x", 3), "y": F.bround("y", 3)})
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    names = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")
    p = p.withColumns({"__step": F.hypot(dx, dy), "__at": F.degrees(F.atan2(dy, dx))})
    octant = F.pmod(F.floor((F.col("__at") + 22.5) / 45.0), F.lit(8)).cast("int")
    compass = F.element_at(F.array(*[F.lit(n) for n in names]), octant + 1)
    path = F.sum("__step").over(w.rowsBetween(-(tail - 2), 0))
    return p.withColumns(
        {
            "quadrant": quadrant(F.col("x"), F.col("y")),
            "heading": F.when(F.col("__step") < FLAT, "FLAT").otherwise(compass),
            "strength": clamp(path / 3.0, 0.0, 1.0),
        }
    ).drop("__step", "__at")


#: Weights of the conviction's parts and of the time frames, and the call thresholds.
TIMEFRAMES = {"1mo": 1.0, "1wk": 0.8, "1d": 0.5, "1h": 0.25}
W_WAVE, W_DIVERGENCE, W_ZONE, W_CLEAN, W_EXHAUSTION, W_PROFILE, W_ACCUMULATION, W_FLAG_EDGE, W_OFF = 60.0, 18.0, 15.0, 10.0, 14.0, 12.0, 13.0, 150.0, 30.0
FLAG_DEFAULT, FLAG_LEAST = {"bull": 0.58, "bear": 0.50}, 8
LOW, HIGH, ENTER, WATCH, WARN = -70.0, 99.0, 40.0, 20.0, 40.0


def _known(rows: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def conviction(rows: DataFrame) -> DataFrame:
    """Signed confluence of wave, divergences, flags, volume and regime: ``conviction`` and ``factors``.

    Needs the wave columns; other inputs count where they are there: ``mtf_1mo, mtf_1d,
    mtf_1h, flag_win_bull, flag_n_bull, flag_win_bear, flag_n_bear, regime, vol_exh,
    vp_strength, ac_strength, rotation``.
    """
    week = TIMEFRAMES["1wk"]
    get = lambda n, k="double": _known(rows, n, k)
    parts: list[tuple[str, Column]] = [("wk wave", W_WAVE * week * signal())]
    parts += [(f"{tf} wave", W_WAVE * TIMEFRAMES[tf] * get(f"mtf_{tf}")) for tf in ("1mo", "1d", "1h")]
    for name in ("div_rs", "div_px"):
        d = get(name, "string")
        parts.append((name, F.when(d == "bull", W_DIVERGENCE * week).when(d == "bear", -W_DIVERGENCE * week)))
    regime = get("regime", "string")
    for kind, sign, against in (("bull", 1, "DETERIORATING"), ("bear", -1, "HEALTHY")):
        own = F.when(get(f"flag_n_{kind}") >= FLAG_LEAST, get(f"flag_win_{kind}"))
        edge = F.greatest(F.coalesce(own, F.lit(FLAG_DEFAULT[kind])) - 0.5, F.lit(0.0))
        opposed = F.coalesce(regime == against, F.lit(False))
        parts.append((f"{kind} flag", F.when((F.col("flag") * sign > 0) & ~opposed, sign * W_FLAG_EDGE * week * edge)))
    climax = get("vol_exh", "string")
    parts.append(("exhaustion", F.when(climax == "seller", W_EXHAUSTION * week).when(climax == "buyer", -W_EXHAUSTION * week)))
    parts += [("profile", W_PROFILE * week * get("vp_strength")), ("accumulation", W_ACCUMULATION * week * get("ac_strength"))]
    zone = F.col("w4_zone")
    at_zone = (F.col("wave_label") == "wave-C") & (F.col("cur_rs") <= F.col("c_tgt_hi")) & (F.abs(zone) > 1e-9) & (F.abs(F.col("cur_rs") - zone) <= 0.10 * F.abs(zone))
    parts.append(("prior w4 zone", F.when(at_zone, W_ZONE)))
    parts = [(n, F.coalesce(c, F.lit(0.0))) for n, c in parts]
    r = rows.withColumn("__lean", sum((c for _, c in parts), F.lit(0.0)))
    clear = F.col("wv_trend").isin("up", "down") & (F.col("wave_label") != NO_WAVE) & (F.abs("__lean") > 1e-9)
    clean = F.when(clear, F.signum("__lean") * W_CLEAN).otherwise(0.0)  # by the lean before the market gate
    gate = F.when(get("rotation", "string") == "off", -W_OFF).otherwise(0.0)
    every = [*parts, ("clean count", clean), ("rotation off", gate)]
    listed = F.filter(F.array(*[F.struct(F.lit(n).alias("label"), F.bround(c, 1).alias("amount")) for n, c in every]), lambda x: F.abs(x["amount"]) > 1e-9)
    total = clamp(F.col("__lean") + clean + gate, LOW, HIGH)
    return r.withColumns({"factors": listed, "conviction": F.bround(total, 1)}).drop("__lean")


def call(enter: float = ENTER, watch: float = WATCH, warn: float = WARN) -> Column:
    """The rotation call from the wave columns and the conviction, in order of precedence."""
    trend, leg, wave, score = F.col("wv_trend"), F.col("wv_leg"), F.col("wave_label"), F.col("conviction")
    fallen = F.when(score >= enter, "ROTATE IN").when(score >= watch, "WATCH").otherwise("AVOID")
    correction = F.when(wave == "wave-A", "ROTATE OUT").when(wave == "wave-B", F.when(F.col("abc_type") == "zigzag", "ROTATE OUT").otherwise("WATCH")).when(wave == "wave-C", fallen).otherwise("WATCH")
    warning = F.when(wave == "wave-5", "⚠️ w5 extended").otherwise("⚠️ w3 extended")
    up = F.when(leg == "corrective", F.when(score >= enter, "ROTATE IN").otherwise("WATCH")).when(leg == "impulse", F.when(score <= -warn, warning).otherwise("HOLD")).otherwise("WATCH")
    down = F.when(leg == "corrective", F.when(score <= -warn, "ROTATE OUT").otherwise("AVOID")).when(leg == "impulse", "AVOID").otherwise("WATCH")
    unclear = trend.isin("none", "ambiguous") | (wave == NO_WAVE)
    return F.when(leg == "abc", correction).when(unclear, "WATCH").when(trend == "up", up).otherwise(down)


def timeline(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Conviction and call on every bar: ``symbol, date, conviction, call``; ``labels(date, rotation)`` as of each date."""
    r = as_of(rows, labels, "rotation") if labels is not None else rows
    return conviction(r).withColumn("call", call())


def action(call_: Column) -> Column:
    """What to do with a held position; extension warnings mean TRIM, unknown calls WATCH."""
    out = F.when(call_.contains("extended"), "TRIM")
    for k, v in CALL_TO_ACTION.items():
        out = out.when(call_ == k, v)
    return out.otherwise("WATCH")


def best(rows: DataFrame) -> DataFrame:
    """The setup to show: a ROTATE IN call first, then the largest conviction (0 counts as none)."""
    rank = F.coalesce(F.when(F.col("conviction") != 0, F.col("conviction")), F.lit(-1e9))
    return rows.orderBy((F.col("call") == "ROTATE IN").desc(), rank.desc(), "symbol").limit(1)


def last_points(points: DataFrame, tail: int = 6) -> DataFrame:
    """The last ``tail`` points of each symbol, newest first (``age`` 0)."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    return points.withColumn("age", F.row_number().over(w) - 1).filter(F.col("age") < tail)


def turning_scores(points: DataFrame, tail: int = 6) -> DataFrame:
    """How strongly a tail turns in and out: momentum over the tail and at its end, and distance from 100; 0 to 100."""
    w = over_time()
    p = points.withColumns({"x": F.bround("x", 3), "y": F.bround("y", 3)})
    full = F.count("y").over(w.rowsBetween(-(tail - 1), 0)) >= 2
    start = F.first("y").over(w.rowsBetween(-(tail - 1), 0))
    run, kick = F.col("y") - start, F.col("y") - F.lag("y").over(w)
    gap = F.col("x") - 100

    def score(sign: int) -> Column:
        away = F.least(F.greatest(-sign * gap, F.lit(0.0)), F.lit(3.0))
        return F.when(full, clamp(F.bround(50 + 16 * sign * run + 8 * F.greatest(sign * kick, F.lit(0.0)) + 5 * away), 0.0, 100.0)).otherwise(0.0).cast("int")

    return p.withColumns({"accumulate": score(1), "distribute": score(-1)})


def as_of_date(bars: DataFrame, day: str) -> DataFrame:
    """Bars up to a date; nothing later can be seen by what follows."""
    return bars.filter(F.col("date") <= F.lit(day).cast("date"))


def contribution_of(waves: DataFrame) -> DataFrame:
    """One number for a time frame: the wave signal and 0.4 of the combined divergence's sign; and that divergence."""
    from .wave import combined_divergence

    d = combined_divergence(F.col("div_rs"), F.col("div_px"))
    side = F.when(d == "bull", 1.0).when(d == "bear", -1.0).otherwise(0.0)
    return waves.select("symbol", "date", (signal() + 0.4 * side).alias("contrib"), d.alias("div"))


def attached(rows: DataFrame, frames: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Contributions of other time frames as of each row: ``mtf_<name>`` (0 where unknown) and ``div_<name>`` ("none").

    ``frames``: name to (``symbol, date, contrib, div``, rows by which it lags).  Both
    sides meet on one ordered axis per symbol, so there is no inequality join.
    """
    out = rows
    for name, (frame, lag_rows) in frames.items():
        own = over_time()
        known = frame.select("symbol", "date", F.struct("contrib", "div").alias("x")).withColumn("x", F.lag("x", lag_rows).over(own) if lag_rows else F.col("x"))
        axis = out.select("symbol", "date").distinct().withColumn("asked", F.lit(True)).join(known, ["symbol", "date"], "full_outer")
        seen = axis.withColumn("x", F.last("x", True).over(own.rowsBetween(Window.unboundedPreceding, 0))).filter("asked")
        seen = seen.select("symbol", "date", F.coalesce("x.contrib", F.lit(0.0)).alias(f"mtf_{name}"), F.coalesce("x.div", F.lit("none")).alias(f"div_{name}"))
        out = out.join(seen, ["symbol", "date"], "left")
    return out


def agreement(direction: Column, rs: Column, price: Column, higher: Column, lower: Column) -> Column:
    """Which readings diverge in a direction: RS line and price together, the higher and the lower time frame."""
    both = F.when((rs == direction) & (price == direction), "RS+price")
    return F.concat_ws("+", both, F.when(higher == direction, "HTF"), F.when(lower == direction, "LTF"))


def divergence_summary(rs: Column, price: Column, higher: Column, lower: Column) -> Column:
    """Every reading that diverges the same way; bullish ones first, NULL where none does."""
    named = (("RS", rs), ("price", price), ("HTF", higher), ("LTF", lower))
    say = lambda d: F.concat_ws("+", *[F.when(c == d, n) for n, c in named])
    bull, bear = say("bull"), say("bear")
    return F.when(bull != "", F.concat(F.lit("bullish: "), bull)).when(bear != "", F.concat(F.lit("bearish: "), bear))
