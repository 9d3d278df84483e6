"""Chart patterns and factors, all as windows over long bars."""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import carried, clamp, exact_sum, guarded, last_n, over_time, ratio, round_even, until_now

# Fixed values.
POLE, FLAG, POLE_MIN, RETRACE_MAX, RANGE_MAX, COOLDOWN = 10, 5, 0.06, 0.45, 0.5, 5
HORIZONS, SUCCESS = (5, 10, 20), 10
CLIMAX, EXTREME, WEAK, STRONG, VOLUME_AVERAGE = 2.0, 20, 0.4, 0.6, 20
WINDOW, BIG_DAY, CAP = 50, 1.25, 10.0
PIVOT, POCKET_LOW, POCKET_HIGH, POCKET_NEAR = 5, 0.618, 0.786, 0.5
BINS, PROFILE_BARS, VALUE_SHARE = 50, 60, 0.70


def _w():
    return over_time()


def letter(strength: Column) -> Column:
    """A to E; an unknown strength is C."""
    return F.when(strength >= 0.5, "A").when(strength >= 0.2, "B").when(strength <= -0.5, "E").when(strength <= -0.2, "D").otherwise("C")


def strength(ud: Column, direction: Column, balance: Column, divergence: Column) -> Column:
    """Signed accumulation in [-1, 1]."""
    base = F.when(ud >= 1.5, 0.5).when(ud >= 1.1, 0.25).when(ud <= 0.6, -0.5).when(ud <= 0.9, -0.25).otherwise(0.0)
    tell = F.when(divergence == "distribution", -0.3).when(divergence == "accumulation", 0.3).otherwise(0.0)
    return clamp(base + 0.2 * direction + 0.3 * balance + tell, -1.0, 1.0)


def accumulation(bars: DataFrame, distance: int = WINDOW, n: int = WINDOW) -> DataFrame:
    """up/down volume, close-in-range volume line, big days and price divergence to a letter.

    ``distance`` is how far back the two directions look: ``n`` in the panel form.
    """
    before = F.lag("close").over(_w())
    up, down = F.col("close") > before, F.col("close") < before
    span = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))
    b = bars.withColumns({"__up": F.coalesce(up, F.lit(False)), "__down": F.coalesce(down, F.lit(False)), "__pos": (F.col("close") - F.col("low")) / span})
    flow = F.coalesce(2 * F.col("__pos") - 1, F.lit(0.0)) * F.col("volume")
    b = b.withColumns(
        {
            "__av": guarded(F.avg("volume"), "volume", last_n(VOLUME_AVERAGE), VOLUME_AVERAGE),
            "__line": F.sum(flow).over(until_now()),
        }
    )
    b = b.withColumns({"__av": F.lag("__av").over(_w()), "__dir": F.signum(F.col("__line") - F.lag("__line", distance).over(_w())), "__pdir": F.signum(F.col("close") - F.lag("close", distance).over(_w()))})
    big = F.col("volume") >= BIG_DAY * F.col("__av")
    w, full = last_n(n), F.count(F.lit(1)).over(last_n(n)) >= n
    uv, dv = F.sum(F.when(F.col("__up"), F.col("volume")).otherwise(0.0)).over(w), F.sum(F.when(F.col("__down"), F.col("volume")).otherwise(0.0)).over(w)
    good = F.sum(F.when(big & F.col("__up") & (F.col("__pos") >= 0.5), 1).otherwise(0)).over(w)
    bad = F.sum(F.when(big & F.col("__down") & (F.col("__pos") <= 0.5), 1).otherwise(0)).over(w)
    ud = F.when(dv > 0, F.least(uv / dv, F.lit(CAP))).when(uv > 0, CAP).otherwise(1.0)
    b = b.withColumns({"ud_ratio": F.when(full, ud), "accum_days": F.when(full, good), "distrib_days": F.when(full, bad)})
    balance = F.coalesce(ratio(F.col("accum_days") - F.col("distrib_days"), F.col("accum_days") + F.col("distrib_days")), F.lit(0.0))
    tell = F.when((F.col("__pdir") > 0) & (F.col("__dir") < 0), "distribution").when((F.col("__pdir") < 0) & (F.col("__dir") > 0), "accumulation").otherwise("confirming")
    b = b.withColumns({"divergence": tell, "ad_strength": strength(F.col("ud_ratio"), F.col("__dir"), balance, tell)})
    shown = F.col("ud_ratio").isNotNull() & F.col("close").isNotNull() & F.col("__av").isNotNull()
    b = b.withColumn("ad_rating", F.when(shown, letter(F.col("ad_strength"))))
    return b.withColumnRenamed("__dir", "adl_dir").drop("__up", "__down", "__pos", "__av", "__line", "__pdir")


def accumulation_now(bars: DataFrame) -> DataFrame:
    """The last bar's read of each symbol with at least 70 closes; directions look 49 bars back."""
    b = accumulation(bars.filter("close is not null"), WINDOW - 1)
    last = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    b = b.withColumns({"__k": F.row_number().over(last), "__n": F.count("*").over(Window.partitionBy("symbol"))})
    return b.filter(f"__k = 1 and __n >= {WINDOW + VOLUME_AVERAGE}").select(
        "symbol", "date", F.bround("ud_ratio", 3).alias("ud_ratio"), F.col("ad_rating").alias("rating"), "adl_dir", "divergence", "accum_days", "distrib_days", "ad_strength"
    )


def exhaustion(bars: DataFrame) -> DataFrame:
    """A volume climax at a new extreme that closes against it: buyer, seller or none."""
    span = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))
    b = bars.withColumns(
        {
            "__av": guarded(F.avg("volume"), "volume", last_n(VOLUME_AVERAGE), VOLUME_AVERAGE),
            "__hi": guarded(F.max("high"), "high", last_n(EXTREME), EXTREME),
            "__lo": guarded(F.min("low"), "low", last_n(EXTREME), EXTREME),
            "__pos": (F.col("close") - F.col("low")) / span,
        }
    )
    b = b.withColumns({c: F.lag(c).over(_w()) for c in ("__av", "__hi", "__lo")})
    spike = F.col("volume") >= CLIMAX * F.col("__av")
    seller = spike & (F.col("low") <= F.col("__lo")) & (F.col("__pos") >= STRONG)
    buyer = spike & (F.col("high") >= F.col("__hi")) & (F.col("__pos") <= WEAK)
    shown = F.col("close").isNotNull() & F.col("volume").isNotNull() & F.col("__av").isNotNull() & F.col("__pos").isNotNull()
    return b.withColumn("exhaustion", F.when(shown, F.when(seller, "seller").when(buyer, "buyer").otherwise("none"))).drop("__av", "__hi", "__lo", "__pos")


def _pole(bars: DataFrame) -> DataFrame:
    w = last_n(FLAG)
    volume_full = guarded(F.avg("volume"), "volume", over_time().rowsBetween(-(FLAG + POLE - 1), -(FLAG - 1)), POLE + 1)
    return bars.withColumns(
        {
            "__b": F.lag("close", FLAG - 1).over(_w()),
            "__a": F.lag("close", FLAG - 1 + POLE).over(_w()),
            "__max": guarded(F.max("close"), "close", w, FLAG),
            "__min": guarded(F.min("close"), "close", w, FLAG),
            "__pv": volume_full,
            "__fv": guarded(F.avg("volume"), "volume", w, FLAG),
        }
    )


def flags(bars: DataFrame, taper: bool = True) -> DataFrame:
    """A strong pole, then a tight pullback on lighter volume: bull, bear or none on each bar."""
    b = _pole(bars)
    size = F.abs(F.col("__b") - F.col("__a"))
    tight = (size > 0) & ((F.col("__max") - F.col("__min")) <= RANGE_MAX * size)
    lighter = (F.col("__pv") > 0) & (F.col("__fv") < F.col("__pv")) if taper else F.lit(True)
    gain = (F.col("__b") - F.col("__a")) / F.when(F.col("__a") != 0, F.col("__a"))
    back = (F.col("__b") - F.col("close")) / F.when(size > 0, size)
    bull = tight & lighter & (gain >= POLE_MIN) & back.between(0, RETRACE_MAX)
    bear = tight & lighter & (gain <= -POLE_MIN) & (-back).between(0, RETRACE_MAX)
    shown = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__max").isNotNull()
    return b.withColumn("flag", F.when(shown, F.when(bear, "bear").when(bull, "bull").otherwise("none"))).drop("__a", "__b", "__max", "__min", "__pv", "__fv")


def flag_events(bars: DataFrame, taper: bool = True) -> DataFrame:
    """Flag bars at least ``COOLDOWN`` bars apart, with forward moves in percent.

    Candidates and forward closes are windows; only the cooldown is sequential.
    """
    b = flags(bars, taper).withColumn("__i", F.row_number().over(_w()))
    b = b.withColumns({f"fwd{h}": 100 * (ratio(F.lead("close", h).over(_w()), "close") - 1) for h in HORIZONS})
    found = b.filter("flag in ('bull', 'bear')").select("symbol", "date", F.col("flag").alias("kind"), F.col("__i").alias("i"), *[f"fwd{h}" for h in HORIZONS])

    def apart(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        kept, last = [], -(10**9)
        for i in group["i"]:
            kept.append(i - last >= COOLDOWN)
            last = i if kept[-1] else last
        return group[np.array(kept, bool)]

    return found.groupBy("symbol").applyInPandas(apart, found.schema).drop("i")


def flag_summary(events: DataFrame) -> DataFrame:
    """Count, continuation rate, mean and median move by kind and horizon."""
    long = events.select("kind", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd{h}").alias("move")) for h in HORIZONS])).alias("x")).select("kind", "x.*").filter("move is not null")
    won = F.when(F.col("kind") == "bull", F.col("move") > 0).otherwise(F.col("move") < 0)
    return long.groupBy("kind", "horizon").agg(
        F.count("*").alias("n"), F.bround(100 * F.avg(F.when(won, 1.0).otherwise(0.0)), 1).alias("success_rate"), F.bround(F.avg("move"), 2).alias("avg_move"), F.bround(F.expr("percentile(move, 0.5)"), 2).alias("median_move")
    )


def regime_allows(kind: Column, label: Column) -> Column:
    """C11: bear flags count while deteriorating, bull flags otherwise; unknown regimes admit all."""
    unknown = label.isNull() | (label == "")
    return unknown | F.when(kind == "bear", label == "DETERIORATING").otherwise(label != "DETERIORATING")


def win_rates(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per symbol and kind the share of events that went on at ``SUCCESS`` bars."""
    e = events
    if labels is not None:
        e = e.join(labels.select("date", "regime"), "date", "left").filter(regime_allows(F.col("kind"), F.col("regime")))
    e = e.filter(f"fwd{SUCCESS} is not null")
    won = F.when(F.col("kind") == "bull", F.col(f"fwd{SUCCESS}") > 0).otherwise(F.col(f"fwd{SUCCESS}") < 0)
    pairs = []
    for k in ("bull", "bear"):
        mine = F.col("kind") == k
        pairs += [F.avg(F.when(mine, F.when(won, 1.0).otherwise(0.0))).alias(k), F.count(F.when(mine, 1)).alias(f"{k}_n")]
    return e.groupBy("symbol").agg(*pairs)


def golden_pocket(bars: DataFrame, pivot: int = PIVOT) -> DataFrame:
    """Place in the retracement of the last confirmed swing leg, without lookahead."""
    left, right = over_time().rowsBetween(-pivot, -1), over_time().rowsBetween(1, pivot)
    top = (F.col("high") > guarded(F.max("high"), "high", left, pivot)) & (F.col("high") > guarded(F.max("high"), "high", right, pivot))
    low = (F.col("low") < guarded(F.min("low"), "low", left, pivot)) & (F.col("low") < guarded(F.min("low"), "low", right, pivot))
    b = bars.withColumn("__i", F.row_number().over(_w()))
    b = b.withColumns({"__t": F.when(top, F.struct(F.col("__i").alias("i"), F.col("high").alias("p"))), "__l": F.when(low, F.struct(F.col("__i").alias("i"), F.col("low").alias("p")))})
    b = b.withColumns({c: F.lag(c, pivot).over(_w()) for c in ("__t", "__l")})  # confirmed so many bars later
    b = b.withColumns({c: carried(c, until_now()) for c in ("__t", "__l")})
    leg = F.col("__t.p") - F.col("__l.p")
    valid, bullish = (leg > 0), F.col("__t.i") > F.col("__l.i")
    retrace = F.when(valid, F.when(bullish, (F.col("__t.p") - F.col("close")) / leg).otherwise((F.col("close") - F.col("__l.p")) / leg))
    b = b.withColumns({"gp_direction": F.when(valid, F.when(bullish, "bullish").otherwise("bearish")), "gp_retrace": retrace})
    r = F.col("gp_retrace")
    shallow = F.when(bullish, F.col("__t.p") - POCKET_LOW * leg).otherwise(F.col("__l.p") + POCKET_LOW * leg)
    deep = F.when(bullish, F.col("__t.p") - POCKET_HIGH * leg).otherwise(F.col("__l.p") + POCKET_HIGH * leg)
    return b.withColumns(
        {
            "gp_in_pocket": F.when(r.isNotNull(), F.when(r.between(POCKET_LOW, POCKET_HIGH), 1.0).otherwise(0.0)),
            "gp_approaching": F.when(r.isNotNull(), F.when((r >= POCKET_NEAR) & (r < POCKET_LOW), 1.0).otherwise(0.0)),
            "gp_zone_low": F.when(valid, F.least(shallow, deep)),
            "gp_zone_high": F.when(valid, F.greatest(shallow, deep)),
        }
    ).drop("__t", "__l", "__i")


def profile(bars: DataFrame, n: int = PROFILE_BARS, bins: int = BINS) -> DataFrame:
    """C14: volume at price of each symbol's last ``n`` bars: ``symbol, bin, centre, volume``.

    A bar's volume is spread over the bins its range overlaps, in proportion; a
    bar without range falls into one bin. Bins that the same bars cover whole hold
    equal volumes but for the last digits of their edges, so sums are rounded once:
    their order is then the same in every run.
    """
    recent = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    b = bars.filter("high is not null and low is not null and volume is not null").withColumn("__k", F.row_number().over(recent)).filter(f"__k <= {n}")
    whole = Window.partitionBy("symbol")
    b = b.withColumns({"__lo": F.min("low").over(whole), "__hi": F.max("high").over(whole)}).filter("__hi > __lo")
    step = (F.col("__hi") - F.col("__lo")) / bins
    edge = lambda k: F.col("__lo") + k * F.col("step")

    def weight(k: Column) -> Column:
        overlap = F.greatest(F.least(F.col("high"), edge(k) + F.col("step")) - F.greatest(F.col("low"), edge(k)), F.lit(0.0))
        point = F.when(F.least(F.lit(bins - 1), F.floor((F.col("low") - F.col("__lo")) / F.col("step"))) == k, 1.0).otherwise(0.0)
        return F.when(F.col("high") > F.col("low"), overlap).otherwise(point)

    b = b.select("symbol", "high", "low", "volume", "__lo", step.alias("step")).withColumn("__w", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), weight))
    cells = b.withColumn("__all", exact_sum("__w")).select("symbol", "volume", "__lo", "step", "__all", F.posexplode("__w").alias("bin", "w"))
    share = F.coalesce(ratio(F.col("volume") * F.col("w"), "__all"), F.lit(0.0))
    cells = cells.select("symbol", "bin", (edge(F.col("bin")) + F.col("step") / 2).alias("centre"), share.alias("v"))
    return cells.groupBy("symbol", "bin").agg(F.max("centre").alias("centre"), exact_sum(F.collect_list("v")).alias("volume"))


#: Fixed values of a profile's shape: no dominant level, lesser peaks, valleys between peaks, high and low levels, nearness of nodes.
FLAT_PEAK, PEAK_SHARE, VALLEY_SHARE, POC_HIGH, POC_LOW, NEAR_NODE = 2.0, 0.50, 0.55, 0.60, 0.40, 0.01


def _grown(v: np.ndarray, share: float) -> tuple[int, int, int]:
    """The bin with most volume and the ends of the area grown from it (ties: the first bin, and upwards)."""
    poc = int(v.argmax())
    walls = np.concatenate([[-1.0], v, [-1.0]])
    lo = hi = poc + 1
    got, want = v[poc], share * fsum(v)
    while got < want and (lo > 1 or hi < len(v)):
        up = walls[hi + 1] >= walls[lo - 1]
        hi, lo = hi + up, lo - (not up)
        got += walls[hi if up else lo]
    return poc, lo - 1, hi - 1


def _shape(v: np.ndarray, tops: np.ndarray, poc: int) -> str:
    """B with two peaks and a deep valley, trend without a dominant level, else P, b or D by the level's place."""
    high = tops[v[tops] >= PEAK_SHARE * v.max()]
    for k, a in enumerate(high):
        for b in high[k + 1 :]:
            if b > a + 1 and v[a + 1 : b].min() <= VALLEY_SHARE * min(v[a], v[b]):
                return "B"
    if v.max() / (fsum(v) / np.count_nonzero(v)) < FLAT_PEAK:
        return "trend"
    place = poc / (len(v) - 1)
    return "P" if place >= POC_HIGH else "b" if place <= POC_LOW else "D"


def value_area(cells: DataFrame, share: float = VALUE_SHARE) -> DataFrame:
    """Level with most volume, value area, shape, skew, high- and low-volume nodes of each symbol's profile.

    A symbol's 50 bins are one array; the greedy walk is a fold over it.
    """
    arrays = cells.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bin", "centre", "volume"))).alias("cells"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for symbol, cell in zip(rows["symbol"], rows["cells"], strict=True):
                x, v = np.array([c["centre"] for c in cell]), np.array([c["volume"] for c in cell])
                if not v.sum() > 0 or len(v) < 3:
                    continue
                poc, lo, hi = _grown(v, share)
                rise, fall = np.diff(v)[:-1], np.diff(v)[1:]
                tops, bottoms = np.flatnonzero((rise > 0) & (fall <= 0)) + 1, np.flatnonzero((rise < 0) & (fall >= 0)) + 1
                nodes = tops[(v[tops] >= PEAK_SHARE * v.max()) & (tops != poc)]
                total = fsum(v)
                mean = fsum(x * v) / total
                spread = fsum(v * (x - mean) ** 2) / total
                skew = fsum(v * (x - mean) ** 3) / total / spread**1.5 if spread > 0 else 0.0
                out.append((symbol, x[poc], x[lo], x[hi], poc / (len(v) - 1), _shape(v, tops, poc), skew, list(x[nodes]), list(x[bottoms])))
            yield pd.DataFrame(out, columns=["symbol", "poc", "val", "vah", "poc_position", "shape", "skew", "hvn", "lvn"])

    schema = "symbol string, poc double, val double, vah double, poc_position double, shape string, skew double, hvn array<double>, lvn array<double>"
    return arrays.mapInPandas(read, schema)


def profile_now(bars: DataFrame, areas: DataFrame) -> DataFrame:
    """The last close in its profile: zone, distance from the level, nearness of nodes, and its contribution."""
    last = bars.filter("close is not null").groupBy("symbol").agg(F.max_by("close", "date").alias("px"))
    a = areas.join(last, "symbol")
    px = F.col("px")
    near = lambda nodes: F.exists(nodes, lambda p: F.abs(px - p) <= NEAR_NODE * px)
    a = a.withColumns(
        {
            "zone": zone(px, F.col("val"), F.col("vah")),
            "poc_dist_pct": round_even(100 * (px - F.col("poc")) / F.when(F.col("poc") != 0, F.col("poc")), 2),
            "near_hvn": near(F.array_append("hvn", F.col("poc"))),
            "near_lvn": near(F.col("lvn")),
        }
    )
    lean = F.when(F.col("zone") == "discount", 0.6).when(F.col("zone") == "premium", -0.6).otherwise(0.0)
    form = F.when(F.col("shape") == "b", 0.3).when(F.col("shape") == "P", -0.3).otherwise(0.0)
    return a.withColumn("vp_strength", clamp(lean + form, -1.0, 1.0))


def accumulation_contribution(read: DataFrame) -> DataFrame:
    """C4: signed strength of the last bar's facts, and how it reads."""
    days = F.col("accum_days") + F.col("distrib_days")
    balance = F.coalesce(ratio(F.col("accum_days") - F.col("distrib_days"), days), F.lit(0.0))
    s = strength(F.coalesce("ud_ratio", F.lit(1.0)), F.coalesce("adl_dir", F.lit(0.0)), balance, F.col("divergence"))
    tag = F.when(F.col("divergence") != "confirming", F.concat(F.lit(" "), F.col("divergence"))).otherwise("")
    said = F.concat(F.lit("A/D "), F.col("rating"), F.format_string(" (U/D %.2f)", "ud_ratio"), tag)
    return read.withColumns({"ac_strength": s, "ac_label": F.when(F.abs(s) > 1e-9, said).otherwise("")})


def exhaustion_now(bars: DataFrame) -> DataFrame:
    """Each symbol's climax on its last bar; none is NULL."""
    e = exhaustion(bars).groupBy("symbol").agg(F.max_by("exhaustion", "date").alias("exhaustion"))
    return e.withColumn("exhaustion", F.when(F.col("exhaustion") != "none", F.col("exhaustion")))


def live_reads(bars: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Each symbol's current climax, profile and accumulation reads and its flag win rates."""
    profile_ = profile_now(bars, value_area(profile(bars))).select("symbol", "zone", "shape", "vp_strength")
    accumulated = accumulation_contribution(accumulation_now(bars)).select("symbol", "rating", "ac_strength")
    rates = win_rates(flag_events(bars), labels)
    out = exhaustion_now(bars).withColumnRenamed("exhaustion", "vol_exh")
    for part in (profile_, accumulated, rates.select("symbol", F.col("bull").alias("flag_win_bull"), F.col("bull_n").alias("flag_n_bull"), F.col("bear").alias("flag_win_bear"), F.col("bear_n").alias("flag_n_bear"))):
        out = out.join(part, "symbol", "left")
    return out.fillna(0, ["flag_n_bull", "flag_n_bear"])


def zone(price: Column, val: Column, vah: Column) -> Column:
    """Discount below the value area, premium above, else value."""
    return F.when(price < val, "discount").when(price > vah, "premium").otherwise("value")


def session_fraction(minutes: Column) -> Column:
    """Share of the session that has passed, at least 0.02."""
    return clamp(minutes / 390.0, 0.02, 1.0)


def live_rvol(volume: Column, average: Column, fraction: Column) -> Column:
    """today's volume against the average, prorated; NULL where either is 0."""
    return F.when((volume > 0) & (average > 0), volume / (average * fraction))


def sponsorship(ownership: DataFrame, missing: bool = False) -> DataFrame:
    """Latest institutional share and holders with changes, signed strength and score.

    A symbol without a latest share is left out unless ``missing``.
    """
    w = Window.partitionBy("symbol").orderBy(F.col("date_reported").asc_nulls_last())
    o = ownership.withColumns({"pct_prev": F.lag("pct_held").over(w), "holders_prev": F.lag("holders_count").over(w), "__k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date_reported").desc()))})
    o = o.filter("__k = 1" if missing else "__k = 1 and pct_held is not null")
    now, then = F.col("pct_held"), F.col("pct_prev")
    trend = F.when((now - then).isNull(), "unknown").when(now > then, "accumulating").when(now < then, "distributing").otherwise("flat")
    holders = F.col("holders_count") - F.col("holders_prev")
    o = o.withColumns({"trend": trend, "delta": round_even(now - then, 4), "holders_delta": holders, "pct_held": round_even(now, 4)})  # the trend is of unrounded shares
    level = F.when(F.col("pct_held") < 0.15, -0.3).when(F.col("pct_held") > 0.92, -0.2).otherwise(0.2)
    s = level + F.coalesce(clamp(F.col("delta") / 0.05, -1.0, 1.0) * 0.6, F.lit(0.0)) + F.coalesce(0.2 * F.signum(F.col("holders_delta")), F.lit(0.0))
    o = o.withColumn("inst_strength", clamp(s, -1.0, 1.0))
    return o.select("symbol", "pct_held", "delta", "holders_delta", "trend", "inst_strength", F.bround(50 + 50 * F.col("inst_strength"), 1).alias("inst_score"))
