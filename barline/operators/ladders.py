"""Rotation trades on the calendar grid: entries at calls, forced exits, take-profit ladders, books and referees.

``calls(symbol, date, call, conviction)`` become acts on the grid: the first bar after
the date on which a change of call is known.  What a trade may meet is written out
as bar numbers and joined; only the rule that trades of a symbol do not overlap is
sequential, over its few candidates.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over_time, ratio
from ..sources.store import settled
from . import series

#: Calls that end a trade; remaining size after late calls; multiples of the entry leg and bars back for its low.
ENDING = ("ROTATE OUT", "AVOID")
CEILINGS = {"⚠️ w3 extended": 0.8, "⚠️ w5 extended": 0.6, "ROTATE OUT": 0.4, "AVOID": 0.2}
MULTIPLES, LEG_BARS = (0.618, 1.0, 1.618, 2.0, 2.618), 20
LADDERS = ("full", "calls", "post_out", "fib")
EXIT = {"model": "signal", "hold_days": 10, "max_hold": 40, "atr_stop": 2.0, "atr_target": 3.0}
PORTFOLIO = {"mode": "long_short", "n_long": 3, "n_short": 3, "gate": True}
MODES = ("long_short", "long_only", "short_only", "long_hedged")
LAG_DAYS = {"1d": 0, "1wk": 4}


def exit_config(raw: dict[str, Any] | None = None) -> dict[str, Any]:
    """Known exit settings over the defaults, within bounds."""
    c = EXIT | {k: v for k, v in (raw or {}).items() if k in EXIT}
    model = c["model"] if c["model"] in ("signal", "hold", "atr") else "signal"
    return {"model": model, **{k: max(1, int(c[k])) for k in ("hold_days", "max_hold")}, **{k: float(c[k]) for k in ("atr_stop", "atr_target")}}


def portfolio_config(raw: dict[str, Any] | None = None) -> dict[str, Any]:
    """The same for a portfolio."""
    c = PORTFOLIO | {k: v for k, v in (raw or {}).items() if k in PORTFOLIO}
    mode = c["mode"] if c["mode"] in MODES else PORTFOLIO["mode"]
    return {"mode": mode, **{k: max(1, int(c[k])) for k in ("n_long", "n_short")}, "gate": bool(c["gate"])}


def acts(calls: DataFrame, grid: DataFrame, lag_days: int = 0) -> DataFrame:
    """Changes of call at the first bar after they are known: ``symbol, bar_no, call, conviction, last_bar``."""
    days = grid.select("date", "bar_no").distinct()
    placed = series.next_bar(series.onsets(calls, "call", "symbol"), days, lag_days).filter("bar_no is not null")
    last = grid.agg(F.max("bar_no").alias("last_bar"))
    return placed.crossJoin(last).select("symbol", F.col("bar_no").cast("int").alias("bar_no"), "date", "call", "conviction", "last_bar")


def candidates(acts_: DataFrame, grid: DataFrame) -> DataFrame:
    """Every ROTATE IN at its bar's open, with the bar of the first ending call after it and the true range before it."""
    w = Window.partitionBy("symbol").orderBy("date")
    later = F.first(F.when(F.col("call").isin(*ENDING), F.col("bar_no")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = acts_.withColumn("ended", later).filter("call = 'ROTATE IN'").drop("date", "call")
    g = grid.select("symbol", "bar_no", "open", "high", "low", "close")
    own = over_time(order="bar_no")
    before = F.lag("close").over(own)
    true_range = F.when(F.col("high").isNotNull() & F.col("low").isNotNull() & before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    g = g.withColumn("tr", true_range)
    full = over_time(order="bar_no").rowsBetween(-14, -1)
    g = g.withColumns({"atr0": F.when(F.count("tr").over(full) >= 14, F.avg("tr").over(full)), "leg_low": F.min("low").over(own.rowsBetween(-LEG_BARS, -1))})
    j = found.join(g.select("symbol", "bar_no", F.col("open").alias("entry_px"), "atr0", "leg_low"), ["symbol", "bar_no"]).filter("entry_px > 0")
    return j.select("symbol", F.col("bar_no").alias("entry_bar"), "entry_px", "conviction", "atr0", "leg_low", F.coalesce("ended", "last_bar").alias("forced"), F.col("ended").isNotNull().alias("by_call"), "last_bar")


def _path(trades: DataFrame, grid: DataFrame) -> DataFrame:
    """The bars of each trade from entry to ``end_bar``."""
    each = trades.withColumn("bar_no", F.explode(F.sequence("entry_bar", "end_bar")))
    return each.join(grid.select("symbol", "bar_no", "open", "high", "low", "close"), ["symbol", "bar_no"])


def simulated(found: DataFrame, grid: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """Candidates with their exits, those that begin after the last one of their symbol has ended."""
    c = exit_config(config)
    hard = F.least(F.col("entry_bar") + c["max_hold"], F.col("last_bar"))
    t = found.withColumn("hard", hard)
    ranged = F.coalesce(F.col("atr0") > 0, F.lit(False)) if c["model"] == "atr" else F.lit(False)
    limit = F.least(F.col("entry_bar") + c["hold_days"] - 1, F.col("hard")) if c["model"] == "hold" else F.least("hard", "forced")
    p = _path(t.withColumns({"end_bar": F.greatest(limit, F.col("entry_bar")), "ranged": ranged}), grid)
    stop, goal = F.col("entry_px") - c["atr_stop"] * F.col("atr0"), F.col("entry_px") + c["atr_target"] * F.col("atr0")
    stopped, won = F.coalesce(F.col("ranged") & (F.col("low") <= stop), F.lit(False)), F.coalesce(F.col("ranged") & (F.col("high") >= goal), F.lit(False))
    ends, called = F.col("bar_no") == F.col("end_bar"), F.col("by_call") & (F.col("end_bar") == F.col("forced"))
    at_open = F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("close"))
    if c["model"] == "hold":
        px, why = F.col("close"), F.when(F.col("end_bar") == F.col("entry_bar") + c["hold_days"] - 1, "hold").otherwise("eod")
    else:
        last = F.when(F.col("ranged"), F.col("close")).otherwise(at_open)
        px = F.when(stopped, F.least("open", stop)).when(won, F.greatest("open", goal)).otherwise(last)
        capped = F.when(F.col("ranged") | ((F.col("end_bar") == F.col("hard")) & (F.col("hard") < F.col("forced"))), "cap").otherwise("eod")
        why = F.when(stopped, "stop").when(won, "target").when(called, "signal").otherwise(capped)
    hit = F.struct(F.col("bar_no").alias("exit_bar"), px.alias("exit_px"), why.alias("exit_reason"))
    one = p.groupBy("symbol", "entry_bar", "entry_px", "conviction").agg(F.min(F.when(stopped | won | ends, hit)).alias("x"), F.collect_list(F.struct("bar_no", "high", "low")).alias("path"))
    held = F.filter("path", lambda b: b["bar_no"] <= F.col("x.exit_bar"))
    extreme = lambda f, c_: 100 * (f(F.transform(held, lambda b: b[c_])) / F.col("entry_px") - 1)
    done = one.filter("x.exit_px > 0").select("symbol", "entry_bar", "entry_px", "x.*", extreme(F.array_max, "high").alias("mfe_pct"), extreme(F.array_min, "low").alias("mae_pct"))

    def apart(group: pd.DataFrame) -> pd.DataFrame:
        kept, last_exit = [], -1
        for row in group.sort_values("entry_bar").itertuples():
            kept.append(row.entry_bar > last_exit)
            last_exit = row.exit_bar if kept[-1] else last_exit
        return group.sort_values("entry_bar")[kept]

    free = done.groupBy("symbol").applyInPandas(apart, done.schema)
    return free.withColumns({"return_pct": 100 * (F.col("exit_px") / F.col("entry_px") - 1), "bars_held": F.col("exit_bar") - F.col("entry_bar") + 1})


def contributions(trades: DataFrame) -> DataFrame:
    """By symbol the sum of returns, its place, and the share of all that the best ones up to it have."""
    r = F.col("return_pct")
    s = trades.filter("return_pct is not null").groupBy("symbol").agg(F.count("*").alias("n_trades"), F.sum(r).alias("total_return"), F.avg(r).alias("avg_return"), (100 * F.avg(F.when(r > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.max(r).alias("best"), F.min(r).alias("worst"))
    order = Window.orderBy(F.col("total_return").desc(), "symbol")  # a row for each symbol
    all_ = F.sum("total_return").over(Window.partitionBy())
    up_to = F.sum("total_return").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumns({"place": F.row_number().over(order), "top_share": 100 * up_to / F.when(all_ != 0, all_)})


def matched_curve(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beside a curve (``bar_no, date, ret, n_held``) the benchmark's, and the benchmark's on invested days only, over the curve's invested span."""
    o = Window.orderBy("bar_no")
    inside = curve.filter("n_held > 0").agg(F.min("bar_no").alias("a"), F.max("bar_no").alias("b"))
    c = curve.join(benchmark.select("bar_no", F.col("close").alias("__c")), "bar_no", "left").crossJoin(inside).filter("bar_no between a - 1 and b")
    c = c.withColumn("__c", F.last("__c", True).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    r = F.coalesce(ratio("__c", F.lag("__c").over(o)) - 1, F.lit(0.0))
    c = c.withColumns({"bench_ret": r, "matched_ret": F.when(F.col("n_held") > 0, r).otherwise(0.0)})
    so_far = o.rowsBetween(Window.unboundedPreceding, 0)
    grown = {f"{n}_equity": F.exp(F.sum(F.log1p(f"{n}_ret")).over(so_far)) for n in ("bench", "matched")}
    return c.withColumns(grown).drop("__c", "a", "b")


def states(calls: DataFrame, grid: DataFrame) -> DataFrame:
    """The last known call and conviction of each symbol on every bar from its first call on."""
    g = grid.select("symbol", "date", "bar_no").join(calls.select("symbol", "date", F.struct("call", "conviction").alias("x")), ["symbol", "date"], "left")
    known = g.withColumn("x", F.last("x", True).over(over_time().rowsBetween(Window.unboundedPreceding, 0)))
    return known.filter("x is not null").select("symbol", "date", "bar_no", "x.call", "x.conviction")


def rotation_portfolio(panel: DataFrame, grid: DataFrame, benchmark: DataFrame, config: dict[str, Any] | None = None, gate: DataFrame | None = None) -> DataFrame:
    """By bar the returns of the long leg, the short leg, their spread, and the long leg hedged with the benchmark.

    Legs are the best ROTATE INs and the worst ROTATE OUTs of a bar, equally
    weighted; they earn the next bar's move.  ``gate(date, rotation)``: flat where off.
    """
    c = portfolio_config(config)
    allowed = panel
    if c["gate"] and gate is not None:
        labelled = series.as_of(panel, gate, "rotation")
        allowed = labelled.filter(F.coalesce(F.col("rotation") != "off", F.lit(True))).drop("rotation")
    legs = []
    for side, call, n, order in ((1, "ROTATE IN", c["n_long"], F.col("conviction").desc()), (-1, "ROTATE OUT", c["n_short"], F.col("conviction").asc())):
        w = Window.partitionBy("bar_no").orderBy(order, "symbol")
        top = allowed.filter((F.col("call") == call) & F.col("conviction").isNotNull()).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
        legs.append(top.select("symbol", (F.col("bar_no") + 1).alias("bar_no"), F.lit(side).alias("side"), (1 / F.count("*").over(Window.partitionBy("bar_no"))).alias("weight")))
    own = over_time(order="bar_no")
    moves = grid.select("symbol", "bar_no", (ratio("close", F.lag("close").over(own)) - 1).alias("r"))
    j = legs[0].unionByName(legs[1]).join(moves, ["symbol", "bar_no"])
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("weight") * F.coalesce("r", F.lit(0.0))).otherwise(0.0))
    count = lambda s: F.count(F.when(F.col("side") == s, 1))
    day = j.groupBy("bar_no").agg(part(1).alias("long_ret"), part(-1).alias("short_ret"), count(1).alias("n_long"), count(-1).alias("n_short"))
    o = Window.orderBy("bar_no")
    days = grid.select("bar_no", "date").distinct().join(benchmark.select("bar_no", F.col("close").alias("b")), "bar_no", "left")
    days = days.withColumn("b", F.last("b", True).over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("bench_ret", ratio("b", F.lag("b").over(o)) - 1).drop("b")
    out = days.join(day, "bar_no", "left").fillna(0.0, ["long_ret", "short_ret"]).fillna(0, ["n_long", "n_short"])
    hedge = F.when(F.col("n_long") > 0, F.coalesce("bench_ret", F.lit(0.0))).otherwise(0.0)
    out = out.withColumns({"spread_ret": F.col("long_ret") - F.col("short_ret"), "hedged_ret": F.col("long_ret") - hedge})
    chosen = {"long_only": F.col("long_ret"), "short_only": -F.col("short_ret"), "long_hedged": F.col("hedged_ret")}.get(c["mode"], F.col("spread_ret"))
    return out.withColumn("ret", chosen)


def ladder_entries(acts_: DataFrame, grid: DataFrame, max_hold: int) -> DataFrame:
    """ROTATE INs whose trades end before the next one of their symbol: the same for every ladder."""
    w = Window.partitionBy("symbol").orderBy("entry_bar")
    c = candidates(acts_, grid)
    ins = acts_.filter("call = 'ROTATE IN'").select("symbol", F.col("bar_no").alias("entry_bar"))
    following = ins.withColumn("next_bar", F.lead("entry_bar").over(w))
    t = c.join(following, ["symbol", "entry_bar"])
    end = F.least(F.col("entry_bar") + max_hold, F.coalesce(F.col("next_bar") - 1, F.col("last_bar")), F.col("last_bar"))
    return t.withColumn("end_bar", end).filter("end_bar > entry_bar")


def schedule(trades: DataFrame, acts_: DataFrame, grid: DataFrame, ladder: str) -> DataFrame:
    """Sales of each trade: ``symbol, entry_bar, bar_no, frac, px``; fractions of a trade sum to 1.

    ``full`` sells at the first ending call; ``calls`` trims to each later call's
    ceiling; ``post_out`` sells a fifth a bar once an ending call came; ``fib`` sells a
    fifth at each multiple of the entry leg.  What is left goes at the end.
    """
    key = ["symbol", "entry_bar"]
    bars = _path(trades, grid).filter("bar_no > entry_bar").withColumn("fill", F.when(F.col("close") > 0, F.col("close")).otherwise(F.col("open")))
    events = trades.select(*key, "end_bar").join(acts_.select("symbol", "bar_no", "call", "date"), "symbol").filter("bar_no > entry_bar and bar_no <= end_bar")
    first = events.filter(F.col("call").isin(*ENDING)).groupBy(*key).agg(F.min("bar_no").alias("out_bar"))
    t = trades.join(first, key, "left").withColumn("stop_bar", F.coalesce("out_bar", "end_bar"))
    rest = F.lit(1.0)
    if ladder == "calls":
        ceiling = F.when(F.lit(False), 1.0)
        for call, x in CEILINGS.items():
            ceiling = ceiling.when(F.col("call") == call, x)
        w = Window.partitionBy(*key).orderBy("bar_no", "date")
        e = events.withColumn("__c", ceiling).filter("__c is not null")
        e = e.withColumn("left", F.min("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        e = e.withColumn("frac", F.coalesce(F.lag("left").over(w), F.lit(1.0)) - F.col("left")).filter("frac > 1e-9")
        sold = e.select(*key, "bar_no", "frac", F.lit(None).cast("double").alias("goal"))
        final = "end_bar"
    elif ladder == "post_out":
        four = t.filter("out_bar is not null").select(*key, "end_bar", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("out_bar") + k)).alias("bar_no"))
        sold = four.filter("bar_no < end_bar").select(*key, "bar_no", F.lit(0.2).alias("frac"), F.lit(None).cast("double").alias("goal"))
        t = t.withColumn("final_bar", F.when(F.col("out_bar").isNull(), F.col("end_bar")).otherwise(F.least(F.col("out_bar") + 4, F.col("end_bar"))))
        final = "final_bar"
    elif ladder == "fib":
        leg = F.col("entry_px") - F.col("leg_low")
        goals = t.filter(leg > 0).select(*key, "stop_bar", F.explode(F.array(*[F.col("entry_px") + m * leg for m in MULTIPLES])).alias("goal"))
        met = goals.join(bars.select(*key, "bar_no", "high"), key).filter("bar_no <= stop_bar and high >= goal")
        sold = met.groupBy(*key, "goal").agg(F.min("bar_no").alias("bar_no")).select(*key, "bar_no", F.lit(0.2).alias("frac"), "goal")
        final = "stop_bar"
    elif ladder == "full":
        sold = None
        final = "stop_bar"
    else:
        raise ValueError(ladder)
    if sold is not None:
        t = t.join(sold.groupBy(*key).agg(F.sum("frac").alias("sold")), key, "left")
        rest = 1.0 - F.coalesce("sold", F.lit(0.0))
    tail = t.select(*key, F.col(final).alias("bar_no"), rest.alias("frac"), F.lit(None).cast("double").alias("goal")).filter("frac > 1e-9")
    every = tail if sold is None else sold.unionByName(tail)
    return every.join(bars.select(*key, "bar_no", "fill"), [*key, "bar_no"], "left").select(*key, "bar_no", "frac", F.coalesce("goal", "fill").alias("px"))


def scaled_trades(trades: DataFrame, sales: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a trade (and ``by``): blended return, last bar, sales in order; trades with an unpriced sale are left out."""
    by = by or []
    j = sales.join(trades.select("symbol", "entry_bar", "entry_px"), ["symbol", "entry_bar"])
    one = j.groupBy(*by, "symbol", "entry_bar", "entry_px").agg(
        F.sum(F.col("frac") * (F.col("px") / F.col("entry_px") - 1)).alias("r"), F.max("bar_no").alias("exit_bar"), F.min(F.coalesce(F.col("px") > 0, F.lit(False))).alias("ok"), F.collect_list(F.struct("bar_no", "frac")).alias("steps")
    )
    return one.filter("ok").select(*by, "symbol", "entry_bar", "exit_bar", (100 * F.col("r")).alias("return_pct"), (F.col("exit_bar") - F.col("entry_bar") + 1).alias("bars_held"), "steps")


def scaled_curve(trades: DataFrame, grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By bar the mean move of what is still held, weighted by what is left of each trade with a known move."""
    by = by or []
    days = trades.select(*by, "symbol", "steps", F.explode(F.sequence(F.col("entry_bar") + 1, F.col("exit_bar"))).alias("bar_no"))
    gone = F.aggregate(F.filter("steps", lambda s: s["bar_no"] < F.col("bar_no")), F.lit(0.0), lambda a, s: a + s["frac"])
    held = days.withColumn("w", 1.0 - gone).filter("w > 1e-9")
    own = over_time(order="bar_no")
    moves = grid.select("symbol", "bar_no", (ratio("close", F.lag("close").over(own)) - 1).alias("r"))
    j = held.join(moves, ["symbol", "bar_no"])
    day = j.groupBy(*by, "bar_no").agg((F.coalesce(F.sum(F.col("w") * F.col("r")), F.lit(0.0)) / F.sum(F.when(F.col("r").isNotNull(), F.col("w")))).alias("ret"), F.count("*").alias("n_held"))
    ends = trades.groupBy(*by).agg(F.min("entry_bar").alias("a"), F.max("exit_bar").alias("b"))
    span = ends.withColumn("bar_no", F.explode(F.sequence("a", "b"))).select(*by, "bar_no").join(grid.select("bar_no", "date").distinct(), "bar_no")
    c = span.join(day, [*by, "bar_no"], "left").select(*by, "bar_no", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("n_held", F.lit(0)).alias("n_held"))
    o = Window.partitionBy(*by).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(o))).withColumn("drawdown", F.col("equity") / F.max("equity").over(o) - 1)


def scaled_performance(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As a plain curve's, with the population deviation in the Sharpe ratio."""
    sd = F.stddev_pop("ret")
    last, n = F.max_by("equity", "bar_no"), F.count("*")
    return curve.groupBy(*(by or [])).agg(
        (100 * (last - 1)).alias("total_return"), (100 * (F.pow(last, 252.0 / n) - 1)).alias("cagr"), (100 * F.min("drawdown")).alias("max_drawdown"),
        (F.avg("ret") / F.when(sd > 0, sd) * F.sqrt(F.lit(252.0))).alias("sharpe"), (100 * F.avg(F.when(F.col("n_held") > 0, 1.0).otherwise(0.0))).alias("in_market"),
    )


def ladder_trades(acts_: DataFrame, grid: DataFrame, max_hold: int = 40) -> DataFrame:
    """The same entries sold by each ladder: one row for each ladder and trade."""
    entries = settled(ladder_entries(acts_, grid, max_hold), "ladder-entries")
    sales = None
    for ladder in LADDERS:
        part = schedule(entries, acts_, grid, ladder).withColumn("ladder", F.lit(ladder))
        sales = part if sales is None else sales.unionByName(part)
    return settled(scaled_trades(entries, sales, ["ladder"]), "ladder-trades")


def compared(acts_: DataFrame, grid: DataFrame, max_hold: int = 40) -> tuple[DataFrame, DataFrame]:
    """The ladders over the same entries: a row each with the marks of the best, and their curves (``ladder, date, equity``)."""
    trades = ladder_trades(acts_, grid, max_hold)
    curve = scaled_curve(trades, grid, ["ladder"])
    stats = trades.groupBy("ladder").agg(F.count("*").alias("n_trades"), F.avg("return_pct").alias("avg_return"), (100 * F.avg(F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0))).alias("win_rate"))
    table = scaled_performance(curve, ["ladder"]).join(stats, "ladder")
    whole = Window.partitionBy()
    best = {f"best_{n}": F.col(n) == F.max(n).over(whole) for n in ("total_return", "max_drawdown", "sharpe")}
    return table.withColumns(best), curve.select("ladder", "date", "equity")


def walk_forward(records: DataFrame, n_bars: Column | int, folds: int = 4, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """By fold the parameter set with the widest separation so far and its separation after; by set its mean separation after.

    ``records(combo, call, entry_bar, excess)`` at the horizon of the separation; a set
    is separated by the mean excess of ROTATE IN less that of ROTATE OUT, if both
    have ``least`` records.  Ties go to the smaller combo.
    """
    n = F.lit(n_bars) if isinstance(n_bars, int) else n_bars
    r = records.filter(F.col("call").isin("ROTATE IN", "ROTATE OUT") & F.col("excess").isNotNull()).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    mark = lambda k: F.least(F.floor(n * k / (folds + 1)) + 1, n)  # noqa: E731  bars are counted from 1
    r = r.withColumns({"lo": mark(F.col("fold")), "hi": mark(F.col("fold") + 1)})
    before, after = F.col("entry_bar") <= F.col("lo"), (F.col("entry_bar") > F.col("lo")) & (F.col("entry_bar") <= F.col("hi"))

    def apart(inside: Column) -> Column:
        side = lambda c: F.when(inside & (F.col("call") == c), F.col("excess"))
        a, b = side("ROTATE IN"), side("ROTATE OUT")
        return F.when((F.count(a) >= least) & (F.count(b) >= least), F.avg(a) - F.avg(b))

    scored = r.groupBy("fold", "combo").agg(apart(before).alias("is_sep"), apart(after).alias("oos_sep"))
    best = Window.partitionBy("fold").orderBy(F.col("is_sep").desc_nulls_last(), "combo")
    rows = scored.withColumn("k", F.row_number().over(best)).filter("k = 1 and is_sep is not null").select("fold", "combo", "is_sep", "oos_sep")
    chosen = rows.select("fold").join(scored, "fold").groupBy("combo").agg(F.avg("oos_sep").alias("mean_oos"), F.count("oos_sep").alias("n_folds")).filter("mean_oos is not null")
    return rows, chosen.withColumn("recommended", F.row_number().over(Window.orderBy(F.col("mean_oos").desc(), "combo")) == 1)


def harness_calls(calls: DataFrame, ranks: DataFrame, stances: DataFrame) -> DataFrame:
    """Calls from the confluence of a rotation call and the day's rank under the stance of the date.

    ``ranks(symbol, date, rank)``, ``stances(date, stance)`` as of each date.
    """
    from . import scores

    j = series.as_of(calls, stances, "stance").join(ranks.select("symbol", "date", "rank"), ["symbol", "date"], "left")
    good = F.col("call").isin("ROTATE IN", "HOLD") | F.col("call").contains("extended")
    sign = F.when(good, 1).when(F.col("call").isin(*ENDING), -1).otherwise(0)
    base = sign * F.coalesce("conviction", F.lit(0.0)) * F.when(F.col("stance") == "CONCENTRATE", 0.5).otherwise(1.0)
    agree = F.coalesce((sign != 0) & ((sign > 0) == (F.col("rank") >= 50)), F.lit(False))
    score = F.bround((base + F.coalesce((F.col("rank") - 50) * 0.6, F.lit(0.0))) * F.when(agree, 1.25).otherwise(1.0), 1)
    return j.withColumn("score", score).select("symbol", "date", scores.call_of(F.col("score")).alias("call"), F.bround(F.least(F.lit(99.0), F.abs("score")), 1).alias("conviction"))


def referee(panels: DataFrame) -> DataFrame:
    """One row: which panel did better and how, from ``panel, total_return, matched_return, hedged_return, in_excess``."""
    side = lambda p, c: F.max(F.when(F.col("panel") == p, F.col(c)))
    one = panels.agg(*[side(p, c).alias(f"{p}_{c}") for p in ("harness", "rrg") for c in ("total_return", "matched_return", "hedged_return", "in_excess")])
    more = lambda c: F.coalesce(F.col(f"harness_{c}") > F.col(f"rrg_{c}"), F.lit(False))
    market = F.coalesce(F.col("harness_total_return") > F.coalesce("harness_matched_return", "rrg_matched_return"), F.lit(False))
    sharper = more("hedged_return") | more("in_excess")
    verdict = (
        F.when(F.col("harness_total_return").isNull(), "no trades")
        .when(market & more("total_return"), "beats both")
        .when(~market & sharper, "sharper, not better")
        .when(market, "beats the market only")
        .otherwise("no edge")
    )
    return one.withColumns({"beats_rrg": more("total_return"), "beats_market": market, "sharper": sharper, "verdict": verdict})


def backtest_report(calls: DataFrame, grid: DataFrame, benchmark: DataFrame, config: dict[str, Any] | None = None, interval: str = "1wk", portfolio: dict[str, Any] | None = None, gate: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything about one panel of calls: events, studies, trades, curve, contributions, portfolio, ladders."""
    from . import backtest

    a = settled(acts(calls, grid, LAG_DAYS[interval]), "acts")
    moves = backtest.forward_returns(a.withColumnRenamed("bar_no", "entry_bar").drop("last_bar"), grid, benchmark)
    trades = settled(simulated(candidates(a, grid), grid, config), "trades")
    curve = backtest.equity_curve(trades, grid, grid.select("date", "bar_no").distinct())
    table, lines = compared(a, grid, exit_config(config)["max_hold"])
    return {
        "event_study": backtest.forward_study(moves, ["call"]),
        "confidence": backtest.confidence_study(moves.filter("call = 'ROTATE IN'")),
        "trades": trades,
        "stats": backtest.trade_statistics(trades),
        "equity": matched_curve(curve, benchmark),
        "contributions": contributions(trades),
        "portfolio": rotation_portfolio(states(calls, grid), grid, benchmark, portfolio, gate),
        "ladders": table,
        "ladder_curves": lines,
    }


def gap_marks(positions: DataFrame, accounts: DataFrame, closes: DataFrame, today: str) -> DataFrame:
    """Books marked at the closes of the days missed since their last step: no trade, no cash moves.

    ``positions(book, symbol, shares)``, ``accounts(book, cash, last_date)``.
    """
    days = closes.select("date").distinct().filter(F.col("date") < F.lit(today).cast("date"))
    due = accounts.join(days, F.col("date") > F.col("last_date")).select("book", "cash", "date")
    worth = due.join(positions, "book", "left").join(closes.select("symbol", "date", "close"), ["symbol", "date"], "left")
    value = F.col("shares") * F.col("close")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return worth.groupBy("book", "date", "cash").agg((F.col("cash") + total(value)).alias("equity"), total(F.abs(value)).alias("gross"), total(value).alias("net"), F.count(F.when(F.col("shares") > 0, 1)).alias("n_long"))


def step_due(rows: DataFrame, close_minute: int = 16 * 60 + 5) -> Column:
    """Whether a book steps by itself now: autonomous, on a weekday, after the close, not yet today (``now, mode, last_step``)."""
    now = F.col("now")
    after = F.hour(now) * 60 + F.minute(now) >= close_minute
    return (F.coalesce(F.col("mode"), F.lit("manual")) == "autonomous") & F.dayofweek(now).between(2, 6) & after & ~F.coalesce(F.col("last_step") == F.to_date(now), F.lit(False))
