"""Backtests without lookahead: replays, trades, event studies, equity curves, books.

Positions count rows of the union calendar (``bar_no``): a missing bar is a gap, not
the next bar.  A trade's window is written out as bar numbers and joined by symbol
and bar; the first bar that qualifies is its exit, so no path is walked row by row.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over_time, ratio
from .screen import predicate
from .series import set_onsets

HORIZONS = (1, 5, 10, 20)


def replay(indicators: DataFrame, conditions: list[dict[str, Any]], start: str | None = None) -> DataFrame:
    """Every row with ``matched`` and ``onset`` from ``start`` on, in one pass."""
    rows = indicators.filter(F.col("date") >= F.lit(start).cast("date")) if start else indicators
    rows = rows.withColumn("matched", predicate(rows.columns, conditions))
    return rows.withColumn("onset", set_onsets(rows))


def entries(rows: DataFrame) -> DataFrame:
    """B2: the open of the next calendar row after each onset; skipped if missing or not positive."""
    w = over_time(order="bar_no")
    r = rows.withColumns({"entry_px": F.lead("open").over(w), "entry_bar": F.col("bar_no") + 1})
    keep = F.col("onset") & (F.col("entry_px") > 0) & (F.col("entry_bar") <= F.col("last_bar"))
    return r.filter(keep).select("symbol", F.col("date").alias("signal_date"), "entry_bar", "entry_px", F.col("atr14").alias("atr0"), "last_bar")


def exits(trades: DataFrame, grid: DataFrame, model: str, hold: int = 10, stop: float = 2.0, target: float = 3.0, cap: int = 40) -> DataFrame:
    """Exit bar, price and reason, return, best and worst excursion in percent.

    ``grid``: ``symbol, bar_no, date, open, high, low, close, matched`` on the calendar.
    A trade names the bars it may meet, so it joins its own window and nothing else.
    """
    if model not in ("hold", "atr", "signal"):
        raise ValueError(model)
    span = hold - 1 if model == "hold" else cap
    t = trades.withColumn("end_bar", F.least(F.col("entry_bar") + span, F.col("last_bar")))
    t = t.filter("atr0 > 0") if model == "atr" else t
    t = t.withColumn("bar_no", F.explode(F.sequence("entry_bar", "end_bar")))
    inside = t.join(grid.select("symbol", "bar_no", "date", "open", "high", "low", "close", "matched"), ["symbol", "bar_no"])
    ends = F.col("bar_no") == F.col("end_bar")
    if model == "hold":
        hit, rank, px = F.col("close").isNotNull(), -F.col("bar_no"), F.col("close")
        why = F.when(F.col("bar_no") == F.col("entry_bar") + span, "hold").otherwise("eod")
    elif model == "atr":
        low, high = F.col("entry_px") - stop * F.col("atr0"), F.col("entry_px") + target * F.col("atr0")
        stopped, won = F.coalesce(F.col("low") <= low, F.lit(False)), F.coalesce(F.col("high") >= high, F.lit(False))
        hit, rank = stopped | won | ends, F.col("bar_no")
        px = F.when(stopped, F.least("open", low)).when(won, F.greatest("open", high)).otherwise(F.col("close"))
        why = F.when(stopped, "stop").when(won, "target").otherwise("cap")
    else:
        gone = ~F.coalesce("matched", F.lit(False))
        hit, rank, px, why = gone | ends, F.col("bar_no"), F.col("close"), F.when(gone, "signal").otherwise("cap")
    chosen = F.struct(rank.alias("rank"), F.col("bar_no").alias("exit_bar"), F.col("date").alias("exit_date"), px.alias("exit_px"), why.alias("exit_reason"))
    path = F.collect_list(F.struct("bar_no", "high", "low"))  # at most ``cap`` bars
    one = inside.groupBy("symbol", "signal_date", "entry_bar", "entry_px").agg(F.min(F.when(hit, chosen)).alias("x"), path.alias("path")).filter("x.exit_px > 0")
    held = F.filter("path", lambda p: p["bar_no"] <= F.col("x.exit_bar"))
    best, worst = F.array_max(F.transform(held, lambda p: p["high"])), F.array_min(F.transform(held, lambda p: p["low"]))
    return one.select(
        "symbol", "signal_date", "entry_bar", "entry_px", "x.exit_bar", "x.exit_date", "x.exit_px", "x.exit_reason",
        (100 * (F.col("x.exit_px") / F.col("entry_px") - 1)).alias("return_pct"),
        (F.col("x.exit_bar") - F.col("entry_bar") + 1).alias("bars_held"),
        (100 * (best / F.col("entry_px") - 1)).alias("mfe_pct"),
        (100 * (worst / F.col("entry_px") - 1)).alias("mae_pct"),
    )


def forward_returns(events: DataFrame, grid: DataFrame, benchmark: DataFrame, bar: str = "entry_bar") -> DataFrame:
    """Moves from the event bar's close over each horizon, and their excess, in percent (long form)."""
    w, b = over_time(order="bar_no"), Window.orderBy("bar_no")
    own = grid.select("symbol", F.col("bar_no").alias(bar), *[(100 * (ratio(F.lead("close", h).over(w), "close") - 1)).alias(f"f{h}") for h in HORIZONS])
    market = benchmark.select(F.col("bar_no").alias(bar), *[(100 * (ratio(F.lead("close", h).over(b), "close") - 1)).alias(f"m{h}") for h in HORIZONS])
    j = events.join(own, ["symbol", bar]).join(market, bar, "left")
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("fwd"), (F.col(f"f{h}") - F.col(f"m{h}")).alias("excess")) for h in HORIZONS])
    return j.select(*events.columns, F.explode(cells).alias("x")).select(*events.columns, "x.*").filter("fwd is not null")


def forward_study(moves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median, share of gains and mean excess by horizon (and ``by``)."""
    return moves.groupBy(*(by or []), "horizon").agg(
        F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.expr("percentile(fwd, 0.5)").alias("median"),
        (100 * F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.avg("excess").alias("excess"),
    )


def confidence_study(moves: DataFrame, horizon: int = 10) -> DataFrame:
    """Mean excess by conviction bucket [0, 40, 55, 70, 85, 100); empty buckets too."""
    edges = (0, 40, 55, 70, 85, 100)
    c = F.col("conviction")
    bucket = F.when(F.lit(False), 0)
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        bucket = bucket.when((c >= lo) & ((c < hi) if hi < 100 else (c <= hi)), k)
    found = moves.filter(F.col("horizon") == horizon).withColumn("bucket", bucket).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("excess").alias("excess"))
    frame = moves.sparkSession.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bucket int, low double, high double")
    return frame.join(found, "bucket", "left").select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "excess")


def separation(moves: DataFrame, lo: int, hi: int, horizon: int = 10, least: int = 3) -> DataFrame:
    """Mean excess of ROTATE IN less that of ROTATE OUT over bars in (lo, hi]."""
    m = moves.filter((F.col("horizon") == horizon) & (F.col("entry_bar") > lo) & (F.col("entry_bar") <= hi))
    side = {n: F.when(F.col("call") == c, F.col("excess")) for n, c in (("i", "ROTATE IN"), ("o", "ROTATE OUT"))}
    out = m.agg(*[F.avg(v).alias(f"m{k}") for k, v in side.items()], *[F.count(v).alias(f"n{k}") for k, v in side.items()])
    return out.select(F.when((F.col("ni") >= least) & (F.col("no") >= least), F.col("mi") - F.col("mo")).alias("separation"), F.col("ni").alias("n_in"), F.col("no").alias("n_out"))


def trade_statistics(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, win rate, means, profit factor, payoff; a return of 0 is a loss."""
    r = F.col("return_pct")
    won, lost = F.when(r > 0, r), F.when(r <= 0, r)
    return trades.groupBy(*(by or [])).agg(
        F.count("*").alias("n_trades"),
        (100 * F.avg(F.when(r > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        F.avg(r).alias("avg_return"),
        F.expr("percentile(return_pct, 0.5)").alias("median_return"),
        F.avg(won).alias("avg_win"),
        F.avg(lost).alias("avg_loss"),
        ratio(F.coalesce(F.sum(won), F.lit(0.0)), -F.sum(lost)).alias("profit_factor"),
        ratio(F.avg(won), -F.avg(lost)).alias("payoff_ratio"),
        F.avg("bars_held").alias("avg_bars_held"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    )


def equity_curve(trades: DataFrame, grid: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean return of the symbols held on each date, the compounded curve and its drawdown.

    A symbol is held in (entry, exit]; the mean divides by all held, priced or not.
    """
    w = over_time(order="bar_no")
    r = grid.select("symbol", "bar_no", (ratio("close", F.lag("close").over(w)) - 1).alias("r"))
    days = trades.filter("exit_bar > entry_bar").select("symbol", F.explode(F.sequence(F.col("entry_bar") + 1, F.col("exit_bar"))).alias("bar_no"))
    held = days.join(r, ["symbol", "bar_no"])
    once = held.groupBy("bar_no", "symbol").agg(F.max("r").alias("r"))
    day = once.groupBy("bar_no").agg((F.coalesce(F.sum("r"), F.lit(0.0)) / F.count("*")).alias("ret"), F.count("*").alias("n_held"))
    d = calendar.select("date", "bar_no").join(day, "bar_no", "left").fillna(0.0, ["ret"]).fillna(0, ["n_held"])
    o = Window.orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(o)))
    return d.withColumn("drawdown", F.col("equity") / F.max("equity").over(o) - 1)


def performance(curve: DataFrame) -> DataFrame:
    """Total return, CAGR, worst drawdown, Sharpe ratio (sample deviation), share of days in the market."""
    n = F.count("*")
    sd = F.stddev_samp("ret")
    last = F.max_by("equity", "bar_no")
    return curve.agg(
        (100 * (last - 1)).alias("total_return"),
        (100 * (F.pow(last, 252.0 / n) - 1)).alias("cagr"),
        (100 * F.min("drawdown")).alias("max_drawdown"),
        (F.avg("ret") / F.when(sd > 0, sd) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.avg(F.when(F.col("n_held") > 0, 1.0).otherwise(0.0)).alias("in_market"),
    )


def histogram(trades: DataFrame, bins: int = 20, clip: float = 50.0) -> DataFrame:
    """Equal bins between the smallest and largest clipped return; the last bin is closed."""
    r = trades.select(F.greatest(F.least(F.col("return_pct"), F.lit(clip)), F.lit(-clip)).alias("r"))
    ends = r.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    k = F.least(F.lit(bins - 1), F.floor((F.col("r") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins)))
    return r.join(F.broadcast(ends)).groupBy(F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def portfolio(weights: DataFrame, grid: DataFrame) -> DataFrame:
    """Returns of weights decided on the bar before: long and short legs and their sum by date."""
    w = over_time(order="bar_no")
    r = grid.select("symbol", "bar_no", "date", (ratio("close", F.lag("close").over(w)) - 1).alias("r"))
    acted = weights.join(grid.select("symbol", "date", "bar_no"), ["symbol", "date"]).select("symbol", (F.col("bar_no") + 1).alias("bar_no"), "side", "weight")
    j = acted.join(r, ["symbol", "bar_no"])
    part = F.col("weight") * F.coalesce("r", F.lit(0.0))
    return j.groupBy("date").agg(
        F.sum(F.when(F.col("side") > 0, part).otherwise(0.0)).alias("long_ret"),
        F.sum(F.when(F.col("side") < 0, part).otherwise(0.0)).alias("short_ret"),
        F.sum(part).alias("spread_ret"),
    )


def target_book(suggestions: DataFrame, stance: str, posture: str) -> DataFrame:
    """Weights in proportion to the pick, names by stance, gross by posture."""
    n = {"CONCENTRATE": 3, "ROTATE": 6}.get(stance, 4)
    gross = {"Risk-on": 1.0, "Lean bullish": 0.75, "Neutral": 0.5, "Lean bearish": 0.25}.get(posture, 0.0)
    best = suggestions.filter("tradeable").orderBy(F.col("pick").desc(), "symbol").limit(n)
    share = F.col("pick") / F.sum("pick").over(Window.partitionBy())
    return best.select("symbol", "pick", "stop", (gross * share).alias("weight")).filter("weight > 0")


def side_of(call: Column) -> Column:
    """1 for calls that add, -1 for calls that cut, else 0."""
    return F.when(call.isin("ROTATE IN", "HOLD"), 1).when(call.isin("ROTATE OUT", "AVOID"), -1).otherwise(0)


def strategy_signals(grid: DataFrame, conditions: list[dict[str, Any]], start: str, features: list[str]) -> DataFrame:
    """Entries of a strategy from ``start`` on, with the indicators of the signal bar as ``features``.

    Indicators come computed over all history, so that they are warm at the start;
    matches before it do not count as earlier ones (T21).
    """
    r = replay(grid, conditions, start)
    e = entries(r)
    at = r.select("symbol", F.col("date").alias("signal_date"), F.struct(*features).alias("features"))
    return e.join(at, ["symbol", "signal_date"])
