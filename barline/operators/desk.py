"""What a desk looks at: contexts, comparisons, live rows, alert passes, exports and orders of lists."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import carried, over_time, ratio, until_now
from ..streaming import polls
from . import scores, screen
from .patterns import live_rvol, session_fraction

#: Sector funds that lead in rising and in falling markets.
OFFENSIVE = ("XLK", "XLY", "XLF", "XLI", "XLC")
DEFENSIVE = ("XLU", "XLP", "XLV")


def projected(rows: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    """the columns to show, numbers rounded, neither NaN nor infinite."""
    kinds = dict(rows.dtypes)
    shown = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, places)) if kinds[c] == "double" else F.col(c)
    return rows.select(*[shown(c).alias(c) for c in columns if c in kinds])


def weekdays(rows: DataFrame) -> DataFrame:
    """rows of Monday to Friday."""
    return rows.filter(F.dayofweek("date").between(2, 6))


def side(symbol: Column) -> Column:
    """offensive, defensive or neither."""
    return F.when(symbol.isin(*OFFENSIVE), "offensive").when(symbol.isin(*DEFENSIVE), "defensive").otherwise("other")


def matched(days: DataFrame, index: DataFrame, name: str = "index_close") -> DataFrame:
    """The index's close on exactly the same dates (nothing is carried)."""
    return days.join(index.select("date", F.col("close").alias(name)), "date", "left")


def context(underlyings: DataFrame, sectors: DataFrame, calls: DataFrame, regime: DataFrame, zones: DataFrame, pockets: DataFrame, letters: DataFrame) -> DataFrame:
    """What is known around each underlying, NULL where a lookup has nothing.

    ``sectors(symbol, sector_etf)``, ``calls(sector_etf, call)``, ``regime(regime)`` of one
    row, ``zones(symbol, zone)``, ``pockets(symbol, in_pocket)``, ``letters(symbol, letter)``.
    """
    out = underlyings.select(F.upper("symbol").alias("symbol")).filter("symbol <> ''").distinct()
    out = out.join(sectors.select("symbol", "sector_etf"), "symbol", "left").join(calls.select("sector_etf", F.col("call").alias("sector_call")), "sector_etf", "left")
    for table, column, name in ((zones, "zone", "vp_zone"), (pockets, "in_pocket", "golden_pocket"), (letters, "letter", "accumulation")):
        out = out.join(table.select("symbol", F.col(column).alias(name)), "symbol", "left")
    out = out.withColumn("golden_pocket", F.when(F.col("golden_pocket") > 0, True))
    return out.crossJoin(regime.select("regime")).drop("sector_etf")


def overlay(curves: DataFrame, fill: float = 1.0) -> DataFrame:
    """Several curves (``curve, date, equity``) on the dates of all: carried forward, ``fill`` before their first."""
    dates, names = curves.select("date").distinct(), curves.select("curve").distinct()
    grid = names.crossJoin(dates).join(curves.select("curve", "date", "equity"), ["curve", "date"], "left")
    return grid.select("curve", "date", F.coalesce(carried("equity", until_now("curve")), F.lit(fill)).alias("equity"))


def comps(frame: DataFrame, peers: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns of a symbol's peers."""
    return frame.join(peers.select("symbol").distinct(), "symbol", "left_semi").select("symbol", *columns)


def relative_history(bars: DataFrame, benchmark: DataFrame, bars_back: int = 12) -> DataFrame:
    """Each symbol's move over 1 to n bars less the benchmark's, in percent, on dates that both have."""
    both = bars.filter("close is not null").join(benchmark.filter("close is not null").select("date", F.col("close").alias("b")), "date")
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last = both.withColumn("k", F.row_number().over(w) - 1).filter(F.col("k") <= bars_back)
    now = last.filter("k = 0").select("symbol", F.col("close").alias("c0"), F.col("b").alias("b0"))
    j = last.filter("k > 0").join(now, "symbol")
    return j.select("symbol", F.col("k").alias("back"), (100 * (ratio("c0", "close") - ratio("b0", "b"))).alias("rel"))


def live_rows(quotes: DataFrame, snapshot: DataFrame, minutes: Column) -> DataFrame:
    """T-9: live values of quoted symbols: change from the quote or the previous close, gap, volume prorated by the session.

    ``quotes(symbol, last, open, prev_close, net_pct_chg, total_volume)``; ``minutes`` since the open.
    """
    q = quotes.join(snapshot.select("symbol", "avg_vol_10d"), "symbol", "left")
    base = F.when(F.col("prev_close") != 0, F.col("prev_close"))
    opened = F.when(F.col("open") != 0, F.col("open"))
    return q.select(
        "symbol",
        F.col("last").alias("close"),
        F.coalesce("net_pct_chg", 100 * (F.col("last") / base - 1)).alias("chg_pct"),
        (100 * (opened / base - 1)).alias("gap_pct"),
        F.col("total_volume").alias("volume"),
        live_rvol(F.col("total_volume"), F.col("avg_vol_10d"), session_fraction(minutes)).alias("rvol_10d"),
    )


def alert_pass(frame: DataFrame, focus: DataFrame, screens: list[dict[str, Any]], before: DataFrame, sent: DataFrame, day: str) -> DataFrame:
    """What is new today: rules on the focus list and armed screens, less what was sent (``symbol, rule_key`` of the day)."""
    chosen = frame.join(focus.select("symbol").distinct(), "symbol", "left_semi")
    hits = screen.alerts(chosen)
    fresh, _ = screen.armed(frame, screens, before)
    hits = hits.unionByName(fresh.select("symbol", "rule_key", F.lit("info").alias("kind")))
    return hits.dropDuplicates(["symbol", "rule_key"]).join(sent.select("symbol", "rule_key"), ["symbol", "rule_key"], "left_anti").withColumn("date", F.lit(day).cast("date"))


def messages(alerts: DataFrame, routes: DataFrame) -> DataFrame:
    """One batched message for each channel; ``routes(symbol, channels)``, and all symbols without a route to none."""
    each = alerts.join(routes, "symbol").select(F.explode("channels").alias("channel"), "symbol", "rule_key")
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "symbol", "rule_key")))
    return each.groupBy("channel").agg(F.count("*").alias("n"), F.concat_ws("\n", lines).alias("text"))


def sweep(contracts: DataFrame, baseline: DataFrame, contexts: DataFrame, regime: str | None = None) -> DataFrame:
    """T-2: one pass over polled contracts: deltas since the last poll, context, score; what is above noise.

    ``contexts(underlying, align)``, ``baseline(underlying, baseline_notional)``; both default to nothing known.
    """
    c = polls.deltas(contracts)
    c = c.join(baseline, "underlying", "left").join(contexts.select("underlying", F.col("align").alias("conf_align")), "underlying", "left")
    return scores.classify_contracts(c.fillna(0.0, ["conf_align"])).filter("classification <> 'noise'")


def sweep_alerts(flagged: DataFrame) -> DataFrame:
    """T-2: the alerts of a sweep: one a day for each contract and class, the first."""
    kind = F.when(F.col("direction") == "bullish", "bull").otherwise("bear")
    a = flagged.filter("classification in ('notable', 'conviction')")
    a = a.select("day", "ts", F.col("option_symbol").alias("symbol"), F.concat(F.lit("flow:"), F.col("classification")).alias("rule_key"), kind.alias("kind"), "conviction")
    return polls.first_alerts(a)


def alert_log(alerts: DataFrame, today: str, days: int, delivered: DataFrame | None = None) -> DataFrame:
    """T-7: alerts of the last n days, newest first, with those of ``delivered`` marked."""
    out = alerts.filter(F.col("date") > F.date_sub(F.lit(today).cast("date"), days))
    if delivered is not None:
        known = delivered.select("id").distinct().withColumn("__d", F.lit(True))
        out = out.join(known, "id", "left").withColumn("delivered", F.coalesce("__d", F.lit(False))).drop("__d")
    return out.orderBy(F.col("date").desc(), F.col("id").desc())


def due(stamps: DataFrame, now: str, seconds: int) -> DataFrame:
    """T-12, B39: which sources are due: never fetched, or longer ago than their lifetime."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")
    return stamps.withColumn("due", F.coalesce(age >= seconds, F.lit(True)))


def csv_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """H5: rows as quoted CSV lines (quotes doubled), with their place; the header is line 0."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    head = rows.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.lit(",".join(f'"{c}"' for c in columns)).alias("line"))
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("line_no"), F.concat_ws(",", *quoted).alias("line"))  # what one person exports
    return head.unionByName(body)


def board_order(board: DataFrame, by: str, descending: bool, back: str = "rank_1w") -> DataFrame:
    """H6: an unknown value is the least in both directions; rank now less rank before."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    return board.withColumns({"place": F.row_number().over(Window.orderBy(order, "symbol")), "rank_delta": F.col("rank") - F.col(back)})


def axis(points: DataFrame, pad: float = 0.08) -> DataFrame:
    """H8: range of a chart that holds all points and the centre (100, 100), with a margin."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    out = {}
    for c in ("x", "y"):
        lo, hi = F.least(F.col(f"lo_{c}"), F.lit(100.0)), F.greatest(F.col(f"hi_{c}"), F.lit(100.0))
        out |= {f"{c}_from": lo - pad * (hi - lo), f"{c}_to": hi + pad * (hi - lo)}
    return ends.select(*[v.alias(k) for k, v in out.items()])


def any_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_series(prices: DataFrame, names: list[str]) -> DataFrame:
    """The whole series of the first name that has any price."""
    ranked = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("symbol"))
    p = prices.filter(F.col("symbol").isin(names) & F.col("close").isNotNull()).withColumn("__r", ranked)
    return p.withColumn("__m", F.min("__r").over(Window.partitionBy())).filter("__r = __m").select("symbol", "date", "close")


def price_ratio(prices: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """One symbol's price over another's on the dates of both."""
    x = prices.filter(F.col("symbol") == a).select("date", F.col("close").alias("a"))
    y = prices.filter(F.col("symbol") == b).select("date", F.col("close").alias("b"))
    return x.join(y, "date").select("date", ratio("a", "b").alias(name)).filter(F.col(name).isNotNull())


def market_health(prices: DataFrame, weeks: int = 62) -> DataFrame:
    """Last close against its 50- and 200-bar averages, a long exponential average and the year's first close, in percent."""
    from ..functions.recursive import averages, span

    p = averages(prices.select("symbol", "date", "close"), [("__long", "close", span(weeks * 5), 0)])
    w, n = over_time(), F.count("*").over(Window.partitionBy("symbol"))
    mean = lambda k: F.when(F.count("close").over(w.rowsBetween(1 - k, 0)) >= k, F.avg("close").over(w.rowsBetween(1 - k, 0)))
    first = F.first("close").over(Window.partitionBy("symbol", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumns({"__50": mean(50), "__200": mean(200), "__y": first, "__n": n, "__k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))})
    against = lambda c: F.bround(100 * (ratio("close", c) - 1), 2)
    return p.filter("__k = 1 and __n > 50").select("symbol", "date", *[against(c).alias(k) for k, c in (("vs_50", "__50"), ("vs_200", "__200"), ("vs_long_ema", "__long"), ("ytd", "__y"))])
