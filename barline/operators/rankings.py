"""Ranks over time and across symbols, baskets, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over_time, ratio
from .series import aligned, change, compounded

#: Horizons and weights of the composite, and the look-backs of ranks.
HORIZONS = ((21, 0.5), (63, 0.3), (126, 0.2))
BACK = (("1d", 1), ("1w", 5), ("1m", 21))


def composite(bars: DataFrame, benchmark: DataFrame, name: str = "rs_composite") -> DataFrame:
    """Weighted percent changes of price over benchmark; NULL if any horizon is."""
    b = aligned(bars, benchmark).withColumn("__q", ratio("close", "bench"))
    value = sum((w * 100 * change("__q", n) for n, w in HORIZONS), F.lit(0.0))
    return b.withColumn(name, value).drop("__q", "bench")


def percent_rank(x: Column | str, by: str = "date") -> Column:
    """R2: average rank (ties share it) over the count of known values of the date, in percent."""
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(by)
    first = F.rank().over(w.orderBy(x.asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(by, x))
    return F.when(x.isNotNull(), 100.0 * (first + (same - 1) / 2.0) / F.count(x).over(w))


def pooled_rank(df: DataFrame, x: str, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Share of all pooled values at or below each, 0 to 99.

    Counts per distinct value are summed in value ranges first, so that the pool
    is never sorted in one task.
    """
    keys = by or []
    known = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("__n"))
    edges = known.agg(F.expr(f"percentile_approx({x}, array({', '.join(str(k / 64) for k in range(1, 64))}), 1000)").alias("__e"))
    cut = known.join(F.broadcast(edges)).withColumn("__p", F.size(F.filter("__e", lambda e: e < F.col(x)))).drop("__e")
    inner = Window.partitionBy(*keys, "__p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    parts = cut.groupBy(*keys, "__p").agg(F.sum("__n").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumns({"__before": F.coalesce(F.sum("__t").over(before), F.lit(0)), "__all": F.sum("__t").over(Window.partitionBy(*keys))}).drop("__t")
    ranked = cut.withColumn("__in", F.sum("__n").over(inner)).join(offsets, [*keys, "__p"])
    value = F.least(F.lit(99), F.bround(100.0 * (F.col("__in") + F.col("__before")) / F.col("__all"))).cast("int")
    return df.join(ranked.select(*keys, x, value.alias(name)), [*keys, x], "left")


def leaderboard(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Last composite rank of each symbol, ranks before, relative moves, distance from the high."""
    b = pooled_rank(composite(bars, benchmark), "rs_composite", "rank")
    known = b.filter("rs_composite is not null")
    known = known.withColumns({f"rank_{n}": F.lag("rank", k).over(over_time()) for n, k in BACK})
    known = known.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).filter("__k = 1")
    moves = aligned(bars, benchmark).withColumns(
        {f"rs_{n}": 100 * (change("close", k) - change("bench", k)) for n, k in BACK} | {"off_high": 100 * (ratio("close", F.max("close").over(over_time().rowsBetween(-251, 0))) - 1)}
    )
    last = moves.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).filter("__k = 1")
    cols = [f"rs_{n}" for n, _ in BACK]
    return last.select("symbol", *cols, "off_high").join(known.select("symbol", "rank", *[f"rank_{n}" for n, _ in BACK]), "symbol", "left")


def movers(board: DataFrame, back: str = "rank_1w", n: int = 5) -> DataFrame:
    """Largest rank gains and losses."""
    d = board.withColumn("delta", F.col("rank") - F.col(back)).filter("delta <> 0")
    side = F.when(F.col("delta") > 0, "up").otherwise("down")
    w = Window.partitionBy(side).orderBy(F.abs("delta").desc(), F.col("rank").desc(), "symbol")
    return d.withColumns({"side": side, "place": F.row_number().over(w)}).filter(F.col("place") <= n).select("side", "place", "symbol", "rank", "delta")


def baskets(bars: DataFrame, themes: DataFrame) -> DataFrame:
    """Equal-weight index of each theme (``theme, symbols``), from 100 at its first date."""
    members = themes.select("theme", F.explode("symbols").alias("symbol"))
    r = bars.select("symbol", "date", change("close").alias("r")).join(members, "symbol")
    day = r.groupBy("theme", "date").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("ret"))
    return day.withColumn("close", 100 * compounded(F.col("ret"), "theme"))


def leg_weights(calls: DataFrame, longs: int = 3, shorts: int = 3) -> DataFrame:
    """Per date equal weights for the best ROTATE IN calls and the worst ROTATE OUT calls."""
    out = None
    for side, call, n, order in ((1, "ROTATE IN", longs, F.col("conviction").desc()), (-1, "ROTATE OUT", shorts, F.col("conviction").asc())):
        picked = calls.filter(F.col("call") == call).withColumn("__k", F.row_number().over(Window.partitionBy("date").orderBy(order, "symbol"))).filter(F.col("__k") <= n)
        part = picked.select("symbol", "date", F.lit(side).alias("side"), (side / F.count("*").over(Window.partitionBy("date"))).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def cross_percentile(rows: DataFrame, x: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Share of known values at or below each, 0 to 99, over all rows or within a list."""
    return pooled_rank(rows, x, name, by)


def blended_strength(rows: DataFrame, columns: dict[str, float], name: str = "rs_value") -> DataFrame:
    """K4: weighted mean of the strength columns that are known."""
    from .scores import weighted

    return rows.withColumn(name, weighted({c: (F.col(c), w) for c, w in columns.items()}))


def holdings(rows: DataFrame, quotes: DataFrame, fund: str, n: int = 10) -> DataFrame:
    """A fund's n largest holdings, weights in percent, with their quotes."""
    top = rows.filter(F.col("fund") == fund).orderBy(F.col("weight").desc(), "symbol").limit(n)
    return top.select("symbol", F.bround(100 * F.col("weight"), 2).alias("weight_pct")).join(quotes, "symbol", "left")


def theme_leaders(bars: DataFrame, themes: DataFrame, n: int = 3, back: int = 21) -> DataFrame:
    """The members of each theme that moved most over ``back`` bars."""
    moved = bars.select("symbol", "date", (100 * change("close", back)).alias("move"))
    last = moved.groupBy("symbol").agg(F.max_by("move", "date").alias("move")).filter("move is not null")
    j = themes.select("theme", F.explode("symbols").alias("symbol")).join(last, "symbol")
    w = Window.partitionBy("theme").orderBy(F.col("move").desc(), "symbol")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
