"""Paper books: a daily fold over target weights and closes, one book at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, COST, DUST = 100_000.0, 5e-4, 1.0
STEPS = "book string, date date, equity double, cash double, cost double, n_positions long"


def run_books(targets: DataFrame, closes: DataFrame, start: float = START, cost: float = COST) -> DataFrame:
    """Mark, stop out and rebalance each book on each decision date, paying ``cost`` of what is traded.

    ``targets(book, date, symbol, weight, stop)``: signed weights; a repeated (date, book,
    symbol) counts once.  ``closes(symbol, date, close)``.  Each book is a sequence, so
    books are the groups; on one date a book trades once.
    """
    t = targets.dropDuplicates(["book", "date", "symbol"])
    priced = t.join(closes.select("symbol", "date", "close"), ["symbol", "date"], "left")
    held = t.select("book", "symbol").distinct().join(t.select("book", "date").distinct(), "book")
    marks = held.join(closes.select("symbol", "date", "close"), ["symbol", "date"], "left")
    rows = marks.join(priced.select("book", "date", "symbol", "weight", "stop"), ["book", "date", "symbol"], "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        book, cash, last = group["book"].iloc[0], start, {}
        shares: dict[str, float] = {}
        stops: dict[str, float] = {}
        out = []
        for date, day in group.sort_values("date").groupby("date", sort=True):
            price = {s: c for s, c in zip(day["symbol"], day["close"], strict=True) if c == c and c is not None}
            last.update(price)
            paid = 0.0
            for s in [s for s, n in shares.items() if n > 0 and s in stops and last.get(s, 0) <= stops[s]]:
                paid += cost * abs(shares[s] * last[s])
                cash += shares.pop(s) * last[s]
            equity = cash + sum(n * last[s] for s, n in shares.items())
            want = {s: w for s, w in zip(day["symbol"], day["weight"], strict=True) if w == w and w is not None and s in price}
            stops = {s: x for s, x in zip(day["symbol"], day["stop"], strict=True) if x == x and x is not None}
            for s in sorted({*shares, *want}):
                if s not in last:
                    continue
                move = equity * want.get(s, 0.0) - shares.get(s, 0.0) * last[s]
                if abs(move) < DUST:
                    continue
                paid += cost * abs(move)
                cash -= move
                shares[s] = shares.get(s, 0.0) + move / last[s]
                if abs(shares[s] * last[s]) < DUST:
                    del shares[s]
            cash -= paid
            out.append((book, date, cash + sum(n * last[s] for s, n in shares.items()), cash, paid, len(shares)))
        return pd.DataFrame(out, columns=["book", "date", "equity", "cash", "cost", "n_positions"])

    return rows.groupBy("book").applyInPandas(fold, STEPS)


def book_state(steps: DataFrame, benchmark: DataFrame, start: float = START) -> DataFrame:
    """Return, worst drawdown, costs, and the return over the benchmark's of the same dates."""
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = steps.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1).join(benchmark.select("date", F.col("close").alias("b")), "date", "left")
    out = s.groupBy("book").agg(F.max_by("equity", "date").alias("equity"), F.min("dd").alias("max_drawdown"), F.sum("cost").alias("costs"), F.min_by("b", "date").alias("b0"), F.max_by("b", "date").alias("b1"))
    ret = F.col("equity") / start - 1
    return out.select("book", "equity", ret.alias("return"), "max_drawdown", "costs", (ret - (F.col("b1") / F.col("b0") - 1)).alias("excess"))

