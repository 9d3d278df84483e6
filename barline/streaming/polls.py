"""Stateful handling of polled option contracts: as windows over stored polls and as a stream.

Both forms give the same rows: volume since the last poll of the day, never
negative, and the number of bursts so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BURST = 100_000.0
SCHEMA = "option_symbol string, day date, ts timestamp, session_volume long, mark double, volume_delta long, cluster_count long"
STATE = "day date, last_volume long, cluster_count long"


def deltas(polls: DataFrame, burst: float = BURST) -> DataFrame:
    """T-1: stored polls, one window per contract and day."""
    w = Window.partitionBy("option_symbol", "day").orderBy("ts")
    step = F.greatest(F.col("session_volume") - F.coalesce(F.lag("session_volume").over(w), F.lit(0)), F.lit(0))
    p = polls.withColumn("volume_delta", step)
    hit = F.when(F.col("volume_delta") * F.coalesce("mark", F.lit(0.0)) * 100 >= burst, 1).otherwise(0)
    return p.withColumn("__h", hit).withColumn("cluster_count", F.sum("__h").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__h")


def stream_deltas(polls: DataFrame, burst: float = BURST) -> DataFrame:
    """T-1 as a stream: state per contract is the day, the last volume and the burst count."""

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        day, volume, bursts = state.get if state.exists else (None, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            if r.day != day:
                day, volume, bursts = r.day, 0, 0
            step = max(0, int(r.session_volume) - volume)
            bursts += int(step * (r.mark if r.mark == r.mark else 0.0) * 100 >= burst)
            volume = int(r.session_volume)  # a drop lowers the base
            out.append((key[0], r.day, r.ts, volume, r.mark, step, bursts))
        state.update((day, volume, bursts))
        yield pd.DataFrame(out, columns=["option_symbol", "day", "ts", "session_volume", "mark", "volume_delta", "cluster_count"])

    chosen = polls.select("option_symbol", "day", "ts", "session_volume", "mark")
    return chosen.groupBy("option_symbol").applyInPandasWithState(update, SCHEMA, STATE, "append", "NoTimeout")


def signals(scored: DataFrame) -> DataFrame:
    """T-3: one row for each day and contract: first time kept, the rest from the last poll."""
    others = [c for c in scored.columns if c not in ("day", "option_symbol", "ts")]
    g = scored.groupBy("day", "option_symbol").agg(F.min("ts").alias("first_ts"), F.max_by(F.struct("ts", *others), "ts").alias("x"))
    return g.select("day", "option_symbol", "first_ts", F.col("x.ts").alias("last_ts"), *[f"x.{c}" for c in others])


def confirmations(signals_: DataFrame, interest: DataFrame) -> DataFrame:
    """T-5, J14: earlier signals resolved by today's open interest: opened, closed or flat.

    ``interest(option_symbol, day, open_interest)``: the next day on which a contract has one.
    """
    s = signals_.select("option_symbol", "day", F.col("open_interest").alias("base"), F.lit(True).alias("asked"))
    o = interest.select("option_symbol", "day", F.struct(F.col("day").alias("next_day"), F.col("open_interest").alias("next_oi")).alias("x"))
    both = s.unionByName(o, allowMissingColumns=True).withColumn("__n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    later = Window.partitionBy("option_symbol").orderBy(F.col("__n").desc()).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("x", F.min("x").over(later)).filter("asked and x is not null")
    base = F.coalesce("base", F.lit(0))
    change, limit = F.col("x.next_oi") - base, F.greatest(F.lit(500.0), 0.2 * base)
    state = F.when(change >= limit, "opened").when(change <= -limit, "closed").otherwise("flat")
    return found.select("day", "option_symbol", F.col("x.next_day").alias("next_day"), state.alias("entry_exit"))


def first_alerts(alerts: DataFrame) -> DataFrame:
    """T-6: the first alert of each day, symbol and rule."""
    w = Window.partitionBy("day", "symbol", "rule_key").orderBy("ts")
    return alerts.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def stream_first_alerts(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """T-6 as a stream: duplicates within the watermark are dropped."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["day", "symbol", "rule_key"])


def notional(polls: DataFrame) -> DataFrame:
    """Option premium by underlying and day, from each contract's last poll."""
    last = polls.groupBy("underlying", "option_symbol", "day").agg(F.max_by(F.col("session_volume") * F.col("mark") * 100, "ts").alias("n"))
    return last.groupBy("underlying", "day").agg(F.sum("n").alias("notional"))


def market_open(ts: Any) -> Any:
    """T-10: Monday to Friday, 9:30 to 16:00 in the session's time zone."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return F.dayofweek(ts).between(2, 6) & (minutes >= 570) & (minutes <= 960)
