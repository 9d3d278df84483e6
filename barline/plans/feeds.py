"""Queries of the calendar, series and listing readers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scores
from ..sources import adapters as A
from ..sources import bars as B
from .registry import query


@query(
    "s43_events",
    """SELECT CAST(o_orderdate AS DATE) AS event_date, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' ELSE 'low' END AS importance FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31' AND o_orderpriority LIKE '1%'""",
)
def events(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("event_date"), "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("low").alias("importance"))
    return A.events(o, "1997-01-01", "1997-01-31", ["high"])


@query(
    "k32_week_grid",
    """WITH d AS (SELECT CAST(unnest(range(DATE '1997-01-06', DATE '1997-01-20', INTERVAL 1 DAY)) AS DATE) AS event_date), e AS (SELECT CAST(o_orderdate AS DATE) AS event_date, count(*) AS n FROM orders GROUP BY 1)
    SELECT d.event_date AS event_date, CAST(coalesce(e.n, 0) AS INTEGER) AS n FROM d LEFT JOIN e ON e.event_date = d.event_date WHERE isodow(d.event_date) < 6""",
)
def week_grid(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("event_date"), F.lit("08:30").alias("event_time"), F.col("o_orderkey").cast("string").alias("title"))
    return scores.week_grid(o, "1997-01-06").select("event_date", F.size("titles").alias("n"))


@query(
    "k30_rates",
    """WITH s AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 100000 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    d AS (SELECT *, round_even(100 * (value - lag(value) OVER w), 0) AS d1, round_even(100 * (value - lag(value, 5) OVER w), 0) AS d5, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM s WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id, date, CAST(d1 AS BIGINT) AS d1, CAST(d5 AS BIGINT) AS d5 FROM d WHERE k = 1""",
)
def rates(spark: SparkSession, sf: str) -> DataFrame:
    j = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = j.groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 100000).alias("value"))
    return A.rates(s).select("series_id", "date", "d1", "d5")


@query(
    "s35_month_marks",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
    SELECT month, CAST(month + ((12 - isodow(month)) % 7)::INTEGER AS DATE) AS first_friday, CAST(last_day(month) - CASE isodow(last_day(month)) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS DATE) AS last_business_day FROM m""",
)
def month_marks(spark: SparkSession, sf: str) -> DataFrame:
    return A.month_marks(B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("month")))


@query("s42_upsert", "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return B.keep_latest(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")
