"""Column helpers: missing values are NULL everywhere, never NaN or infinite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN and infinities to NULL."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def clean_all(df: DataFrame) -> DataFrame:
    """``clean`` on every floating-point column: for use at every ingest."""
    return df.withColumns({n: clean(n) for n, t in df.dtypes if t in ("double", "float")})


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0 or missing."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def round_half(x: Column | str, places: int) -> Column:
    """Rounded as DuckDB's ``round`` does, from the binary value; Spark's rounds the shortest decimal text."""
    return F.round(col(x) * 10.0**places) / 10.0**places


def round_even(x: Column | str, places: int) -> Column:
    """``round_half`` with ties to the even digit, as DuckDB's ``round_even``; small negative values give -0.0, as there."""
    return F.rint(col(x) * 10.0**places) / 10.0**places


def exact_sum(values: Column | str) -> Column:
    """Sum of an array of doubles with the error of each addition carried along: rounded once, the same in any order of rows."""

    def add(a: Column, x: Column) -> Column:
        s = a["s"] + x
        part = s - a["s"]
        return F.struct(s.alias("s"), (a["e"] + ((a["s"] - (s - part)) + (x - part))).alias("e"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))
    return F.aggregate(F.array_sort(col(values)), zero, add, lambda a: F.nanvl(a["s"] + a["e"], a["s"]))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; NULL counts as 0."""
    return F.when(condition, 1.0).otherwise(0.0)


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def over_time(key: str | list[str] = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def last_n(n: int, key: str | list[str] = "symbol", order: str = "date") -> WindowSpec:
    return over_time(key, order).rowsBetween(-(n - 1), 0)


def until_now(key: str | list[str] = "symbol", order: str = "date") -> WindowSpec:
    return over_time(key, order).rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, counted: Column | str, w: WindowSpec, least: int) -> Column:
    """``value`` over ``w``, NULL unless the frame has ``least`` non-null values of ``counted``."""
    return F.when(F.count(col(counted)).over(w) >= least, value.over(w))


def carried(x: Column | str, w: WindowSpec) -> Column:
    """The last non-null value up to this row."""
    return F.last(col(x), ignorenulls=True).over(w)
