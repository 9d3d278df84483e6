"""Names, functions and oracle texts of all queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            oracle(name, sql)
        return run

    return add


def oracle(name: str, sql: str) -> None:
    """The DuckDB text of a registered query."""
    # DuckDB's count_if is NULL where every condition is
    ORACLE_SQL[name] = re.sub(r"count_if\(([^()]*)\)", r"count(*) FILTER (\1)", sql)


def rounded(df: DataFrame, places: int = 6, by: Callable[[str, int], Column] = F.round) -> DataFrame:
    """Floating-point columns rounded, so that results compare by value."""
    return df.select(*[(by(n, places) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
