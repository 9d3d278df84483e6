"""DuckDB texts that the oracle queries share: the bars, and the helpers for windows."""

from __future__ import annotations

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def bars(kind: str = "nation", grain: str = "week", name: str = "bars") -> str:
    """A CTE (without WITH) of bars(symbol[, sector], date, open, high, low, close, volume)."""
    day = "CAST(l_shipdate AS DATE)" if grain == "day" else f"CAST(date_trunc('{grain}', l_shipdate) AS DATE)"
    if kind == "brand":
        source, keys = "lineitem JOIN part ON l_partkey = p_partkey", "p_brand AS symbol"
    elif kind == "nation":
        source = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        keys = "n_name AS symbol, r_name AS sector"
    else:
        source, keys = "lineitem", "'MKT' AS symbol"
    px = "l_extendedprice / l_quantity"
    group = "symbol, sector, date" if kind == "nation" else "symbol, date"
    return f"""{name} AS (SELECT {keys}, {day} AS date, first({px} ORDER BY {_ORDER}) AS open, max({px}) AS high,
      min({px}) AS low, last({px} ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume
      FROM {source} GROUP BY {group})"""


def over(n: int | None = None, key: str = "symbol", order: str = "date") -> str:
    part = f"PARTITION BY {key} " if key else ""
    if n is None:
        return f"(PARTITION BY {key} ORDER BY {order})" if key else f"(ORDER BY {order})"
    return f"({part}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def guard(value: str, column: str, n: int, least: int, key: str = "symbol", order: str = "date") -> str:
    w = over(n, key, order)
    return f"CASE WHEN count({column}) OVER {w} >= {least} THEN {value} OVER {w} END"


def average(x: str, alpha: float, least: int = 0, key: str = "symbol", order: str = "date") -> str:
    """The exponential average of a column without gaps after its first value, as a list fold."""
    part = f"PARTITION BY {key} " if key else ""
    w = f"({part}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    seen = f"list({x}) FILTER ({x} IS NOT NULL) OVER {w}"
    fold = f"list_reduce({seen}, lambda a, v: (1 - {alpha!r}) * a + {alpha!r} * v)"
    return f"CASE WHEN count({x}) OVER {w} >= {max(least, 1)} THEN {fold} END"
