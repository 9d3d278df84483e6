"""The exponential average, the one recursive function of the library.

``y0 = x0``, then ``y = ((1-a)^(g+1) y' + a x) / ((1-a)^(g+1) + a)`` after g missing
rows; during a gap the last value is repeated, and a value shows once ``least``
non-null inputs were seen.  A group is one symbol's history; all averages of a
symbol are taken in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def average(x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=False, min_periods=max(least, 1)).mean().to_numpy()


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def averages(
    df: DataFrame, specs: Sequence[tuple[str, str, float, int]], key: str | Sequence[str] = "symbol", order: str = "date"
) -> DataFrame:
    """Adds the averages ``(name, input column, alpha, least)`` per ``key`` in ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    schema = T.StructType([*df.schema.fields, *(T.StructField(s[0], T.DoubleType()) for s in specs)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        new = {name: average(group[source].to_numpy(dtype=float, na_value=np.nan), a, least) for name, source, a, least in specs}
        return group.assign(**{k: pd.Series(v, index=group.index, dtype="Float64").where(~np.isnan(v)) for k, v in new.items()})

    return df.groupBy(*keys).applyInPandas(run, schema)
