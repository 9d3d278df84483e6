"""Tables that stay between queries: versioned Parquet behind a pointer, upserts, watermarks, small settings.

A table is a folder of versions; a write makes a new one and then moves the
pointer, so readers of the old one are not disturbed and a failed write leaves
nothing behind that is read.  Partitioned tables replace only the partitions that
are written.  The root is a folder that driver and executors share.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._files, self._path = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: path(f"{self.root}/{name}")

    def _say(self, name: str, text: str) -> None:
        out = self._files.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _said(self, name: str) -> str | None:
        if not self._files.exists(self._path(name)):
            return None
        stream = self._files.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, table: str) -> bool:
        return self._said(f"{table}/_now") is not None

    def replace(self, table: str, rows: DataFrame) -> None:
        """The whole table anew."""
        version = uuid.uuid4().hex[:12]
        rows.write.parquet(f"{self.root}/{table}/{version}")
        self._say(f"{table}/_now", json.dumps([version, rows.schema.json()]))

    def replace_parts(self, table: str, rows: DataFrame, by: str) -> None:
        """The partitions of ``by`` that ``rows`` have; the others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{table}/parts")
        self._say(f"{table}/_now", json.dumps(["parts", rows.schema.json()]))

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """The current version (or an empty table of ``schema``); filters and columns reach the scan."""
        now = self._said(f"{table}/_now")
        if now is None:
            if schema is None:
                raise LookupError(f"no table {table}")
            return self.spark.createDataFrame([], schema)
        version, kept = json.loads(now)
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(kept))).parquet(f"{self.root}/{table}/{version}")
        return rows if schema is None else conform(rows, schema)

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows of the same key give way to the new ones."""
        if self.exists(table):
            kept = self.read(table).join(rows.select(*keys).distinct(), keys, "left_anti")
            rows = kept.unionByName(rows, allowMissingColumns=True)
        self.replace(table, rows)

    def set(self, key: str, value: Any) -> None:
        """One setting, as JSON."""
        self._say(f"settings/{key}", json.dumps(value))

    def get(self, key: str, default: Any = None) -> Any:
        text = self._said(f"settings/{key}")
        return default if text is None else json.loads(text)

    def once(self, table: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that is built on first use."""
        if not self.exists(table):
            self.replace(table, build())
        return self.read(table)


_STORES: dict[str, str] = {}


def session_store(spark: SparkSession) -> Store:
    """The store of this application: under ``spark.checkpoint.dir``, or a temporary folder in a local session."""
    app = spark.sparkContext.applicationId
    if app not in _STORES:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not (spark.sparkContext.master + "[").startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="barline-store-")
        _STORES[app] = f"{root.rstrip('/')}/store-{app}"
    return Store(spark, _STORES[app])


def settled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the application's store and read back: what follows uses them many times."""
    store, table = session_store(rows.sparkSession), f"settled/{name}-{uuid.uuid4().hex[:12]}"
    store.replace(table, rows)
    return store.read(table)


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in a newer schema: new columns NULL, types cast, unknown columns dropped."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def merged_columns(old: DataFrame, new: DataFrame, key: str, provided: list[str]) -> DataFrame:
    """Upsert of the provided columns only; a provided NULL overwrites, other columns stay."""
    fresh = new.select(key, *[F.col(c).alias(f"__{c}") for c in provided], F.lit(True).alias("__new"))
    j = old.join(fresh, key, "full_outer")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) if c in provided else F.col(c)
    return j.select(key, *[value(c).alias(c) for c in old.columns if c != key])


def known_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and how many know each column, in one pass."""
    return rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns])


def active_members(members: DataFrame, universe: str | None = None) -> DataFrame:
    """Symbols that belong to a universe now."""
    now = members.filter("active")
    return (now.filter(F.col("universe") == universe) if universe else now).select("universe", "symbol")


def universe_status(members: DataFrame, states: DataFrame) -> DataFrame:
    """By universe: active members, those in sync, failures, and the newest bar of all."""
    j = members.filter("active").join(states, "symbol", "left")
    return j.groupBy("universe").agg(
        F.count("*").alias("n_members"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("n_synced"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"),
        F.max("last_bar").alias("last_bar"),
    )


def needs_refresh(newest: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: newest bar, date of the stored snapshot, and whether it is behind (or missing)."""
    a, b = newest.agg(F.max("date").alias("bars_date")), stored.agg(F.max("date").alias("stored_date"))
    return a.crossJoin(b).withColumn("stale", F.coalesce(F.col("stored_date") < F.col("bars_date"), F.col("stored_date").isNull() & F.col("bars_date").isNotNull()))


def ownership_pair(history: DataFrame) -> DataFrame:
    """The newest report of each symbol beside the one before it."""
    w = Window.partitionBy("symbol").orderBy("date_reported")
    h = history.withColumns({"prev_pct": F.lag("pct_held").over(w), "prev_date": F.lag("date_reported").over(w), "__k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date_reported").desc()))})
    return h.filter("__k = 1").select("symbol", "date_reported", "pct_held", "prev_date", "prev_pct")


def backfill_plan(wanted: DataFrame, states: DataFrame, target: str, overlap: int = 7) -> DataFrame:
    """What to load: nothing if current, all history for new or failed symbols, else from ``overlap`` days before the last bar."""
    t = F.lit(target).cast("date")
    j = wanted.select("symbol").distinct().join(states.select("symbol", "last_bar", "status"), "symbol", "left")
    full = F.col("last_bar").isNull() | (F.coalesce("status", F.lit("")) == "failed")
    j = j.withColumn("mode", F.when(full, "full").when(F.col("last_bar") >= t, "current").otherwise("incremental"))
    return j.filter("mode <> 'current'").select("symbol", "mode", F.when(F.col("mode") == "incremental", F.date_sub("last_bar", overlap)).alias("start"))


def phases(wanted: DataFrame, known: DataFrame, today: str, ages: dict[str, int]) -> DataFrame:
    """A row for each phase and symbol that is due: its stamp is missing or older than the phase's days."""
    j = wanted.select("symbol").distinct().join(known, "symbol", "left")
    t = F.lit(today).cast("date")
    due = [F.when(F.coalesce(F.datediff(t, F.col(column)) > days, F.lit(True)), F.lit(column)) for column, days in ages.items()]
    return j.select("symbol", F.explode(F.array_compact(F.array(*due))).alias("phase"))


def first_known(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Each output column is the first of its source columns that is known."""
    have = set(rows.columns)
    return rows.withColumns({out: F.coalesce(*[F.col(c) for c in cs if c in have], F.lit(None)) for out, cs in names.items()})


def fresh_or_cached(fetched: DataFrame, cached: DataFrame, today: str, max_age: int) -> DataFrame:
    """Cached members while young enough, else the fetched ones, else the cached ones after all."""
    age = F.datediff(F.lit(today).cast("date"), F.max("fetched_at"))
    young = cached.groupBy("universe").agg((age <= max_age).alias("young"))
    got = fetched.select("universe").distinct().withColumn("got", F.lit(True))
    choice = young.join(got, "universe", "full_outer").select("universe", (F.coalesce("young", F.lit(False)) | F.col("got").isNull()).alias("old"))
    a = cached.select("universe", "symbol").join(choice.filter("old"), "universe").drop("old")
    return a.unionByName(fetched.select("universe", "symbol").join(choice.filter("not old"), "universe").drop("old"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def closes_grid(bars: DataFrame, key: Column | None = None) -> DataFrame:
    """Closes on the dates on which any symbol has one, carried forward over a symbol's gaps."""
    known = bars.filter("close is not null")
    span = known.groupBy("symbol").agg(F.min("date").alias("__first"))
    dates = known.select("date").distinct()
    each = dates.join(span, F.col("date") >= F.col("__first")).select("symbol", "date")
    j = each.join(known.select("symbol", "date", "close"), ["symbol", "date"], "left")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("symbol", "date", F.last("close", ignorenulls=True).over(w).alias("close"))
