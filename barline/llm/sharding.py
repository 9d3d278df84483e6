"""Size-tiered shards behind a versioned manifest (JVM only).

``append`` writes an arrival as small immutable shards, one or more files for
each input partition, without a shuffle.  ``compact`` takes runs of shards of
similar size (the same power of ``FANOUT``), in arrival order, and merges each
run into one file of about ``target`` bytes.  Both end with the commit of a new
manifest version: a complete list of live shards is written as a table of its
own, then a marker file ``vN`` that names the table is put in place in one step
that fails if ``vN`` exists (a rename without overwriting, or a hard link on a
local disk).  Only markers count, so of two writers one commits and the other
gets ``Conflict``; files that no marker leads to do not exist for readers.  A lost
executor or driver leaves at most orphans, which ``vacuum`` removes once they are
older than its grace period.

The manifest names files relative to the folder and is summed and joined as a
table.  Reads and merges open only the data folders, or the files, that the
manifest names; a merge handles groups of at most ``FILES`` files at a time, one
commit each, so that the list of files on the driver is bounded.

Nulls and edge cases: rows are carried as they are, with all columns, nulls,
repeats and empty texts; an empty arrival commits a manifest with no new shard; a
run of one shard is left alone; shards of ``target`` bytes or more are final;
``read`` puts underscores after the names of its own columns where the rows have
columns of these names.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

TARGET = 128 << 20
FANOUT, MIN_RUN = 4, 2
RECORDS = 4_000
#: Files of one run, and files that one round of a merge opens.
RUN_FILES, FILES = 5_000, 50_000
GRACE_SECONDS = 24 * 3600
MANIFEST = "file string, generation int, n_docs long, n_bytes long, seq long"
#: A file's place below the lake's folder.
_PLACE = r"/(data/[^/]+/.*)$"


class Conflict(RuntimeError):
    """Another writer committed the manifest version first."""


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed manifest versions, oldest first."""
    store, path = _store(spark, folder)
    if not store.exists(path("manifest")):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path("manifest"))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def _table(spark: SparkSession, folder: str, version: int) -> str:
    """The folder of the table that a marker names."""
    store, path = _store(spark, folder)
    stream = store.open(path(f"manifest/v{version:08d}"))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The live shards of a version (the last one by default)."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/{_table(spark, folder, known[-1] if version is None else version)}")


def _place(spark: SparkSession, folder: str, own: str, final: str) -> bool:
    """Put the file ``own`` in the place of ``final`` in one step, unless that exists."""
    store, path = _store(spark, folder)
    jvm, java = spark._jvm, spark.sparkContext._gateway
    try:
        if store.getUri().getScheme() == "file":
            paths = [jvm.java.nio.file.Paths.get(path(x).toUri().getPath(), java.new_array(jvm.java.lang.String, 0)) for x in (final, own)]
            jvm.java.nio.file.Files.createLink(*paths)
            store.delete(path(own), False)
        else:
            options = java.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(path(own), path(final), options)
    except Exception:
        if not store.exists(path(final)):
            raise
        store.delete(path(own), False)
        return False
    return True


def commit(shards: DataFrame, folder: str, version: int) -> int:
    """Write ``shards`` as manifest ``version``; raises ``Conflict`` if it exists."""
    spark = shards.sparkSession
    store, path = _store(spark, folder)
    table = f"manifest/t{version:08d}-{uuid.uuid4().hex}"
    n = shards.count()
    shards.coalesce(max(1, n // 1_000_000)).write.parquet(f"{folder}/{table}")
    own, final = f"manifest/.new-{uuid.uuid4().hex}", f"manifest/v{version:08d}"
    out = store.create(path(own), False)
    out.write(bytearray(table.encode()))
    out.close()
    if not _place(spark, folder, own, final):
        store.delete(path(table), True)
        raise Conflict(final)
    return version


def _arrived(spark: SparkSession, place: str, after: int, schema) -> DataFrame:
    """Manifest rows of the files under ``place``: sizes from file metadata, no column is read."""
    files = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(place)
    found = files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_docs"))
    rows = found.select(F.regexp_extract("path", _PLACE, 1).alias("file"), F.lit(0).alias("generation"), "n_docs", "n_bytes")
    return C.stage(rows.withColumn("seq", F.lit(after) + F.xxhash64("file").bitwiseAND(F.lit(0xFFFFFFFF))), "arrived")


def append(docs: DataFrame, folder: str, records: int = RECORDS) -> int:
    """Add an arrival as small shards and commit; returns the manifest version."""
    spark = docs.sparkSession
    known = versions(spark, folder)
    version = (known[-1] if known else 0) + 1
    place = f"{folder}/data/arrival-{version:08d}-{uuid.uuid4().hex[:8]}"
    docs.write.option("compression", "zstd").option("maxRecordsPerFile", records).parquet(place)
    fresh = _arrived(spark, place, version << 32, docs.schema)
    return commit(manifest(spark, folder).unionByName(fresh), folder, version)


def runs(shards: DataFrame, target: int = TARGET, fanout: int = FANOUT, min_run: int = MIN_RUN) -> DataFrame:
    """``file`` and ``run`` (0, 1, ...) of the shards that are to be merged.

    Shards of one tier, in arrival order, fill runs up to ``target`` bytes or
    ``RUN_FILES`` files.  A run needs ``min_run`` shards, so nothing is rewritten
    for no gain.
    """
    tier = F.floor(F.log(F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")) / math.log(fanout))
    open_ = shards.filter(F.col("n_bytes") < target).withColumn("tier", tier)
    order = Window.partitionBy("tier").orderBy("seq", "file").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.struct(F.floor(F.coalesce(F.sum("n_bytes").over(order), F.lit(0)) / target), F.floor(F.count("*").over(order) / RUN_FILES))
    placed = open_.withColumn("slot", slot)
    full = placed.groupBy("tier", "slot").agg(F.count("*").alias("n")).filter(F.col("n") >= min_run)
    numbered = full.withColumn("run", F.row_number().over(Window.orderBy("tier", "slot")) - 1).select("tier", "slot", "run")
    return placed.join(numbered, ["tier", "slot"]).select("file", F.col("run").cast("int").alias("run"))


def _merge(spark: SparkSession, folder: str, schema, live: DataFrame, plan: DataFrame, version: int) -> int:
    """Merge the planned runs, one file each, and commit ``version``."""
    files = [r["file"] for r in plan.select("file").collect()]  # at most about FILES
    n_runs = plan.select("run").distinct().count()
    place = f"data/merged-{version:08d}-{uuid.uuid4().hex[:8]}"
    rows = spark.read.schema(schema).parquet(*[f"{folder}/{f}" for f in files])
    names = [f"`{f.name}`" for f in schema]
    tagged = rows.select(F.struct(*names).alias("__row"), F.regexp_extract("_metadata.file_path", _PLACE, 1).alias("__file"))
    chosen = C.small(plan.select(F.col("file").alias("__file"), F.col("run").alias("__run")), 400, len(files))
    merged = tagged.join(chosen, "__file").repartitionById(n_runs, F.col("__run"))
    merged.select("__row.*", "__run").write.partitionBy("__run").option("compression", "zstd").parquet(f"{folder}/{place}")
    taken = live.join(plan, "file").groupBy("run").agg(F.sum("n_docs").alias("n_docs"), (F.max("generation") + 1).alias("generation"))
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/{place}")
    sizes = written.select(F.regexp_extract("path", _PLACE, 1).alias("file"), F.regexp_extract("path", r"__run=(\d+)/", 1).cast("int").alias("run"), F.col("length").alias("n_bytes"))
    fresh = sizes.join(taken, "run").select("file", "generation", "n_docs", "n_bytes", (F.lit(version << 32) + F.col("run")).alias("seq"))
    return commit(live.join(plan, "file", "left_anti").unionByName(C.stage(fresh, "merged")), folder, version)


def compact(spark: SparkSession, folder: str, schema, target: int = TARGET) -> int:
    """Merge runs of similar shards; returns the last manifest version (the old one if nothing to do)."""
    version = versions(spark, folder)[-1]
    plan = C.stage(runs(manifest(spark, folder), target), "runs")
    by_run = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)  # a row for each run
    rounds = plan.groupBy("run").agg(F.count("*").alias("n")).withColumn("round", F.floor((F.sum("n").over(by_run) - F.col("n")) / FILES))
    plan = C.stage(plan.join(rounds.select("run", "round"), "run"), "rounds")
    for k in range((plan.agg(F.max("round")).first()[0] or 0) + 1 if plan.limit(1).count() else 0):
        part = plan.filter(F.col("round") == k)
        first = part.agg(F.min("run")).first()[0]
        if first is not None:
            version = _merge(spark, folder, schema, manifest(spark, folder), part.select("file", (F.col("run") - first).alias("run")), version + 1)
    return version


def vacuum(spark: SparkSession, folder: str, grace_seconds: float = GRACE_SECONDS) -> None:
    """Remove data folders that the last manifest does not list, and older manifests, once they are older than the grace period.

    The grace period keeps what a writer has not committed yet and what a reader of an older version still opens.
    """
    store, path = _store(spark, folder)
    known = versions(spark, folder)
    names = set(_folders(manifest(spark, folder)))
    before = (time.time() - grace_seconds) * 1000
    for status in store.listStatus(path("data")):
        if status.getPath().getName() not in names and status.getModificationTime() <= before:
            store.delete(status.getPath(), True)
    for v in known[:-1]:
        if store.getFileStatus(path(f"manifest/v{v:08d}")).getModificationTime() <= before:
            store.delete(path(_table(spark, folder, v)), True)
            store.delete(path(f"manifest/v{v:08d}"), True)


def _folders(live: DataFrame) -> list[str]:
    """The data folders of the shards: one for each commit that is still in use."""
    return sorted(r["d"] for r in live.select(F.regexp_extract("file", r"^data/([^/]+)/", 1).alias("d")).distinct().collect())


def read(spark: SparkSession, folder: str, schema, version: int | None = None) -> DataFrame:
    """Rows of the live shards, with ``shard`` (its number), ``generation``, ``shard_docs`` and ``shard_bytes``."""
    live = manifest(spark, folder, version)
    n, places = live.count(), _folders(live)
    names = [f.name for f in schema]
    own = {}
    for c in ("shard", "generation", "shard_docs", "shard_bytes"):
        own[c] = c
        while own[c].lower() in {x.lower() for x in names}:
            own[c] += "_"
    order = Window.orderBy("seq", "file")  # manifest rows only
    about = F.struct((F.row_number().over(order) - 1).cast("long").alias("s"), F.col("generation").alias("g"), F.col("n_docs").alias("d"), F.col("n_bytes").alias("b"))
    listed = live.select(F.col("file").alias("__file"), about.alias("__own"))
    if places:
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{folder}/data/{p}" for p in places])
        tagged = rows.select(F.struct(*[f"`{c}`" for c in names]).alias("__row"), F.regexp_extract("_metadata.file_path", _PLACE, 1).alias("__file"))
    else:
        tagged = spark.createDataFrame([], schema).select(F.struct(*[f"`{c}`" for c in names]).alias("__row"), F.lit("").alias("__file"))
    found = tagged.join(C.small(listed, 400, n), "__file")
    return found.select("__row.*", *[F.col(f"__own.{k}").alias(own[c]) for k, c in zip("sgdb", own, strict=True)])


def shard(docs: DataFrame, folder: str, target: int = TARGET, records: int = RECORDS) -> DataFrame:
    """Append ``docs``, compact and read back."""
    spark = docs.sparkSession
    append(docs, folder, records)
    compact(spark, folder, docs.schema, target)
    vacuum(spark, folder, 0)  # nobody else knows the folder yet
    return read(spark, folder, docs.schema)
