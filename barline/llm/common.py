"""Shared pieces of the text operators.

Texts travel to Python as UTF-8 bytes (``cast("binary")``) and are handled in
slices of bounded size with numpy, so a Python worker holds a few times
``SLICE`` bytes however large its partition is.  A word is a maximal run of
bytes other than U+0020 and U+0009..U+000D; a null text has no words.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (one longer document is one slice).
SLICE = 1 << 20
#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20
#: The largest table that an operator broadcasts by itself, in bytes.
BROADCAST_BYTES = 64 << 20
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches at ``BATCH_BYTES`` in this session, whatever the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not str(spark.conf.get(name)).rstrip("bB").isdigit() or int(str(spark.conf.get(name)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a session on one
    machine gets a temporary folder; on a cluster it is an error.
    """
    bounded(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession, name)}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_staged: list[str] = []


def n_staged() -> int:
    return len(_staged)


def discard(spark: SparkSession, since: int, last: int = 1) -> None:
    """Delete the steps written after the first ``since`` but for the ``last`` ones: for a caller that reads no others of them any more."""
    gone = _staged[since : len(_staged) - last]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _staged[since : since + len(gone)]


def trim() -> None:
    """Give freed memory back to the system; Python workers live longer than tasks."""
    global _powers, _inverses
    if len(_powers) > 2 * SLICE:
        _powers = _inverses = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim_driver(spark: SparkSession) -> None:
    """``trim`` for the driver, its JVM too (where the JVM has the command)."""
    trim()
    try:
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        calls = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        given = array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        next(c for c in calls if c.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # another JVM: nothing depends on it
        pass


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with ``trim`` at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def vector_sums(parts: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Sums of the vectors ``v`` (bytes of ``kind``) by ``k``, for a few values of ``k``.

    Each ``k`` is summed by one task that reads the vectors as a stream and holds
    one sum, so that memory does not grow with the number of tasks.  Integers are
    summed and returned in 64 bits; floats are summed in 64 bits and returned as they came.
    """
    floats = np.issubdtype(kind, np.floating)
    wide, given = (np.float64, kind) if floats else (np.int64, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), kind)
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.astype(wide)
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "v": pa.array([x.astype(given).tobytes() for x in total.values()], pa.binary())})

    found = parts.select("k", "v").repartition(16, "k").mapInArrow(light(add), "k int, v binary").toArrow()
    sums = {k: np.frombuffer(v.as_buffer(), given) for k, v in zip(found.column("k").to_pylist(), found.column("v"), strict=True)}
    trim()
    return sums


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row; rows that are alike in all columns share it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() != "map"])


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files that no live frame refers to."""
    for _ in range(2):  # Python's references go first, then the JVM's
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def small(df: DataFrame, row_bytes: int, n_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its known row count keeps it small."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


def word_array(text: Column | str) -> Column:
    """The words of a text as an array, JVM-side (empty for null)."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(pieces, lambda w: w != "")


def n_words(text: Column | str) -> Column:
    """Number of words, JVM-side: runs of non-spaces that begin after a space."""
    text = F.col(text) if isinstance(text, str) else text
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " +"), lambda w: w != "")).cast("long")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    buf, offs = raw(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n, a + 50_000)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _BASE + (b ^ (b >> np.uint64(31))) * _M1 + np.uint64(0x51ED27))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A cheaper ``join2``, made in place on a new array."""
    h = a * _BASE
    h += b * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers, _inverses


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``buf``."""
    powers, _ = _grow(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    _, inverses = _grow(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the row of each; words never cross rows."""
    inside = ~_SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs[:-1]] = True
    first = first[:-1]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (first | ~before))
    last = np.zeros(len(buf) + 1, bool)
    last[offs[1:]] = True
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (last[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def ngrams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``h`` and a mask of those that lie in one row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out, width = h, 1
    while width < n:  # a width at most doubled each time; overlaps do no harm
        step = min(width, n - width)
        out = join2(out[: len(out) - step], out[step:])
        width += step
    return out, rows[n - 1 :] == rows[: len(rows) - n + 1]


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, sorted (numpy's hashing ``unique`` is many times slower than its sort)."""
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each different key begins in it, and how often it occurs."""
    # A plain sort is far faster than an argsort: sort the leading bits with the index in the low bits.
    low = np.uint64((1 << max(1, int(len(keys)).bit_length())) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    key = keys[order]
    cut = (packed[1:] ^ packed[:-1]) <= low
    if (key[1:][cut] != key[:-1][cut]).any():  # different keys with equal leading bits: rare, sort them whole
        order = np.argsort(keys)
        key = keys[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, head, np.diff(np.append(head, len(key)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order, _, size = grouped(keys)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(size > 1, size)
    return out
