"""Quality rules: plain text statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over a trusted
target, one over the whole raw corpus.  A document's score is the mean over its
n-grams of ``log p_target - log p_raw`` (length-normalised), and it is kept if
no base rule fails and the score reaches a fixed threshold.

The counts cover every document.  Each task sums its own counts first, tasks'
counts are summed by bucket slices, and the model that goes back to the tasks
has ``2**BITS`` entries whatever the input's size.

Nulls and edge cases: a null or empty text has no words, so it fails the base
rules and scores 0; null labels are not trusted; repeated rows are judged one by
one; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Buckets of the hashed multinomials, as a power of two, and the n-gram width in bytes.
BITS, WIDTH = 18, 4
#: Pseudo-count of every bucket, as a share of the raw multinomial.
SMOOTHING = 1_000.0
#: Mean log-likelihood ratio below which a document is rejected.
THRESHOLD = -0.5
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SLICES = 64


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and the row of each n-gram; none crosses rows."""
    n = len(buf) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(WIDTH):
        code = (code << np.uint32(8)) | buf[k : k + n]
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = rows[:n] == rows[WIDTH - 1 :]
    return (code >> np.uint32(32 - BITS))[whole].astype(np.int64), rows[:n][whole]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        trusted = np.array(batch.column("trusted").fill_null(False).to_pylist(), dtype=bool)
        for a, b, buf, offs in C.slices(batch.column("text")):
            buckets, rows = _grams(buf, offs)
            counts[0] += np.bincount(buckets, minlength=1 << BITS)
            if trusted[a:b].any():
                counts[1] += np.bincount(buckets[trusted[a:b][rows]], minlength=1 << BITS)
    parts = counts.reshape(2, _SLICES, -1)
    yield pa.RecordBatch.from_pydict({"k": pa.array(range(_SLICES), pa.int32()), "v": [parts[:, k].tobytes() for k in range(_SLICES)]})


def fit(docs: DataFrame, text: str = "text", trusted: str = "trusted") -> np.ndarray:
    """The log-likelihood ratio of each bucket (a fixed number of doubles)."""
    C.bounded(docs.sparkSession)
    chosen = docs.select(F.col(text).cast("binary").alias("text"), F.col(trusted).cast("boolean").alias("trusted"))
    parts = C.vector_sums(chosen.mapInArrow(C.light(_count), "k int, v binary"), np.int64)
    if not parts:
        return np.zeros(1 << BITS)
    counts = np.concatenate([parts[k].reshape(2, -1) for k in range(_SLICES)], axis=1).astype(float)
    rest = (counts[0] + 1) / (counts[0] + 1).sum()
    if not counts[1].sum():
        return np.zeros(1 << BITS)
    target = (counts[1] + SMOOTHING * rest) / (counts[1].sum() + SMOOTHING)
    return np.log(target) - np.log(rest)


def statistics(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Base statistics of each row."""
    rows_n = len(offs) - 1
    space = C._SPACE[buf]
    starts, ends, rows = C.word_spans(buf, offs)
    prefix = C.prefix_hash(buf)
    words = np.bincount(rows, minlength=rows_n)
    # words in windows found twice
    h, whole = C.ngrams(C.span_hash(prefix, starts, ends), rows, WINDOW)
    at = np.flatnonzero(whole)
    keys = C.join2(h[at], rows[at].astype(np.uint64))
    marks = np.zeros(len(starts) + 1, np.int64)
    twice = at[C.repeated(keys)]
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    covered = np.cumsum(marks[:-1]) > 0
    # lines with a word that equal an earlier one
    cut = np.flatnonzero(buf == 10)
    line_starts = np.union1d(offs[:-1], cut + 1)
    line_starts = line_starts[line_starts < len(buf)]
    line_rows = np.searchsorted(offs, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(buf)), offs[line_rows + 1])
    line_ends = line_ends - (buf[np.maximum(line_ends - 1, 0)] == 10) * (line_ends > line_starts)
    with_word = np.concatenate([[0], np.cumsum(~space)])
    filled = with_word[line_ends] > with_word[line_starts]
    line_starts, line_ends, line_rows = line_starts[filled], line_ends[filled], line_rows[filled]
    lines = C.join2(C.span_hash(prefix, line_starts, line_ends), line_rows.astype(np.uint64))
    order, head, _ = C.grouped(lines)
    distinct = np.bincount(line_rows[order[head]], minlength=rows_n)
    return {
        "n_words": words,
        "word_chars": C.per_row(~space & ((buf & 0xC0) != 0x80), offs),
        "n_symbols": C.per_row(_SYMBOL[buf], offs),
        "n_dup_lines": np.bincount(line_rows, minlength=rows_n) - distinct,
        "n_repeat_words": np.bincount(rows[covered], minlength=rows_n),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def _judged(table: np.ndarray, buf: np.ndarray, offs: np.ndarray, threshold: float) -> dict[str, pa.Array]:
    """Statistics, score and verdict of each row."""
    s = statistics(buf, offs)
    buckets, rows = _grams(buf, offs)
    n = np.bincount(rows, minlength=len(offs) - 1)
    llr = np.bincount(rows, weights=table[buckets], minlength=len(offs) - 1) / np.maximum(n, 1)
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
    out = {k: pa.array(v, pa.int64()) for k, v in s.items()}
    return out | {"llr": pa.array(llr), "base_failed": pa.array(failed), "kept": pa.array(~failed & (llr >= threshold))}


def apply(docs: DataFrame, model: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, statistics, score and verdict of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # 2**BITS floats
    chosen = docs.select("doc_id", F.col(text).cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:b]} | _judged(sent.value, buf, offs, threshold))

    schema = T.StructType([chosen.schema["doc_id"]])
    for name, kind in (x.split() for x in SCHEMA.split(", ")):
        schema = schema.add(name, kind)
    return chosen.mapInArrow(C.light(score), schema)


def with_trust(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``trusted``: the row's key has a label of quality 1 (once, however often it is labelled)."""
    good = labels.filter("quality = 1").select(F.col(key).alias("__k")).distinct().withColumn("trusted", F.lit(True))
    # Both sides grow with the corpus: one plan at every size, and no broadcast of ids.
    return docs.select(key, "text").join(good.hint("merge"), F.col(key) == F.col("__k"), "left").drop("__k")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``docs`` with the labelled rows of quality 1 as the target, then judge all of ``docs``."""
    return apply(docs, fit(with_trust(docs, labels)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are (each row goes to Python once)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(with_trust(docs, labels)).astype(np.float32))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("row").field("text")):
                yield pa.RecordBatch.from_arrays([batch.column("row")[a:b].filter(_judged(sent.value, buf, offs, THRESHOLD)["kept"])], ["row"])

    whole = docs.select(F.struct("*").alias("row"))
    return whole.mapInArrow(C.light(passing), whole.schema).select("row.*")
