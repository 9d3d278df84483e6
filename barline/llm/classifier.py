"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document's statistics (shape of its text; no ids, labels, source or language)
are standardised and mapped to ``FEATURES`` random cosines, which approximate a
Gaussian kernel.  Each task sums its rows' normal equations (a matrix of fixed
size), the sums are added up in two levels, and the driver solves the ridge
system.  Predictions of the training rows, counted in fixed bins, are made
monotone by pooling adjacent violators; the steps, interpolated, are the score.

Null and empty texts have all statistics 0 and are scored like any other; null
labels are not learned from; a label row is one training row, so repeats weigh
more; without any training row every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .rules import statistics

FEATURES, GAMMA, RIDGE, SEED = 384, 0.03, 1e-2, 17
BINS, LOW, HIGH = 2000, -0.5, 1.5
THRESHOLD = 0.3
_ADDERS = 16


def _share(buf: np.ndarray, offs: np.ndarray, members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return C.per_row(table[buf], offs)


def describe(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The statistics of each row of a slice, a row of floats each."""
    s = statistics(buf, offs)
    size = np.maximum(np.diff(offs), 1)
    words = np.maximum(s["n_words"], 1)
    lines = C.per_row(buf == 10, offs) + 1
    starts, ends, rows = C.word_spans(buf, offs)
    h = C.span_hash(C.prefix_hash(buf), starts, ends)
    order, head, _ = C.grouped(C.join2(h, rows.astype(np.uint64)))
    distinct = np.bincount(rows[order[head]], minlength=len(size))
    lens = ends - starts
    mean = s["word_chars"] / words
    square = np.bincount(rows, weights=lens.astype(float) ** 2, minlength=len(size)) / words
    upper = np.zeros(256, bool)
    upper[65:91] = True
    heads = np.bincount(rows, weights=upper[buf[starts]].astype(float), minlength=len(size))
    columns = [
        np.log1p(s["n_words"]),
        mean,
        np.sqrt(np.maximum(square - (np.bincount(rows, weights=lens, minlength=len(size)) / words) ** 2, 0)),
        np.log1p(100.0 * s["n_symbols"] / size),
        s["n_symbols"] / words,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words,
        distinct / words,
        np.log1p(s["n_words"] / lines),
        heads / words,
        100.0 * _share(buf, offs, bytes(range(65, 91))) / size,
        100.0 * _share(buf, offs, bytes(range(48, 58))) / size,
        100.0 * _share(buf, offs, b".!?") / size,
        100.0 * _share(buf, offs, b",;:") / size,
        100.0 * _share(buf, offs, b"|") / size,
        100.0 * _share(buf, offs, b"#*$%&<>=/\\_{}[]@") / size,
        100.0 * _share(buf, offs, bytes(range(128, 256))) / size,
        np.bincount(rows, weights=(lens <= 3).astype(float), minlength=len(size)) / words,
        np.bincount(rows, weights=(lens >= 15).astype(float), minlength=len(size)) / words,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def describe_all(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (packed 32-bit floats) of every row."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("text")):
                x = describe(buf, offs)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:b], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return chosen.mapInArrow(C.light(run), "doc_id long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    values = b"".join(v.as_py() for v in column)
    return np.frombuffer(values, np.float32).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.theta: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def _added(train: DataFrame, sums, width: int) -> np.ndarray:
    """Adds ``sums(x, y)``, a vector of ``width`` floats, over all rows: per task, then piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                if part.num_rows:
                    total += sums(_matrix(part.column("x")), np.array(part.column("y").to_pylist(), float))
        pieces = np.array_split(total, _ADDERS)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(_ADDERS), pa.int32()), "v": [p.tobytes() for p in pieces]})

    found = C.vector_sums(train.mapInArrow(C.light(run), "k int, v binary"), np.float64)
    return np.concatenate([found[k] for k in range(_ADDERS)]) if found else np.zeros(width)


def pool(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame) -> Model | None:
    """``train``: ``x`` and ``y`` (0 or 1)."""
    first = train.select(F.octet_length("x").alias("n")).limit(1).collect()
    if not first:
        return None
    d = first[0]["n"] // 4
    moments = _added(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 1 + 2 * d)
    n, mean = moments[0], moments[1 : 1 + d] / moments[0]
    model = Model(mean, np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 1e-12)) + 1e-6)
    p = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.phi(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _added(train, normal, p * p + p)
    a = sums[: p * p].reshape(p, p) + RIDGE * np.eye(p)
    model.theta = np.linalg.solve(a, sums[p * p :])

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    counts = _added(train, bins, 2 * BINS).reshape(2, -1)
    some = np.flatnonzero(counts[0])
    value = pool(counts[1][some] / counts[0][some], counts[0][some])
    model.steps = (LOW + (some + 0.5) * (HIGH - LOW) / BINS, value)
    return model


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; learns from labelled rows that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    described = C.stage(describe_all(docs, key, text).withColumn("held_out", F.coalesce(held, F.lit(False))), "described")
    known = labels.filter("quality in (0, 1)").select(F.col(key).cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    train = C.stage(described.filter("not held_out").join(known.hint("merge"), "doc_id").select("x", "y"), "train")
    model = fit(train)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column("x"))
                score = own.score(x) if own is not None else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "score": pa.array(score),
                        "predicted": pa.array((score >= THRESHOLD).astype(np.int32)),
                    }
                )

    return described.mapInArrow(C.light(run), "doc_id long, held_out boolean, score double, predicted int")
