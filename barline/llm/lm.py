"""Stupid-backoff language-model scores, leave-one-out, from n-gram count tables.

Every document is scored with the counts of all others:

    S(w | u v) = c(uvw) / c(uv)            if c(uvw) > 0
                 0.4 * S(w | v)            otherwise
    S(w)       = (c(w) + 1) / (N + 1)

where c and N are corpus counts less the document's own, and the score is the sum
of ``ln S`` over its words (and their mean).

The count tables are partitioned by n-gram hash into buckets, each a group of
packed (hash, count) rows.  Texts are packed into blocks; a block's exploded
n-grams are counted inside the block first, joined to the buckets, and only the
totals of n-grams that other blocks have come back, to be summed per document.
So a frequent n-gram travels once a block.  In a bucket an n-gram is known by 40
bits of its hash; the number of buckets grows with the input, so that two of a
bucket's n-grams share them with a chance under 1 in 50,000 at any size.

Null and empty texts have no words, sum 0 and a null mean; null ids and repeated
rows are scored like any row (a repeat counts as another document); an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, BACKOFF = 3, 0.4
BLOCK = 4 << 20
#: Bytes of text for each bucket of a count table.
BUCKET = 16 << 20

_PACKED = "block long, ids array<long>, lens array<long>, data binary"
_KEYS = "bucket int, block long, keys binary, counts binary"
_TOTALS = "bucket int, block long, seen binary, totals binary"
_OUT = "doc_id long, n_words long, log_score double, mean_log double"


def pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of about ``BLOCK`` bytes, each from one input partition."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("text"), BLOCK):
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([first + made], pa.int64()),
                        "ids": pa.array([batch.column("id")[a:b].to_pylist()], pa.list_(pa.int64())),
                        "lens": pa.array([np.diff(offs).tolist()], pa.list_(pa.int64())),
                        "data": pa.array([pa.compress(buf.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                    }
                )
                made += 1

    return C.stage(rows.mapInArrow(run, _PACKED), "lm-blocks")


def _words(row: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a block's words, the document of each, and the number of documents."""
    offs = np.concatenate([[0], np.cumsum(np.array(row["lens"], np.int64))])
    n = int(offs[-1])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(offs) - 1
    buf = np.frombuffer(pa.decompress(row["data"], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    starts, ends, rows = C.word_spans(buf, offs)
    return C.span_hash(C.prefix_hash(buf), starts, ends), rows, len(offs) - 1


def _tables(h: np.ndarray, rows: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``order``: the n-gram hash that ends at each word, and whether one does."""
    out = []
    for n in range(1, order + 1):
        keys, whole = C.ngrams(h, rows, n)
        full, ok = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        full[n - 1 :][whole], ok[n - 1 :] = C.mix(keys[whole] + np.uint64(n)), whole
        out.append((full, ok))
    return out


def _distinct(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k[ok] for k, ok in tables])
    order, head, size = C.grouped(keys)
    return keys[order[head]], size


def _edges(keys: np.ndarray, shift: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(64 - shift), np.arange((1 << shift) + 1, dtype=np.uint64))


def _zip(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=struct.unpack("<Q", data[:8])[0], codec="zstd", asbytes=True)


def _zip_counts(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where one needs them."""
    wide = len(counts) > 0 and int(counts.max()) >= 1 << 32
    return bytes([wide]) + _zip(counts.astype(np.uint64 if wide else np.uint32).tobytes())


def _unzip_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(_unzip(data[1:]), np.uint64 if data[0] else np.uint32)


def _sum(table: pa.Table) -> pa.Table:
    """One bucket of the count tables: totals of its n-grams, told to blocks where they exceed the block's own."""
    blocks = table.column("block").to_pylist()
    keys, counts, sizes = [], [], []
    for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
        raw = k.as_py()
        n = len(raw) // 5
        keys.append(np.frombuffer(raw, np.uint32, n).astype(np.uint64) | (np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)))
        counts.append(np.frombuffer(_unzip(c.as_py()), np.uint32))
        sizes.append(n)
    key, own = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(own[order], head)
    total = np.zeros(len(key), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(head, len(key))))
    out: dict[str, list] = {"block": [], "seen": [], "totals": []}
    at = 0
    for block, n in zip(blocks, sizes, strict=True):
        t, o = total[at : at + n], own[at : at + n]
        at += n
        seen = t > o
        if seen.any():
            out["block"].append(block)
            out["seen"].append(np.packbits(seen).tobytes())
            out["totals"].append(_zip_counts(t[seen]))
    m = len(out["block"])
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()] * m, pa.int32()),
            "block": pa.array(out["block"], pa.int64()),
            "seen": pa.array(out["seen"], pa.binary()),
            "totals": pa.array(out["totals"], pa.binary()),
        }
    )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row a document: ``doc_id, n_words, log_score, mean_log``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shift = max(5, math.ceil(math.log2(max(1, total / BUCKET))))
    blocks = pack(docs, key, text)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                h, rows, _ = _words(row)
                if not len(h):
                    continue
                keys, counts = _distinct(_tables(h, rows, order))
                edges = _edges(keys, shift)
                low = (keys << np.uint64(shift)) >> np.uint64(24)
                small, high = low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8)
                for b in np.flatnonzero(np.diff(edges)):
                    part = slice(int(edges[b]), int(edges[b + 1]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([int(b)], pa.int32()),
                            "block": pa.array([row["block"]], pa.int64()),
                            "keys": pa.array([small[part].tobytes() + high[part].tobytes()], pa.binary()),
                            "counts": pa.array([_zip(counts[part].astype(np.uint32).tobytes())], pa.binary()),
                        }
                    )

    def n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(len(_words(batch.slice(k, 1).to_pylist()[0])[0]) for k in range(batch.num_rows))
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    totals = C.stage(blocks.mapInArrow(explode, _KEYS).groupBy("bucket").applyInArrow(_sum, _TOTALS), "lm-totals")
    C.release(spark)
    corpus = blocks.mapInArrow(n_words, "n long").agg(F.sum("n")).first()[0] or 0
    ln_backoff = math.log(backoff)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_in = left.to_pylist()
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "log_score": pa.float64(), "mean_log": pa.float64()}
        if not rows_in:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        row = rows_in[0]
        h, rows, n_docs = _words(row)
        n = np.bincount(rows, minlength=n_docs)
        sums = np.zeros(n_docs)
        if len(h):
            tables = _tables(h, rows, order)
            keys, counts = _distinct(tables)
            edges = _edges(keys, shift)
            total = counts.astype(np.int64)
            for r in right.to_pylist():
                a, b = int(edges[r["bucket"]]), int(edges[r["bucket"] + 1])
                seen = np.unpackbits(np.frombuffer(r["seen"], np.uint8), count=b - a).astype(bool)
                total[a:b][seen] = _unzip_counts(r["totals"])
            others = []
            for k, ok in tables:  # counts in all other documents, at each word
                rest = np.zeros(len(k), np.int64)
                pair = C.join2(k[ok], rows[ok].astype(np.uint64))
                by_pair, _, size = C.grouped(pair)
                own = np.empty(len(pair), np.int64)
                own[by_pair] = np.repeat(size, size)
                sorted_key, head, size = C.grouped(k[ok])
                known = np.empty(len(own), np.int64)
                known[sorted_key] = np.repeat(total[np.searchsorted(keys, k[ok][sorted_key[head]])], size)
                rest[ok] = known - own
                others.append(rest)
            ln = np.log((others[0] + 1.0) / (corpus - n[rows] + 1.0))
            for k in range(1, order):  # a longer context replaces the shorter one's value
                context = np.concatenate([[0], others[k - 1][:-1]])
                found = others[k] > 0
                ratio = np.log(np.where(found, others[k], 1) / np.where(found, context, 1))
                ln = np.where(found, ratio, np.where(tables[k][1], ln + ln_backoff, ln))
            sums = np.bincount(rows, weights=ln, minlength=n_docs)
        mean = [s / m if m else None for s, m in zip(sums.tolist(), n.tolist(), strict=True)]
        return pa.table({c: pa.array(v, kinds[c]) for c, v in {"doc_id": row["ids"], "n_words": n, "log_score": sums, "mean_log": mean}.items()})

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(finish, _OUT)


ORACLE = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws) AS n FROM t),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, w AS g1,
        CASE WHEN i >= 2 THEN lag(w) OVER o || ' ' || w END AS g2,
        CASE WHEN i >= 3 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w END AS g3,
        lag(w) OVER o AS u1, CASE WHEN i >= 3 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o END AS u2
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, g1 AS g, 1 AS n FROM g UNION ALL SELECT r, g2, 2 FROM g WHERE g2 IS NOT NULL UNION ALL SELECT r, g3, 3 FROM g WHERE g3 IS NOT NULL),
own AS (SELECT r, n, g, count(*) AS c FROM k GROUP BY ALL),
tot AS (SELECT n, g, sum(c) AS c FROM own GROUP BY ALL),
o AS (SELECT own.r, own.n, own.g, tot.c - own.c AS c FROM own JOIN tot USING (n, g)),
s AS (SELECT g.r, g.i, a.c AS c1, b.c AS c2, c.c AS c3, ua.c AS d1, ub.c AS d2
      FROM g JOIN o a ON a.r = g.r AND a.n = 1 AND a.g = g.g1
      LEFT JOIN o b ON b.r = g.r AND b.n = 2 AND b.g = g.g2
      LEFT JOIN o c ON c.r = g.r AND c.n = 3 AND c.g = g.g3
      LEFT JOIN o ua ON ua.r = g.r AND ua.n = 1 AND ua.g = g.u1
      LEFT JOIN o ub ON ub.r = g.r AND ub.n = 2 AND ub.g = g.u2),
z AS (SELECT s.r, sum(CASE WHEN coalesce(c3, 0) > 0 THEN ln(c3 / d2)
        WHEN coalesce(c2, 0) > 0 THEN ln(c2 / d1) + CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END
        ELSE ln((c1 + 1.0) / ((SELECT sum(n) FROM d) - d.n + 1.0)) + ln(0.4) * least(i - 1, 2) END) AS v
      FROM s JOIN d ON d.r = s.r GROUP BY s.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, round(coalesce(v, 0.0), 4) AS log_score, round(v / n, 6) AS mean_log
FROM d LEFT JOIN z ON z.r = d.r
"""
