"""Exact substring deduplication: cover-sampled suffixes, sorted one bucket at a time.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id.  A full suffix array would sort every position
of the corpus; here a difference cover bounds what has to be sorted.

1. *Blocks.*  Documents in doc_id order are packed into blocks of about
   ``BLOCK`` bytes, so that an earlier block holds smaller ids.  All later work
   is per block, or per bucket of fingerprints; neither grows with the input.
2. *Cover sample.*  For any two positions some offset below ``V`` leads both to
   positions whose remainder modulo ``V`` is in the difference cover ``COVER``.
   So two equal strings of ``LENGTH`` bytes contain two aligned sample
   positions with equal strings of ``LENGTH - V + 1`` bytes.  Sample suffixes
   are sorted bucket by bucket; those that tie with another one are ranked as
   repeated.  A suffix without such a sample within reach is unique and is
   never sorted.
3. *Long ties.*  Content-defined pieces of text (a cut where a hash of the next
   16 bytes has six zero bits) are ranked the same way: a piece that an earlier
   block has settles all suffixes in it at once.
4. *Suffix buckets.*  The remaining suffixes are sorted by the fingerprint of
   their first ``LENGTH`` bytes, one bucket at a time; in a tie all but the
   earliest block's are repeats.  Ties inside a block are settled there.

Per block and bucket one row with packed keys travels, and one with bits comes
back.  Keys of suffixes and pieces are 64-bit fingerprints next to the bucket
number, sample keys 32 bits (a false tie only costs a comparison).

Null text is empty; a null doc_id counts as larger than any other; rows with
one doc_id count as one document and never remove each other's bytes; texts
under ``LENGTH`` bytes stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 50
#: A perfect difference set: every remainder modulo 21 is a difference of two of these.
V, COVER = 21, (0, 1, 4, 14, 16)
DEPTH = LENGTH - V + 1
BLOCK = 4 << 20
#: Bytes of text for each bucket of fingerprints.
BUCKET = 32 << 20
SAMPLE, PIECE, SUFFIX = 0, 1, 2
_CHUNK = 1 << 15

_PACKED = "block long, ids array<long>, lens array<long>, data binary"
_KEYS = "kind int, bucket int, block long, keys binary"
_BITS = "kind int, bucket int, block long, bits binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT_TEXT = _OUT + ", kept binary, spans array<array<long>>"


def pack(docs: DataFrame, key: str, text: str, total: int) -> DataFrame:
    """Blocks in doc_id order; equal ids are never parted."""
    n = max(1, math.ceil(total / (4 * BLOCK)))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last())
    codec = "zstd"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = pa.compress(b"".join(parts), codec=codec, asbytes=True)
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([first + made], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "lens": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                    "data": pa.array([data], pa.binary()),
                }
            )

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if size >= BLOCK and ids and i != ids[-1]:
                    yield flush()
                    ids, parts, size, made = [], [], 0, made + 1
                ids.append(i)
                parts.append(t.as_py() or b"")
                size += len(parts[-1])
        if ids:
            yield flush()

    return C.stage(ordered.mapInArrow(run, _PACKED), "blocks")


class Block:
    """A block's bytes, its hashes, and what the replies say about them."""

    def __init__(self, row: dict, shift: int) -> None:
        self.block, self.ids, self.shift = row["block"], row["ids"], shift
        lens = np.array(row["lens"], np.int64)
        self.offs = np.concatenate([[0], np.cumsum(lens)])
        self.n = int(self.offs[-1])
        data = pa.decompress(row["data"], decompressed_size=self.n, codec="zstd", asbytes=True) if self.n else b""
        self.data = data
        padded = np.frombuffer(data + bytes(72), np.uint8)
        w = np.ndarray((self.n + 64,), np.uint64, padded, 0, (1,))
        self.h16 = np.empty(self.n + 56, np.uint64)
        for k in range(0, len(self.h16), _CHUNK):  # stays in a core's cache
            part = w[k : k + _CHUNK + 8].copy()
            m = min(_CHUNK, len(self.h16) - k)
            self.h16[k : k + m] = C.pair(part[:m], part[8 : 8 + m])
        self.rows = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        change = [a != b for a, b in zip(self.ids[1:], self.ids[:-1], strict=True)]
        self.doc = np.concatenate([[0], np.cumsum(change)]).astype(np.int32) if len(lens) else np.zeros(0, np.int32)
        # where windows start, and where sample suffixes do
        self.window_end = np.maximum(self.offs[1:] - LENGTH + 1, self.offs[:-1])
        self.valid = self.covered(self.offs[:-1], self.window_end)
        most = int(lens.max()) if len(lens) else 0
        cover = np.flatnonzero(np.isin(np.arange(max(0, most - DEPTH + 1)) % V, COVER))
        counts = np.searchsorted(cover, np.maximum(lens - DEPTH + 1, 0))
        total = int(counts.sum())
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        self.samples = np.repeat(self.offs[:-1], counts) + cover[within] if total else np.zeros(0, np.int64)
        # pieces: runs of window starts from a cut, with the bytes that their windows cover
        cut = (self.h16[: self.n] & np.uint64(63)) == 0
        cut[self.offs[:-1][lens > 0]] = True
        starts = np.flatnonzero(cut & self.valid)
        ends = np.minimum(np.append(starts[1:], self.n), self.window_end[self.rows[starts]]) if len(starts) else starts
        self.piece_starts, self.piece_ends = starts, ends
        self.pieces = np.zeros(0, np.uint64)
        if len(starts):
            prefix = C.prefix_hash(padded[: self.n])
            self.pieces = C.join2(C.span_hash(prefix, starts, ends + LENGTH - 1), self.window(starts))

    def covered(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which positions lie in one of the ranges, none of which holds another one with other ends."""
        some = ends > starts
        starts, ends = np.sort(starts[some]), np.sort(ends[some])
        if not len(starts):
            return np.zeros(self.n, bool)
        apart = np.flatnonzero(starts[1:] > ends[:-1])
        edges = np.empty(2 * len(apart) + 2, np.int64)
        edges[0::2], edges[1::2] = starts[np.concatenate([[0], apart + 1])], ends[np.append(apart, len(ends) - 1)]
        flags = np.zeros(len(edges) + 1, bool)
        flags[1::2] = True
        return np.repeat(flags, np.diff(np.concatenate([[0], edges, [max(self.n, edges[-1])]])))[: self.n]

    def depth(self, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the ``DEPTH`` bytes from each position."""
        return C.pair(self.h16[at], self.h16[at + (DEPTH - 16)])

    def window(self, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the ``LENGTH`` bytes from each position."""
        out = np.empty(len(at), np.uint64)
        for k in range(0, len(at), _CHUNK):
            i = at[k : k + _CHUNK]
            first = C.pair(self.h16[i], self.h16[i + 16])
            out[k : k + _CHUNK] = C.pair(first, C.pair(self.h16[i + (LENGTH - 32)], self.h16[i + (LENGTH - 16)]))
        return out

    def keys(self, kind: int, keys: np.ndarray) -> Iterator[dict]:
        """The sorted distinct keys, a row for each bucket (their leading bits)."""
        edges = np.searchsorted(keys >> np.uint64(64 - self.shift), np.arange((1 << self.shift) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            part = keys[edges[b] : edges[b + 1]]
            if kind == SAMPLE:
                part = ((part << np.uint64(self.shift)) >> np.uint64(32)).astype(np.uint32)
            yield {"kind": kind, "bucket": int(b), "block": self.block, "keys": part.tobytes()}

    def first(self) -> Iterator[dict]:
        yield from self.keys(SAMPLE, C.distinct(self.depth(self.samples)))
        yield from self.keys(PIECE, C.distinct(self.pieces))

    def told(self, kind: int, keys: np.ndarray, replies: dict) -> np.ndarray:
        """The reply bit of each of the block's sorted distinct keys."""
        edges = np.searchsorted(keys >> np.uint64(64 - self.shift), np.arange((1 << self.shift) + 1, dtype=np.uint64))
        flags = np.zeros(len(keys), bool)
        for b in np.flatnonzero(np.diff(edges)):
            bits = replies.get((kind, int(b)))
            if bits is not None:
                k = int(edges[b + 1] - edges[b])
                flags[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=k).astype(bool)
        return flags

    def narrowed(self, replies: dict) -> tuple[np.ndarray, np.ndarray]:
        """Settled windows (in pieces that an earlier block has), and the others that may repeat."""
        keys = self.depth(self.samples)
        order, head, size = C.grouped(keys)
        repeats = self.samples[order[np.repeat((size > 1) | self.told(SAMPLE, keys[order[head]], replies), size)]]
        alive = self.covered(np.maximum(repeats - V + 1, 0), repeats + 1) & self.valid
        order, head, size = C.grouped(self.pieces)
        hit = order[np.repeat(self.told(PIECE, self.pieces[order[head]], replies), size)]
        settled = self.covered(self.piece_starts[hit], self.piece_ends[hit])
        return settled, np.flatnonzero(alive & ~settled)

    def second(self, replies: dict) -> Iterator[dict]:
        _, open_ = self.narrowed(replies)
        yield from self.keys(SUFFIX, C.distinct(self.window(open_)))

    def removed(self, replies: dict) -> np.ndarray:
        """Which bytes go."""
        settled, open_ = self.narrowed(replies)
        keys = self.window(open_)
        order, head, size = C.grouped(keys)
        again = open_[order[np.repeat(self.told(SUFFIX, keys[order[head]], replies), size)]]
        # Ties inside the block, with any window of a smaller document, settled or not.
        every = np.concatenate([np.flatnonzero(settled), open_])
        order, head, size = C.grouped(self.window(every))
        doc = self.doc[self.rows[every[order]]]
        least = np.minimum.reduceat(doc, head) if len(head) else doc
        later = every[order[doc > np.repeat(least, size)]]
        starts = np.concatenate([np.flatnonzero(settled), again, later])
        return self.covered(starts, starts + LENGTH)

    def result(self, replies: dict, with_text: bool) -> dict:
        gone = self.removed(replies)
        edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1 if self.n > 1 else np.zeros(0, np.int64)
        edge = C.distinct(np.concatenate([edge, self.offs]))
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for k, i in enumerate(self.ids):
            a, b = int(self.offs[k]), int(self.offs[k + 1])
            own = edge[np.searchsorted(edge, a) : np.searchsorted(edge, b, side="right")]
            runs = [(int(x), int(y), bool(gone[x])) for x, y in zip(own[:-1], own[1:], strict=True)] if b > a else []
            kept = b"".join(self.data[x:y] for x, y, g in runs if not g)
            spans = [[x - a, y - a] for x, y, g in runs if g]
            out["doc_id"].append(i)
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(kept))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
                out["spans"].append(spans)
        return out


def _ties(table: pa.Table) -> pa.Table:
    """One bucket: sort its keys and tell each block which of its own tie with others' or earlier ones."""
    kind = table.column("kind")[0].as_py()
    blocks = np.array(table.column("block").to_pylist(), np.int64)
    order = np.argsort(blocks)
    parts = [np.frombuffer(table.column("keys")[int(k)].as_py(), np.uint32 if kind == SAMPLE else np.uint64) for k in order]
    keys = np.concatenate(parts)
    if kind == SAMPLE:
        flags = C.repeated(keys)
    else:
        at = np.argsort(keys, kind="stable")
        flags = np.zeros(len(keys), bool)
        flags[at[1:]] = keys[at[1:]] == keys[at[:-1]]
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(flags[e - len(p) : e]).tobytes() if flags[e - len(p) : e].any() else None for p, e in zip(parts, ends, strict=True)]
    some = [k for k, b in enumerate(bits) if b is not None]
    del keys, flags, parts
    C.trim()
    return pa.table(
        {
            "kind": pa.array([kind] * len(some), pa.int32()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * len(some), pa.int32()),
            "block": pa.array([int(blocks[order[k]]) for k in some], pa.int64()),
            "bits": pa.array([bits[k] for k in some], pa.binary()),
        }
    )


def _rows(found: Iterator[dict]) -> pa.Table:
    found = list(found)
    names = {"kind": pa.int32(), "bucket": pa.int32(), "block": pa.int64(), "keys": pa.binary()}
    return pa.table({k: pa.array([r[k] for r in found], t) for k, t in names.items()})


def _with_replies(blocks: DataFrame, replies: DataFrame, shift: int, use: Callable[[Block, dict], pa.Table], schema: str) -> DataFrame:
    empty = pa.table({f.name: pa.array([], f.type) for f in _arrow(schema)})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        told = {(r["kind"], r["bucket"]): r["bits"] for r in right.to_pylist()}
        out = use(Block(left.to_pylist()[0], shift), told)
        C.trim()
        return out

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document with its sizes, removed runs and the SHA-256 of what is kept.

    ``with_text`` adds the kept bytes and the removed spans (byte offsets).
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shift = max(5, math.ceil(math.log2(max(1, total / BUCKET))))
    blocks = pack(docs, key, text, total)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _rows(Block(batch.slice(k, 1).to_pylist()[0], shift).first()).to_batches()

    def settle(keys: DataFrame) -> DataFrame:
        out = C.stage(keys.groupBy("kind", "bucket").applyInArrow(_ties, _BITS), "ties")
        del keys
        C.release(spark)
        return out

    C.release(spark)
    first = settle(blocks.mapInArrow(C.light(ask), _KEYS))
    second = settle(_with_replies(blocks, first, shift, lambda b, told: _rows(b.second(told)), _KEYS))
    schema = _OUT_TEXT if with_text else _OUT
    types = _arrow(schema)

    def finish(block: Block, told: dict) -> pa.Table:
        out = block.result(told, with_text)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in types})

    return _with_replies(blocks, first.unionByName(second), shift, finish, schema)
