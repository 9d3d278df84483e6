"""Token-ID output: length-delimited binary records with masked checksums and an offset index.

A shard ``part-NNNNN.rec`` holds records in ascending doc_id order, each framed

    u64 length | u32 masked crc of the length | data | u32 masked crc of the data

little-endian, where ``mask(c) = rotate_right(c, 15) + 0xA282EAD8`` and c is the
CRC-32 of zlib.  ``data`` is ``i64 doc_id | u8 null id | u8 bytes per token id |
ids``.  Beside it ``part-NNNNN.idx`` holds, for each record, ``u64 offset | u64
length`` of the frame, so that a reader can shuffle records and seek.  Shards are
written under a name of the attempt and renamed when whole, so a lost executor
leaves no half file; a reader verifies every checksum.

Each distinct white-space-free piece of text is encoded by the tokenizer once a
worker (its normaliser and pre-tokeniser never look across a space, which ``fit``
checks on the tokenizer's own description; otherwise whole texts are encoded).

Null text is empty: one record with the end id alone.  Null doc_ids come last.
Equal doc_ids keep one record each.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

END_ID = 2
#: Bytes of text for each shard.
SHARD = 64 << 20
#: Distinct pieces a task remembers; then it starts afresh.
REMEMBERED = 500_000
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The record at ``at`` and where the next begins; raises on a bad length or checksum."""
    size = data[at : at + 8]
    if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise ValueError(f"bad record length at byte {at}")
    n = struct.unpack("<Q", size)[0]
    body, end = data[at + 12 : at + 12 + n], at + 12 + n
    if len(body) < n or struct.unpack_from("<I", data, end)[0] != masked(body):
        raise ValueError(f"bad record at byte {at}")
    return body, end + 4


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder of any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_whole(uri: str, name: str, chunks: list[bytes]) -> None:
    """Write a file under a name of its own and move it into place when it is whole."""
    store, folder = filesystem(uri)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    store.move(own, f"{folder}/{name}")


#: Bytes of text whose words are looked up together.
TOGETHER = 2 << 20
#: Words in one text of the tokenizer's.
_LINE = 256
_END_MARKS = ".,;:!?"
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file: one load, and one memory of pieces, for all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Packed ids of texts by a tokenizer file, remembering the pieces between ASCII white space."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.seen: dict[bytes, bytes] = {}
        self.by_piece, self.lowers = self._local(json.loads(self.tokenizer.to_str()))
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(max([*ends, self.tokenizer.get_vocab_size()]) + 1, bool)
        self.ends[ends] = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    @staticmethod
    def _local(described: dict) -> tuple[bool, bool]:
        """Whether no step can see across a space (white space is dropped before the merges), and
        whether letters are lower-cased and parted from punctuation."""
        split = json.dumps(described.get("pre_tokenizer") or {})
        model, kinds = described["model"], _types(described.get("normalizer"))
        drops = '"invert": true' in split and '"behavior": "Removed"' in split and '"add_prefix_space": true' not in split
        known = all(n in ("NFC", "NFD", "Lowercase", "Replace", "Sequence") for n in kinds)
        marks = all(not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in described.get("added_tokens", []))
        local = bool(drops and known and marks and model["type"] == "BPE" and not described.get("truncation"))
        return local, "Lowercase" in kinds and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split

    def _encode(self, pieces: list[str]) -> None:
        """Learns pieces; words of letters go many to a text and are told apart by their end tokens."""
        if self.lowers:
            plain = [p for p in pieces if p.isalpha()]
            lines = [plain[k : k + _LINE] for k in range(0, len(plain), _LINE)]
            w = self.kind.itemsize
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                cut = ((np.flatnonzero(self.ends[ids]) + 1) * w).tolist()
                if len(cut) == len(line):
                    raw = ids.tobytes()
                    self.known.update(zip(line, [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], strict=True))
            pieces = [p for p in pieces if p not in self.known]
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, self.kind).tobytes()

    def _learn(self, fresh: set[str]) -> None:
        if not self.lowers:
            self._encode(list(fresh))
            return
        # A word with an end mark is the lower-cased word and the mark: two pieces to the tokenizer.
        parts: dict[str, tuple[str, str]] = {}
        for p in fresh:
            word = p.rstrip(_END_MARKS)
            if word.isalnum() and (p.isascii() or max(word) < "\u0130"):  # beyond, lower-casing may depend on the place
                parts[p] = (word.lower(), p[len(word) :])
        need = {x for two in parts.values() for x in two} | (fresh - parts.keys())
        self._encode(list(need.difference(self.known)))
        for p, (word, mark) in parts.items():
            self.known[p] = self.known[word] + self.known[mark]

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Packed ids of each text of a slice."""
        data = buf.tobytes()
        if not self.by_piece:
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.seen) > REMEMBERED:
            self.known, self.seen = {"": b""}, {}
        starts, ends, rows = C.word_spans(buf, offs)
        order, head, size = C.grouped(C.span_hash(C.prefix_hash(buf), starts, ends))
        one = order[head]
        words = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        fresh = {w: w.decode("utf-8", "replace") for w in words if w not in self.seen}
        self._learn(set(fresh.values()).difference(self.known))
        for w, t in fresh.items():
            self.seen[w] = self.known[t]
        packed = [self.seen[w] for w in words]
        flat = np.frombuffer(b"".join(packed), self.kind)
        lens = np.array([len(p) for p in packed], np.int64) // self.kind.itemsize
        first = np.cumsum(lens) - lens
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(one)), size)
        n = lens[which]
        ids = flat[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        cut = np.cumsum(np.bincount(rows, weights=n, minlength=len(offs) - 1)).astype(np.int64)
        raw = ids.tobytes()
        w = self.kind.itemsize
        return [raw[a * w : b * w] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]


def _types(node) -> list[str]:
    if isinstance(node, dict):
        return ([node["type"]] if "type" in node else []) + [t for v in node.values() for t in _types(v)]
    return [t for v in node for t in _types(v)] if isinstance(node, list) else []


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """Write all documents as shards in ascending ``key`` order; returns the shard list.

    Columns: ``shard`` (its number, in order), ``file``, ``n_docs``, ``n_tokens``, ``n_bytes``.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    order = F.col("id").asc_nulls_last()
    ordered = rows.repartitionByRange(max(1, math.ceil(total / shard_bytes)), order).sortWithinPartitions(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        width, last = encode.kind.itemsize, np.array([end_id], encode.kind).tobytes()
        frames: list[bytes] = []
        index: list[bytes] = []
        at = n_docs = n_tokens = 0
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("text"), TOGETHER):
                for i, ids in zip(batch.column("id")[a:b].to_pylist(), encode(buf, offs), strict=True):
                    n_tokens += len(ids) // width + 1
                    body = struct.pack("<qBB", i or 0, i is None, width) + ids + last
                    frames.append(frame(body))
                    index.append(struct.pack("<QQ", at, len(frames[-1])))
                    at += len(frames[-1])
                    n_docs += 1
            frames = [b"".join(frames)]  # one piece a batch
        if n_docs:
            name = f"part-{shard:06d}-{uuid.uuid4().hex[:12]}"  # an attempt of its own: only listed pairs are read
            write_whole(folder, f"{name}.idx", index)
            write_whole(folder, f"{name}.rec", frames)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [at]}
            )

    return C.stage(ordered.mapInArrow(C.light(run), "shard long, file string, n_docs long, n_tokens long, n_bytes long"), "shards")


def read(shards: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """The records of all shards with their place in the token stream.

    ``doc_id, start`` (ids of all documents before), ``n_tokens, ids_crc32`` (of
    the ids as little-endian u32) and with ``with_ids`` the ``ids``.
    """
    # A shard holds many megabytes, so the list is short; its sums come in two levels all the same.
    by_run = shards.withColumn("run", F.floor(F.col("shard") / 1024))
    inner = Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = by_run.groupBy("run").agg(F.sum("n_tokens").alias("t"))
    outer = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("run", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("run_start"))
    placed = by_run.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(starts, "run")
    work = placed.select("file", (F.col("run_start") + F.col("inner")).cast("long").alias("first"), "n_tokens")
    n = max(1, shards.count())
    spread = work.repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}.rec") as f:
                    data = f.read()
                with store.open_input_file(f"{path}/{row['file']}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                start = row["first"]
                for k in range(0, len(index), 2_000):
                    out: dict[str, list] = {c: [] for c in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                    for at in index[k : k + 2_000, 0]:
                        body, _ = unframe(data, int(at))
                        i, null, width = struct.unpack_from("<qBB", body)
                        ids = np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=10).astype("<u4")
                        out["doc_id"].append(None if null else i)
                        out["start"].append(start)
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids))
                        if with_ids:
                            out["ids"].append(ids)
                        start += len(ids)
                    if start > row["first"] + row["n_tokens"]:
                        raise ValueError(f"{row['file']} holds more ids than its shard list says")
                    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
                    kinds |= {"ids": pa.list_(pa.int64())} if with_ids else {}
                    yield pa.RecordBatch.from_pydict({c: pa.array(out[c], t) for c, t in kinds.items()})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spread.mapInArrow(C.light(run), schema)
