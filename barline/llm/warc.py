"""WARC archives: writing pages as (segmented, chunked) records and reassembling them.

``write`` puts each row's payload into an HTTP response with chunked transfer
framing.  A block of more than ``SEGMENT`` bytes is cut into segments: the first
record has ``WARC-Segment-Number: 1``, the others are ``continuation`` records
that name the first by ``WARC-Segment-Origin-ID`` and may lie in other files; the
last has ``WARC-Segment-Total-Length``.  Each record is a gzip member.  Of rows
with equal payloads of at least ``min_bytes`` the one with the largest id is a
response and the others are revisits of it, without payload.

``write`` names its files by attempt and returns the list of those of the attempts
that count; ``read`` opens the files of such a list, so that what a lost or doubled
task left behind is not read.  Without a list it reads a folder of any store.

``read`` groups continuations by their origin, orders them by number, verifies that
no number is missing and that the lengths add up to the total, decodes the chunked
framing and verifies digests.  Only segmented records are shuffled; revisits take
sizes and digests from their response's row, not its payload.

Nulls and edge cases: null html is an empty payload; null and repeated ids are
written as they are (rows that tie for the largest id are all responses, each
reassembled by itself: a header counts the rows that share a record's name); a
record that fails a check keeps its row with ``status`` telling why, and one whose
headers cannot be read has a row of NULLs with a status; after a damaged member
reading goes on at the next one; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import filesystem, write_whole

SEGMENT, CHUNK, FILE = 32 << 10, 8 << 10, 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PARSED = (
    "record_id string, type string, origin_id string, segment int, total_length long, page_id long, url string, "
    "digest string, refers_to_record string, payload_bytes long, block binary, status string, copy string"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + CHUNK] for k in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ``ValueError`` if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def records(page_id: int | None, url: str | None, payload: bytes, name: str, refers: str | None, refers_page: int | None, copy: str = "") -> list[bytes]:
    """The records of one row, segments apart."""
    base = {
        "WARC-Target-URI": (url or "about:blank").replace("\r", "").replace("\n", ""),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Copy": copy,
    }
    if refers is not None:
        own = {"WARC-Type": "revisit", "WARC-Record-ID": name, "WARC-Refers-To": refers, "WARC-Profile": PROFILE}
        return [record(own | base | {"X-Refers-To-Page": str(refers_page)}, HTTP)]
    block = HTTP + chunked(payload)
    cuts = [block[k : k + SEGMENT] for k in range(0, len(block), SEGMENT)]
    out = []
    for k, part in enumerate(cuts):
        if k == 0:
            own = {"WARC-Type": "response", "WARC-Record-ID": name} | base
        else:
            own = {"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{k}>", "WARC-Segment-Origin-ID": name, "X-Copy": copy}
        if len(cuts) > 1:
            own |= {"WARC-Segment-Number": str(k + 1)}
            if k == len(cuts) - 1:
                own |= {"WARC-Segment-Total-Length": str(len(block))}
        out.append(record(own, part))
    return out


def name_of(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive all rows; returns the file list (``file, n_records, n_bytes``)."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    keys = rows.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    keys = C.stage(keys.distinct(), "warc-keys")
    groups = keys.filter(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("id").alias("keeper"))
    # Ids and digests alone are joined by digest, so a payload that many rows share stays small.
    twins = keys.join(groups, "sha").filter("id < keeper or (id is null and keeper is not null)").select("id", "sha", "keeper")
    twins = twins.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "keeper")
    marked = rows.withColumn("sha", F.sha1("payload")).join(
        twins.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, row = TaskContext.get().partitionId(), 0, 0
        attempt = uuid.uuid4().hex[:12]
        members: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            file = f"pages-{part:06d}-{made:04d}-{attempt}.warc.gz"
            write_whole(folder, file, members)
            return pa.RecordBatch.from_pydict({"file": [file], "n_records": [len(members)], "n_bytes": [size]})

        for batch in batches:
            ids, urls = batch.column("id").to_pylist(), batch.column("url").to_pylist()
            shas, keepers = batch.column("sha").to_pylist(), batch.column("keeper").to_pylist()
            revisits = batch.column("revisit").to_pylist()
            for k, p in enumerate(batch.column("payload")):
                sha = base64.b32encode(bytes.fromhex(shas[k])).decode()
                refers = name_of(keepers[k], sha) if revisits[k] else None
                row += 1
                for member in records(ids[k], urls[k], p.as_py(), name_of(ids[k], sha), refers, keepers[k], f"{part}-{row}"):
                    members.append(member)
                    size += len(member)
                    if size >= FILE:
                        yield flush()
                        members, size, made = [], 0, made + 1
        if members:
            yield flush()

    sent = marked.select("id", "url", "payload", "sha", "keeper", F.col("__sha").isNotNull().alias("revisit"))
    return C.stage(sent.mapInArrow(C.light(run), "file string, n_records long, n_bytes long"), "warc-files")


_MAGIC, _PIECE = b"\x1f\x8b\x08", 16 << 10


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The gzip members of a file, unpacked one by one, and what is wrong with each.

    After a damaged member the search goes on at the next one's first bytes.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        d, here, out, problem = zlib.decompressobj(31), at, [], None
        try:
            while not d.eof and here < len(data):  # in pieces, so that what follows the member is not copied whole
                piece = view[here : here + _PIECE]
                here += len(piece)
                out.append(d.decompress(piece))
            problem = None if d.eof else "file ends inside the record"
        except zlib.error:
            problem = "damaged record"
        if problem is None:
            at = here - len(d.unused_data)
        else:
            following = data.find(_MAGIC, at + 3)
            at = following if following > 0 else len(data)
        yield b"".join(out), problem


def parse(data: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers (lower-case names) and block of a record, and what is wrong with it."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return {}, b"", "not a WARC record"
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit():
        return headers, rest, "no length"
    block = rest[: int(length)]
    return headers, block, None if len(block) == int(length) else "block shorter than its length"


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _finish(block: bytes | None, want: str | None) -> tuple[str, bytes | None, str]:
    """Digest, payload and status of a whole HTTP block."""
    try:
        payload = payload_of(block or b"")
    except ValueError as e:
        return "", None, f"bad framing: {e}"
    found = digest(payload)
    return found, payload, "ok" if want in (None, found) else "digest differs"


def _row(headers: dict[str, str], block: bytes, problem: str | None = None) -> dict:
    h = headers.get
    want = (h("warc-payload-digest") or "").removeprefix("sha1:") or None
    out = {
        "record_id": h("warc-record-id"),
        "type": h("warc-type"),
        "origin_id": h("warc-segment-origin-id"),
        "segment": _whole_number(h("warc-segment-number")) or 0,
        "total_length": _whole_number(h("warc-segment-total-length")),
        "page_id": _whole_number(h("x-page-id")),
        "url": h("warc-target-uri"),
        "digest": want,
        "refers_to_record": h("warc-refers-to"),
        "payload_bytes": None,
        "block": None,
        "status": problem or "ok",
        "copy": h("x-copy") or "",
    }
    if out["segment"]:
        out["block"] = block
        out["origin_id"] = out["origin_id"] or out["record_id"]
    elif out["type"] == "response" and problem is None:
        out["digest"], out["block"], out["status"] = _finish(block, want)
        out["payload_bytes"] = len(out["block"]) if out["block"] is not None else None
    return out


def read(spark: SparkSession, folder: str, with_payload: bool = False, files: DataFrame | None = None) -> DataFrame:
    """All response and revisit records with whole payloads.

    ``record_id, page_id, url, record_type, payload_bytes, payload_digest,
    refers_to`` (the response's page_id), ``status`` and, if asked for, ``payload``.
    ``files``: the list that ``write`` returned.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        extra = ", payload binary" if with_payload else ""
        return spark.createDataFrame([], "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, status string" + extra)
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.int32() if t == "int" else pa.binary() if t == "binary" else pa.string()) for n, t in (x.split() for x in _PARSED.split(", "))])

    def opened(batch: pa.RecordBatch) -> Iterator[bytes]:
        if "content" in batch.schema.names:
            yield from (c.as_py() for c in batch.column("content"))
            return
        store, path = filesystem(folder)
        for name in batch.column("file").to_pylist():
            with store.open_input_file(f"{path}/{name}") as f:
                yield f.read()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in opened(batch):
                for member, problem in members(content):
                    headers, block, wrong = parse(member)
                    row = _row(headers, block, problem or wrong)
                    if row["segment"] == 0 and not with_payload:
                        row["block"] = None
                    rows.append(row)
                    size += len(row["block"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    if files is None:
        sent = spark.read.format("binaryFile").load(folder).select("content")
    else:
        sent = files.select("file").repartition(max(1, files.count()))
    parsed = C.stage(sent.mapInArrow(C.light(take), _PARSED), "warc-records")
    whole = parsed.filter("segment = 0").select("record_id", "type", "page_id", "url", "digest", "refers_to_record", "payload_bytes", "block", "status")
    parts = parsed.filter("segment > 0").select("origin_id", "copy", "segment", "record_id", "total_length", "page_id", "url", "digest", "block", "status")
    # A group is one record's segments: no larger than the record.
    joined = (
        parts.dropDuplicates(["origin_id", "copy", "segment"])
        .groupBy("origin_id", "copy")
        .agg(
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"),
            F.max("segment").alias("last"),
            F.max("total_length").alias("total_length"),
            F.max(F.when(F.col("segment") == 1, F.struct("page_id", "url", "digest"))).alias("head"),
            F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("damage"),
        )
    )

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("record_id", "type", "page_id", "url", "digest", "refers_to_record", "payload_bytes", "block", "status")}
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                head, block = r["head"] or {}, b"".join(s["block"] for s in r["s"])
                found, payload, status = None, None, "segment missing"
                if r["head"] is not None and len(r["s"]) == r["last"]:
                    status = f"length {len(block)}, not {r['total_length']}"
                    if len(block) == r["total_length"]:
                        found, payload, status = _finish(block, head["digest"])
                status = r["damage"] or status
                values = (r["origin_id"], "response", head.get("page_id"), head.get("url"), found, None, None if payload is None else len(payload), payload if with_payload else None, status)
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    reassembled = joined.mapInArrow(
        C.light(put_together),
        "record_id string, type string, page_id long, url string, digest string, refers_to_record string, payload_bytes long, block binary, status string",
    )
    every = whole.unionByName(C.stage(reassembled, "warc-joined"))
    responses = every.filter("type = 'response'")
    first = responses.groupBy("record_id").agg(F.max(F.struct("page_id", "payload_bytes", "digest")).alias("of"))
    revisits = every.filter("type = 'revisit'").join(first.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left")
    status = F.when(F.col("of").isNull(), "response missing").when(F.col("of.digest") != F.col("digest"), "digest differs").otherwise(F.col("status"))
    last = [F.col("block").alias("payload")] if with_payload else []
    a = responses.select("record_id", "page_id", "url", F.lit("response").alias("record_type"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), "status", *last)
    b = revisits.select("record_id", "page_id", "url", F.lit("revisit").alias("record_type"), F.col("of.payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("of.page_id").alias("refers_to"), status.alias("status"), *last)
    lost = every.filter("type is null or type not in ('response', 'revisit')")
    lost = lost.filter("status <> 'ok'").select(
        "record_id", "page_id", "url", F.lit(None).cast("string").alias("record_type"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), "status", *last
    )
    return a.unionByName(b).unionByName(lost)
