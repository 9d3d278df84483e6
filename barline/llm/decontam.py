"""Benchmark decontamination by latent semantic retrieval, then exact checks.

1. One pass over all texts counts document frequencies of hashed terms (over
   segments of ``STRIDE`` words) and stores the terms of each text.
2. A distributed randomised SVD of the TF-IDF rows of all passages (``2 * STRIDE``
   words, half overlapping) of all texts and of all benchmark items (weighted up,
   so that their span is kept) gives one latent basis: tasks sum ``A'(A G)``, a
   matrix of fixed size, over the stored terms of all texts.
3. A last pass projects every passage and takes as candidates the items with a
   cosine of at least ``COSINE``.
4. For a candidate, the longest common subsequence of the item's words with the
   passage and its surroundings, and the share of the item's answer words (its
   rarest third) that occur there, decide.

Statistics, basis, search and checks cover all rows.  Benchmark items are searched for in blocks of ``ITEMS``, so that
what is sent to the tasks has a fixed bound.  Words are compared in Unicode's case folding
and without ASCII punctuation.

Null and empty texts and items without words match nothing; null ids are
reported as null; repeated rows are each reported, repeated items once; other
columns are ignored, whatever their names; an empty table gives an empty result.  One row is returned for each document and item that match, at the best
place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TERMS, STRIDE = 1 << 15, 32
#: All passages together weigh as much in the basis as so many (fewer count as they are); an item's weight.
PASSAGES, ITEM_WEIGHT = 4096, 8.0
#: Items that are searched for in one pass: vectors and words of so many are about 32 MB.
ITEMS = 16_384
RANK, EXTRA, SEED = 192, 8, 11
COSINE, LCS, ANSWER = 0.35, 0.7, 0.6
_ADDERS, _SLICES, _TOGETHER, _CELLS = 8, 32, 64, 1 << 20
#: Segments in one dense product of the fit, and segments (about 26 MB of text) to a task that makes a partial sum.
_SPREAD, _FITTED = 64, 1 << 17

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWERED = bytes(range(256)).lower()  # A-Z only
_IS_DROPPED = bytes(k in _PUNCTUATION for k in range(256))


def folded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with other letters than ASCII in Unicode's case folding; ``_LOWERED`` does the rest.

    Folding keeps the number of bytes in U+0080 to U+00FF (but for the micro sign)
    and changes nothing in U+2000 to U+203F; rows with other letters are folded as text.
    """
    high = np.flatnonzero(buf & 128)
    if not len(high):
        return buf, offs
    lead = high[buf[high] >= 0xC0]
    after = buf[np.minimum(lead + 1, len(buf) - 1)]
    first = buf[lead]
    plain = (first == 0xC3) | ((first == 0xC2) & (after != 0xB5)) | ((first == 0xE2) & (after == 0x80))
    buf = buf.copy()
    latin = lead[first == 0xC3] + 1
    upper = latin[(buf[latin] <= 0x9E) & (buf[latin] != 0x97)]
    sharp = latin[buf[latin] == 0x9F]
    buf[upper] += 0x20
    buf[sharp] = buf[sharp - 1] = ord("s")
    rows = np.unique(np.searchsorted(offs, lead[~plain], side="right") - 1)
    if not len(rows):
        return buf, offs
    data, out, size = buf.tobytes(), [], np.diff(offs)
    at = 0
    for r in rows.tolist():
        row = data[offs[r] : offs[r + 1]].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
        out += [data[at : offs[r]], row]
        at, size[r] = offs[r + 1], len(row)
    out.append(data[at:])
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum(size)])


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each normalised word."""
    buf, offs = folded(buf, offs)
    data = buf.tobytes()
    gone = np.flatnonzero(np.frombuffer(data.translate(_IS_DROPPED), bool))
    plain, offs = np.frombuffer(data.translate(_LOWERED, _PUNCTUATION), np.uint8), offs - np.searchsorted(gone, offs)
    starts, ends, rows = C.word_spans(plain, offs)
    return C.span_hash(C.prefix_hash(plain), starts, ends), rows


def segments(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each word, and the row and first word of each segment; segments have ``STRIDE`` words."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    parts = -(-count // STRIDE)
    seg_first = np.cumsum(parts) - parts
    within = np.arange(len(rows)) - first[rows]
    seg = seg_first[rows] + within // STRIDE
    seg_row = np.repeat(np.arange(n_rows), parts)
    seg_at = first[seg_row] + (np.arange(len(seg_row)) - seg_first[seg_row]) * STRIDE
    return seg, seg_row, seg_at


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(49)).astype(np.int32)  # 15 bits: TERMS


def survey(docs: DataFrame, text: str) -> tuple[np.ndarray, int, DataFrame]:
    """Document frequencies of the terms and the number of segments, over all texts, and the terms of each text (``terms``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS + _ADDERS, np.int64)  # the segments are counted in place TERMS
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("text")):
                h, rows = words(buf, offs)
                if not len(h):
                    continue
                seg, seg_row, _ = segments(rows, b - a)
                terms = _terms(h)
                pairs = np.sort(seg * TERMS + terms)
                pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
                df[:TERMS] += np.bincount(pairs % TERMS, minlength=TERMS)
                df[TERMS] += len(seg_row)
                cuts = (2 * np.searchsorted(rows, np.arange(b - a + 1))).astype(np.int32)
                v = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(terms.astype(np.uint16))])
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(b - a, -1, np.int32)), "v": v})
        parts = [p.tobytes() for p in df.reshape(_ADDERS, -1)]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(_ADDERS), pa.int32()), "v": parts})

    found = C.stage(docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(C.light(run), "k int, v binary"), "survey")
    sums = C.vector_sums(found.filter("k >= 0"), np.int64)
    total = np.concatenate([sums[k] for k in range(_ADDERS)]) if sums else np.zeros(TERMS + _ADDERS, np.int64)
    return total[:TERMS], int(total[TERMS]), found.filter("k < 0").select(F.col("v").alias("terms"))


class Passages:
    """The passages of a slice: the segments of its words, and which segments make a passage with the next."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, n_rows: int) -> None:
        self.terms = terms
        self.seg, self.seg_row, self.seg_at = segments(rows, n_rows)
        self.joined = np.append(self.seg_row[1:] == self.seg_row[:-1], False)

    def projected(self, scaled: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``scaled`` (the last one zeros) over each passage's words."""
        n = len(self.seg_at)
        slots = np.full((n, STRIDE), TERMS, np.int32)  # the row of zeros where a segment is short
        slots[self.seg, np.arange(len(self.seg)) - self.seg_at[self.seg]] = self.terms
        sums = np.empty((n, scaled.shape[1]), np.float32)
        gathered = np.empty((_TOGETHER * STRIDE, scaled.shape[1]), np.float32)
        for k in range(0, n, _TOGETHER):  # so many segments' rows stay in a core's cache
            part = slots[k : k + _TOGETHER]
            taken = gathered[: part.size]
            np.take(scaled, part.ravel(), axis=0, out=taken, mode="clip")
            taken.reshape(len(part), STRIDE, -1).sum(axis=1, out=sums[k : k + len(part)])
        passage = sums.copy()
        passage[self.joined] += sums[1:][self.joined[:-1]]
        return passage

    def squares(self, idf: np.ndarray) -> np.ndarray:
        """Squared length of each passage's TF-IDF row."""
        second = np.append(False, self.joined[:-1])[self.seg]  # words that the passage before holds too
        pairs = np.concatenate([self.seg * TERMS + self.terms, (self.seg[second] - 1) * TERMS + self.terms[second]])
        pairs.sort()
        head = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        times = np.diff(np.append(head, len(pairs)))
        pairs = pairs[head]
        return np.bincount(pairs // TERMS, weights=(times * idf[pairs % TERMS]) ** 2.0, minlength=len(self.seg_at))

    def spread(self, y: np.ndarray, total: np.ndarray) -> None:
        """Add each passage's row of ``y`` to the rows of ``total`` of its words."""
        z = y.copy()
        z[1:][self.joined[:-1]] += y[:-1][self.joined[:-1]]
        for k in range(0, len(z), _SPREAD):  # few segments have few terms: a small dense product
            part = z[k : k + _SPREAD]
            a = self.seg_at[k]
            b = self.seg_at[k + _SPREAD] if k + _SPREAD < len(z) else len(self.seg)
            own, at = np.unique(self.terms[a:b], return_inverse=True)
            times = np.zeros(len(part) * len(own), np.float32)
            np.add.at(times, (self.seg[a:b] - k) * len(own) + at, np.float32(1))
            total[own] += times.reshape(len(part), -1).T @ part


def _matrix(column: pa.Array, weight: float, idf: np.ndarray) -> np.ndarray:
    """Dense TF-IDF rows of length ``weight``."""
    out = np.zeros((len(column), TERMS), np.float32)
    for k, t in enumerate(column):
        terms = np.frombuffer(t.as_py(), np.uint16)
        np.add.at(out[k], terms, idf[terms])
        norm = np.linalg.norm(out[k])
        if norm:
            out[k] *= weight / norm
    return out


def basis(texts: DataFrame, own: DataFrame, n_own: int, idf: np.ndarray, n: int, rank: int) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows of all ``n`` passages and of the ``n_own`` items by a randomised SVD.

    ``texts`` and ``own`` have the ``terms`` of a text or item.  With ``Y = A'(A G)``, ``Y (G'Y)^-1 Y'`` is close to
    ``A'A`` (the Nystroem form of the randomised SVD), so one pass gives the vectors.
    """
    width = rank + EXTRA
    idf = idf.astype(np.float32)
    share = min(1.0, PASSAGES / max(n, 1))  # the square of a passage's weight
    # A partial sum is a matrix, so a task makes one of many passages.
    tasks = min(-(-max(n, 1) // _FITTED), max(64, 4 * texts.sparkSession.sparkContext.defaultParallelism))

    def start() -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((TERMS, width), np.float32)

    def cut(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            parts = (total * idf[:, None]).reshape(_SLICES, -1)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(_SLICES), pa.int32()), "v": [p.tobytes() for p in parts]})

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scaled = None, None
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("terms"), 1 << 18):
                if not len(buf):
                    continue
                if total is None:
                    total, scaled = np.zeros((TERMS, width), np.float32), np.zeros((TERMS + 1, width), np.float32)
                    np.multiply(start(), idf[:, None], out=scaled[:TERMS])
                found = Passages(buf.view(np.uint16).astype(np.int32), np.repeat(np.arange(b - a), np.diff(offs) // 2), b - a)
                y = found.projected(scaled)
                y *= (share / found.squares(idf)).astype(np.float32)[:, None]
                found.spread(y, total)
        yield from cut(total)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                rows = _matrix(batch.slice(a, 128).column("terms"), ITEM_WEIGHT, idf)
                got = rows.T @ (rows @ start()) / idf[:, None]
                total = got if total is None else total + got
        yield from cut(total)

    # Summed slice by slice on the executors: the driver gets one matrix, however many tasks there are.
    kinds, items = "k int, v binary", own.repartition(max(1, -(-n_own // ITEMS)))
    found = C.vector_sums(texts.coalesce(tasks).mapInArrow(C.light(of_texts), kinds).unionByName(items.mapInArrow(C.light(of_items), kinds)), np.float32)
    if not found:
        return np.zeros((TERMS, 1), np.float32)
    y = np.concatenate([found.pop(k) for k in range(_SLICES)]).reshape(TERMS, width)
    inner = start().T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    kept = values > values[-1] * 1e-6  # fewer texts than columns
    half = y @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)  # half half' is close to A'A
    del y
    values, vectors = np.linalg.eigh((half.T @ half).astype(np.float64))
    top = [k for k in np.argsort(-values)[:rank] if values[k] > values[-1] * 1e-6]
    return np.linalg.qr(half @ (vectors[:, top] / np.sqrt(values[top])).astype(np.float32))[0]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (one big integer, a bit for each element of ``a``)."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Items:
    """A block of benchmark items: word hashes, latent vectors, answer words."""

    def __init__(self, ids: list[int], texts: list[bytes], idf: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.words, self.answers = [], [], []
        vectors = []
        for i, t in zip(ids, texts, strict=True):
            buf = np.frombuffer(t, np.uint8)
            h, _ = words(buf, np.array([0, len(buf)])) if len(buf) else (np.zeros(0, np.uint64), None)
            if not len(h):
                continue
            weight = idf[_terms(h)]
            vector = weight @ v[_terms(h)]
            self.ids.append(i)
            self.words.append([int(x) for x in h])
            rare = np.argsort(-weight, kind="stable")[: max(1, len(h) // 3)]
            self.answers.append({int(h[k]) for k in rare})
            vectors.append(vector / max(np.linalg.norm(vector), 1e-9))
        self.vectors = np.array(vectors, np.float32).reshape(len(self.ids), v.shape[1])
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.asked = np.array([len(x) for x in self.answers], np.int64)
        # Which items have a word among their answer words: ``holders[first[k] : first[k + 1]]`` for ``known[k]``.
        words_of = np.array([x for held in self.answers for x in held], np.uint64)
        order = np.argsort(words_of, kind="stable")
        self.holders = np.repeat(np.arange(len(self.ids)), self.asked)[order]
        self.known, first = np.unique(words_of[order], return_index=True)
        self.first = np.append(first, len(words_of))

    def answerable(self, h: np.ndarray, items: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which of the candidates can have enough answer words: whether ``h[lo:hi]`` holds so many, repeats counted."""
        start, end = int(lo.min()), int(hi.max())
        at = np.minimum(np.searchsorted(self.known, h[start:end]), len(self.known) - 1)
        where = np.flatnonzero(self.known[at] == h[start:end])
        at = at[where]
        times = self.first[at + 1] - self.first[at]
        n = int(times.sum())
        if n > _CELLS:  # words of very many items: the exact check alone decides
            return np.ones(len(items), bool)
        nth = np.arange(n) - np.repeat(np.cumsum(times) - times, times)
        size = len(h) + 1
        places = np.sort(self.holders[np.repeat(self.first[at], times) + nth] * size + np.repeat(where + start, times))
        held = np.searchsorted(places, items * size + hi) - np.searchsorted(places, items * size + lo)
        return held / self.asked[items] >= ANSWER


def search(docs: DataFrame, items: Items, idf: np.ndarray, v: np.ndarray, key: str, text: str) -> DataFrame:
    """Matches of one block of items in all documents."""
    scaled = np.zeros((TERMS + 1, v.shape[1]), np.float32)
    np.multiply(v, idf[:, None], out=scaled[:TERMS], casting="unsafe")
    sent = docs.sparkSession.sparkContext.broadcast((items, scaled))
    del scaled
    C.trim()
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scaled = sent.value
        for batch in batches:
            out: list[dict] = []
            for a, b, buf, offs in C.slices(batch.column("text"), 1 << 19):
                h, rows = words(buf, offs)
                if not len(h) or not own.ids:
                    continue
                found = Passages(_terms(h), rows, b - a)
                ends = np.searchsorted(rows, np.arange(b - a + 1))
                passage = found.projected(scaled)
                norm = np.linalg.norm(passage, axis=1)
                best: dict[tuple[int, int], dict] = {}
                step = max(1, min(4096, _CELLS // max(1, len(own.ids))))
                for k in range(0, len(passage), step):
                    cos = passage[k : k + step] @ own.vectors.T / np.maximum(norm[k : k + step], 1e-9)[:, None]
                    at, items = np.nonzero(cos >= COSINE)
                    if not len(at):
                        continue
                    s, held = found.seg_at[k + at], found.seg_row[k + at]
                    first = np.maximum(ends[held], s - own.lengths[items])
                    last = np.minimum(ends[held + 1], s + 2 * STRIDE + own.lengths[items])
                    chosen_at = np.flatnonzero(own.answerable(h, items, first, last))
                    for p, i, row, lo, hi in zip(*(x[chosen_at].tolist() for x in (at, items, held, first, last)), strict=True):
                        want = own.words[i]
                        near = h[lo:hi].tolist()
                        answer = len(own.answers[i].intersection(near)) / len(own.answers[i])
                        if answer < ANSWER:
                            continue
                        share = lcs(want, near) / len(want)
                        if share >= LCS and share > best.get((row, i), {"lcs_ratio": 0})["lcs_ratio"]:
                            best[row, i] = {
                                "doc_id": batch.column("doc_id")[a + row].as_py(),
                                "item_id": own.ids[i],
                                "cosine": float(cos[p, i]),
                                "lcs_ratio": share,
                                "answer_share": answer,
                            }
                out += best.values()
            kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "cosine": pa.float64(), "lcs_ratio": pa.float64(), "answer_share": pa.float64()}
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], t) for c, t in kinds.items()})

    return chosen.mapInArrow(C.light(run), "doc_id long, item_id long, cosine double, lcs_ratio double, answer_share double")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = []
        for _, _, buf, offs in C.slices(batch.column("t")):
            h, rows = words(buf, offs)
            cuts = np.searchsorted(rows, np.arange(len(offs)))
            terms += [_terms(h[a:b]).astype(np.uint16).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        yield pa.RecordBatch.from_pydict({"terms": pa.array(terms, pa.binary())})


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents and the benchmark items that they contain, exactly or in other words."""
    C.bounded(docs.sparkSession)
    df, n, texts = survey(docs, text)
    idf = np.log((1.0 + n) / (1.0 + df))
    idf = np.maximum(idf, 1e-3)
    known = C.stage(benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("binary").alias("t")).distinct(), "items")
    n_items = known.count()
    own = known.select("t").mapInArrow(C.light(_item_terms), "terms binary")
    v = basis(texts, own, n_items, idf, n, RANK)  # one basis, whatever the number of items
    blocks = max(1, -(-n_items // ITEMS))
    block = F.pmod(F.xxhash64("item", "t"), F.lit(blocks))
    found = None
    for k in range(blocks):
        rows = known.filter(block == k).orderBy("item", "t").collect()  # about ITEMS short texts
        part = search(docs, Items([r["item"] for r in rows], [bytes(r["t"] or b"") for r in rows], idf, v), idf, v, key, text)
        found = part if found is None else found.unionByName(part)
    return found
