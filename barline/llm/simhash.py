"""SimHash near-duplicate detection with anchor-point covering.

Fingerprints.  A document's words (A-Z lower-cased) give n-word shingles, each
shingle's XXH64 votes on 64 bits, and a fingerprint bit is 1 if over half the
hashes have it set.  With ``words64 > 1`` further independent fingerprints come
from remixed hashes.

Anchors.  Each fingerprint is cut into 32-bit segments.  The anchors of a
segment are the codewords of the perfect [31, 26] Hamming code (covering radius
1) on its low 31 bits.  A fingerprint is at home at the one anchor within
radius 1 and is replicated to every anchor within radius 1 + 1 (at most 16).
Two fingerprints whose segments differ in at most one bit therefore meet, at
the home anchor of either.  With one fingerprint (two segments) and a limit of
2 bits (or 3) one segment always differs in at most 1 bit, so no link is lost.
Longer fingerprints would lose links and are not linked.

Only distinct fingerprints are compared, so copies never multiply.  An anchor
that holds more than ``HOT`` fingerprints is split by the other segment: within
2 bits, one of its three pieces is equal, so the pieces are the new keys and
the result is still exact.  Components come from alternating large-star and
small-star steps, each written to the shared folder.

Near duplicates (``keep_one``) are the pairs whose sets of shingle hashes have at
least a given Jaccard similarity, exactly.  Fingerprints meet at anchors as above,
and the exact similarity of the whole sets decides on each link.  Similar texts
may differ in more than 2 bits, so what is not in one component by then is looked
for by the shingles themselves.  They have one order for all documents: by how
often their bucket of ``SKETCH`` occurs, then by hash.  Two sets whose similarity is
at least p/q share one of the first n - ceil(n p/q) + 1 shingles of each (prefix
filter), so no pair is lost; where they first meet, what is left bounds their
overlap, and the exact similarity decides again.  Only components are wanted, so
each shingle first compares its documents with one of them, a different one each
time; then all pairs there that are not yet in one component are compared.

Null and empty texts have fingerprint zero and are linked like any other; a
null doc_id keeps its row and takes its group's smallest id; repeated rows give
repeated result rows; an empty table gives an empty result.  ``keep_one`` names
rows by id and a hash of all columns, so rows with null or repeated ids are kept
or dropped one by one; extra columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEED = 42
#: Fingerprints at one anchor beyond which the anchor is split.
HOT = 4096
#: Buckets in which shingles are counted (a fixed size), and the pieces in which the counts are summed.
SKETCH, _PIECES = 1 << 20, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def fingerprint(text: bytes | None, shingle: int = 3, words64: int = 1) -> bytes:
    """Big-endian fingerprint of ``8 * words64`` bytes."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8 * words64)
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        parts = [digest(b" ".join(words), SEED)]
    else:
        parts = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
    half, out = len(parts), []
    joined = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8)
    for k in range(words64):
        if k:
            own = C.mix(joined.view(">u8").reshape(-1).astype(np.uint64) + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64))
            votes = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        else:
            votes = np.unpackbits(joined, axis=1)
        out.append(np.packbits(2 * votes.sum(axis=0, dtype=np.int64) > half).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 3, words64: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id`` and ``fp``, an array of ``words64`` longs."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(texts), 1000):
                prints = b"".join(fingerprint(x.as_py(), shingle, words64) for x in texts[a : a + 1000])
                values = np.frombuffer(prints, ">i8").astype(np.int64)
                n = len(values) // words64
                fp = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words64), pa.array(values))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a : a + n], "fp": fp})

    C.bounded(docs.sparkSession)
    return chosen.mapInArrow(C.light(run), "doc_id long, fp array<long>")


def _segments(prints: DataFrame) -> DataFrame:
    """A row for each 32-bit segment: its number, low 31 bits, syndrome and home codeword."""
    # native on purpose: bit arithmetic inside code generation
    cut = prints.select(
        "id",
        "fp",
        F.posexplode(F.flatten(F.transform("fp", lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))))).alias("seg", "bits"),
    )
    y = cut.withColumn("y", F.col("bits").bitwiseAND(F.lit(0x7FFFFFFF)).cast("long"))
    syndrome = sum(
        ((F.bit_count(F.col("y").bitwiseAND(F.lit(m))) % 2) * F.lit(1 << j) for j, m in enumerate(_PARITY)), F.lit(0)
    )
    return y.withColumn("s", syndrome.cast("int"))


def anchors(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Home rows and replica rows, each with ``key`` (segment and codeword), ``id`` and ``fp``."""
    base = _segments(prints)
    home_word = "y ^ if(s = 0, 0L, shiftleft(1L, s - 1))"
    near = (
        "if(s = 0, array(y), array_union(array(y ^ shiftleft(1L, s - 1)), "
        "transform(filter(sequence(1, 31), b -> b < (b ^ s) and b != s), "
        "b -> y ^ shiftleft(1L, b - 1) ^ shiftleft(1L, (b ^ s) - 1))))"
    )
    key = "shiftleft(cast(seg as bigint), 32) | "
    homes = base.select(F.expr(f"{key}({home_word})").alias("key"), "id", "fp", "seg")
    replicas = base.select(F.explode(F.expr(near)).alias("word"), "id", "fp", "seg").select(
        F.expr(f"{key}word").alias("key"), "id", "fp", "seg"
    )
    return homes, replicas


def _split(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot anchors once for each third of the other segment, the others as they are."""
    other = "if(seg = 0, fp[0] & 4294967295L, shiftrightunsigned(fp[0], 32))"
    pieces = f"transform(sequence(0, 2), k -> named_struct('k', k, 'v', (shiftrightunsigned({other}, k * 11)) & 2047L))"
    marked = rows.join(hot, "key", "left")
    return marked.select(
        "key", F.explode(F.expr(f"if(hot, {pieces}, array(named_struct('k', -1, 'v', 0L)))")).alias("piece"), "id", "fp"
    ).select("key", F.col("piece.k").alias("k"), F.col("piece.v").alias("v"), "id", "fp")


def links(prints: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """Pairs ``a < b`` of ids whose fingerprints differ in at most ``max_bits`` bits.

    ``prints``: distinct fingerprints ``fp`` (array of longs) with a unique ``id``.
    """
    words64 = prints.select(F.size("fp").alias("n")).limit(1).collect()
    if not words64:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    if words64[0]["n"] != 1:
        raise ValueError("only one 64-bit fingerprint is covered exactly")
    if max_bits > 3:
        raise ValueError("one 64-bit fingerprint is covered exactly up to 3 bits")
    homes, replicas = anchors(prints)
    crowded = replicas.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    if max_bits <= 2:
        on = ["key", "k", "v"]
        homes, replicas = _split(homes, crowded), _split(replicas, crowded)
    else:
        on = ["key"]
    h = homes.select(*on, F.col("id").alias("h"), F.expr("fp[0]").alias("fh"))
    r = replicas.select(*on, F.col("id").alias("r"), F.expr("fp[0]").alias("fr"))
    near = h.join(r, on).filter((F.bit_count(F.col("fh").bitwiseXOR(F.col("fr"))) <= max_bits) & (F.col("h") != F.col("r")))
    return near.select(F.least("h", "r").alias("a"), F.greatest("h", "r").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest id reachable) of every node of ``edges(a, b)``.

    Alternating large-star and small-star; every node keeps a bounded number of
    rows, and a round is two aggregations and two joins.
    """
    begun, before = C.n_staged(), None
    now = C.stage(edges.filter("a != b").select("a", "b").distinct(), name)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        moved = large.join(least, "u").filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        now = C.stage(kept.unionByName(moved).distinct(), name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    C.discard(edges.sparkSession, begun)
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())


def groups(docs: DataFrame, shingle: int = 3, words64: int = 1, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``fp`` and ``component_id``, the smallest linked doc_id."""
    prints = C.stage(fingerprints(docs, shingle, words64, key, text), "prints")
    reps = C.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    edges = links(reps.filter("id is not null"), max_bits)
    roots = components(edges)
    named = reps.join(roots, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def shingle_sets(buf: np.ndarray, offs: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; under ``shingle`` words the whole text is the only one."""
    plain = _LOWER[buf]
    starts, ends, rows = C.word_spans(plain, offs)
    h = C.span_hash(C.prefix_hash(plain), starts, ends)
    grams, _ = C.ngrams(h, rows, shingle)
    cuts = np.searchsorted(rows, np.arange(len(offs)))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= shingle:
            out.append(C.distinct(grams[a : b - shingle + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED)], np.uint64))
    return out


def _signature(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def sketch(texts: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each bucket occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, buf, offs in C.slices(batch.column("text")):
                total += np.bincount(_bucket(np.concatenate(shingle_sets(buf, offs, shingle))), minlength=SKETCH)
        parts = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(_PIECES, -1)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(_PIECES), pa.int32()), "v": [p.tobytes() for p in parts]})

    found = C.vector_sums(texts.select("text").mapInArrow(C.light(run), "k int, v binary"), np.uint32)
    out = np.zeros((_PIECES, SKETCH // _PIECES), np.uint32)
    for k, v in found.items():
        out[k] = np.minimum(v, 2**32 - 1)
    return out.reshape(-1)


#: What names a row: whether its id is null, the id, and a hash of the whole row.
_ID = "struct<z: boolean, i: bigint, h: bigint>"


def row_id(docs: DataFrame, key: str = "doc_id") -> Column:
    """Names each row, also where ids are null or repeated; only rows alike in all columns share a name."""
    own = F.col(key).cast("long")
    return F.struct(own.isNull().alias("z"), F.coalesce(own, F.lit(0)).alias("i"), C.row_hash(docs).alias("h"))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A 256-bit map of a set: each hash flips one bit.  Maps of sets that differ by d elements differ in d bits at most."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def prefixes(texts: DataFrame, counts: np.ndarray, shingle: int, p: int, q: int) -> DataFrame:
    """``id``, ``s`` (the set's signature), ``n`` (its size), the text's fingerprint ``fp``, the set's map ``bits`` and its first shingles ``keys`` in the common order."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            for a, b, buf, offs in C.slices(batch.column("text")):
                sets = shingle_sets(buf, offs, shingle)
                first = [x[np.argsort(often[_bucket(x)], kind="stable")[: len(x) + 1 + -len(x) * p // q]] for x in sets]
                prints = np.frombuffer(b"".join(fingerprint(x.as_py(), shingle) for x in batch.column("text")[a:b]), ">i8").astype(np.int64)
                columns = [batch.column("id")[a:b], pa.array([_signature(x) for x in sets]), pa.array([len(x) for x in sets]), pa.array(prints), _longs([_bits(x) for x in sets]), _longs(first)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "s", "n", "fp", "bits", "keys"])

    return texts.mapInArrow(C.light(run), f"id {_ID}, s long, n long, fp long, bits array<long>, keys array<long>")


def linked(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` of sets ``s`` by their fingerprints ``fp``: sets of one fingerprint with the smallest of them, and linked fingerprints' smallest sets."""
    prints = C.stage(one.groupBy("fp").agg(F.min("s").alias("id")).select("id", F.array("fp").alias("fp")), "prints")
    same = one.select("s", "fp").join(prints.select("id", F.col("fp")[0].alias("fp")), "fp").filter("s != id")
    return same.select(F.least("s", "id").alias("a"), F.greatest("s", "id").alias("b")), C.stage(links(prints), "links")


def unjoined(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are not in one component yet."""
    for x in ("a", "b"):
        pairs = pairs.join(root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    return pairs.filter("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """The pairs ``a, b`` of signatures whose sets have a Jaccard similarity of at least p/q."""
    begun = C.n_staged()
    asked = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = C.stage(reps.join(asked, "s", "left_semi").select(F.col("id").alias("__id")).distinct(), "asked")
    chosen = texts.join(C.small(wanted, 48, wanted.count()), F.col("id") == F.col("__id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in C.slices(batch.column("text")):
                sets = shingle_sets(buf, offs, shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_signature(x) for x in sets]), _longs(sets)], ["s", "hashes"])

    sets = C.stage(chosen.select("text").mapInArrow(C.light(run), "s long, hashes array<long>").dropDuplicates(["s"]), "sets")
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("s").alias("b"), F.col("hashes").alias("hb")), "b"
    )
    shared = F.size(F.array_intersect("ha", "hb")) * F.lit(p + q)
    found = C.stage(both.filter(shared >= F.lit(p) * (F.size("ha") + F.size("hb"))).select("a", "b"), "similar")
    C.discard(texts.sparkSession, begun)  # the sets are not read again
    return found


def classes(docs: DataFrame, shingle: int, similarity: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row: its name ``id`` and ``root``, the smallest name that a chain of similarities of at least ``similarity`` leads to."""
    limit = Fraction(str(similarity))
    p, q = limit.numerator, limit.denominator
    texts = docs.select(row_id(docs, key).alias("id"), F.col(text).cast("binary").alias("text"))
    found = C.stage(prefixes(texts, sketch(texts, shingle), shingle, p, q), "prefixes")
    reps = C.stage(found.groupBy("s").agg(F.min("id").alias("id")), "reps")
    # one row a set: copies never multiply
    one = found.join(reps, ["s", "id"], "left_semi").dropDuplicates(["s"])
    # First the pairs that the anchors find: one link of each fingerprint; then the links that these do not settle.
    same, near_prints = linked(one)
    tried = C.stage(near_prints.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(same).distinct(), "tried")
    edges = similar(tried, texts, reps, shingle, p, q)
    root = components(edges)
    del same
    C.release(docs.sparkSession)  # the shuffles of the anchors go before those of the shingles come
    # Then the pairs over 2 bits apart, which no anchor need find: the shingles lose none of them.
    rows = one.select("s", "n", F.posexplode("keys").alias("pos", "key")).select("key", "s", F.struct("n", "pos").alias("at"))
    at_key = Window.partitionBy("key")
    hub = F.min(F.struct(F.xxhash64("s", "key").alias("r"), "s", "at")).over(at_key)
    shared = rows.select("*", F.count("*").over(at_key).alias("m"), hub.alias("hub")).filter("m > 1")
    shared = C.stage(shared.select("key", "s", "at", "m", F.col("hub.s").alias("h"), F.col("hub.at").alias("h_at")), "shared")
    del rows
    C.release(docs.sparkSession)

    def enough(x: str, y: str) -> Column:
        """Where two sets first meet, the rest of the smaller one is the most that they can share."""
        return F.expr(f"{p + q} * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {p} * ({x}.n + {y}.n)")

    stars = shared.filter((F.col("s") != F.col("h")) & enough("at", "h_at"))
    stars = stars.select(F.least("s", "h").alias("a"), F.greatest("s", "h").alias("b")).unionByName(near_prints.select("a", "b")).distinct()
    stars = C.stage(unjoined(stars, root).join(tried, ["a", "b"], "left_anti"), "stars")
    edges = edges.unionByName(similar(stars, texts, reps, shingle, p, q))
    root = components(edges)
    named = shared.join(root, F.col("s") == F.col("node"), "left").select("key", "s", "at", "m", F.coalesce("root", "s").alias("c"))
    named = C.stage(named, "named")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 != c1").select("key")
    maps = found.select("s", "bits").dropDuplicates(["s"])
    open_keys = named.join(mixed, "key", "left_semi").join(maps, "s")
    # A crowded shingle is cut into blocks of one side, each compared with all of the other.
    blocks = F.expr(f"cast(ceil(m / {HOT}) as int)")
    left = open_keys.select("key", F.pmod(F.xxhash64("s"), blocks).cast("int").alias("block"), F.col("s").alias("a"), F.col("at").alias("a_at"), F.col("c").alias("ca"), F.col("bits").alias("ba"))
    right = open_keys.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("s").alias("b"), F.col("at").alias("b_at"), F.col("c").alias("cb"), F.col("bits").alias("bb"))
    meet = (left["key"] == right["key"]) & (left["block"] == right["block"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    # Sets that share x differ by n + n' - 2 x elements, so in at most as many bits of their maps: an exact bound on x.
    apart = " + ".join(f"bit_count(ba[{k}] ^ bb[{k}])" for k in range(4))
    close = F.expr(f"{p + q} * (a_at.n + b_at.n - ({apart})) >= {2 * p} * (a_at.n + b_at.n)")
    rest = left.join(right, meet & enough("a_at", "b_at") & close).select("a", "b").distinct().join(stars.unionByName(tried), ["a", "b"], "left_anti")
    more = similar(C.stage(rest, "rest"), texts, reps, shingle, p, q)
    root = components(edges.unionByName(more))
    named = reps.join(root, F.col("s") == F.col("node"), "left").select("s", "id", F.coalesce("root", "s").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    sets = C.stage(named.join(least, "root").select("s", "least"), "near")
    return found.select("id", "s").join(sets, "s").select("id", F.col("least").alias("root"))


def near(docs: DataFrame, shingle: int, similarity: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id`` and ``component_id``, the smallest id of its group (null if none has one)."""
    own = lambda c: F.when(~F.col(f"{c}.z"), F.col(f"{c}.i"))
    return classes(docs, shingle, similarity, key, text).select(own("id").alias("doc_id"), own("root").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near duplicates one row, that of the smallest id (null last); columns as given.

    Rows are named by ``row_id``, so null and repeated ids are treated row by row;
    rows alike in all columns are one group and one of them stays.
    """
    found = classes(docs, shingle, similarity, key, text)
    kept = C.stage(found.filter("id = root").select(F.col("id.h").alias("__h"), F.col("id.i").alias("__i"), F.col("id.z").alias("__z")).distinct(), "kept")
    marked = docs.select(row_id(docs, key).alias("__id"), F.struct("*").alias("__row")).select("__id.h", "__id.i", "__id.z", "__row")
    held = marked.join(kept.hint("merge"), (F.col("h") == F.col("__h")) & (F.col("i") == F.col("__i")) & (F.col("z") == F.col("__z")), "left_semi")
    return held.dropDuplicates(["h", "i", "z"]).select("__row.*")
