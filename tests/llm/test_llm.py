"""Each operator on a small fixture: brute force, round trips, nulls, empties, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barline.llm import classifier, decontam, lm, mixing, rules, sharding, simhash, suffix, tokens, warc
from barline.llm import common as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies int, fp string, kept string, `id` int"


@pytest.fixture(scope="module")
def rows():
    """Prose, copies, near copies, empty and null values, ties, one very long text, clashing columns."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + ".\nEnd, of it."
    texts = [prose(rng.randint(20, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].replace("End", "Fin"), texts[2] + " " + texts[3], "", None, "one", "two words", " \t\n ", prose(4000), "x " * 300, "a | b $ c\n" * 30]
    out = [(i, t, "en", [None, "s0", "s1", "é"][i % 4], None, 1, "f", "k", 0) for i, t in enumerate(texts)]
    return [*out, out[5], (None, texts[4], None, "s0", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t):
    return (t or "").encode().split()


def test_rules(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(i, None) for i in range(20, 22)] + [(3, 1)], "doc_id long, quality int")
    got = rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        w = words(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        r = by[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), dup)
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(ch in "#*$%&|<>" for ch in t or "")
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and r["kept"] <= (not r["base_failed"])
    assert rules.keep(docs, labels).columns == docs.columns
    assert rules.judge(docs.limit(0), labels).count() == 0 and rules.judge(docs, labels.limit(0)).count() == len(rows)


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(size)
    while True:
        left = 1.5 * sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    target |= share
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.materialize(docs.filter("doc_id < 5")).columns == docs.columns


def test_sharding(spark, docs, rows):
    folder = C.shared_dir(spark, "t")
    assert sharding.append(docs.limit(0), folder) == 1
    for part in (docs.filter("doc_id < 20"), docs.filter("doc_id >= 20 or doc_id is null")):
        sharding.append(part, folder, records=3)
    before = sharding.manifest(spark, folder).count()
    version = sharding.compact(spark, folder, docs.schema, target=20_000)
    live = sharding.manifest(spark, folder)
    assert version == 4 and live.count() < before and live.agg(F.sum("n_docs")).first()[0] == len(rows)
    got = sharding.read(spark, folder, docs.schema)
    assert sorted(map(str, (tuple(r) for r in got.select(*docs.columns).collect()))) == sorted(map(str, map(tuple, docs.collect())))
    assert sharding.read(spark, folder, docs.schema, 3).count() == len(rows)  # an older version is still whole
    with pytest.raises(sharding.Conflict):
        sharding.commit(live, folder, version)
    sharding.vacuum(spark, folder)
    assert sharding.versions(spark, folder) == [1, 2, 3, 4]  # within the grace period nothing goes
    sharding.vacuum(spark, folder, 0)
    assert sharding.versions(spark, folder) == [version] and sharding.read(spark, folder, docs.schema).count() == len(rows)


def test_simhash(spark, docs, rows):
    def brute(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
        hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {r[0]: brute(r[1]) for r in rows}
    root = {i: i for i in prints if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"][0] % 2**64 == prints[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == find(r["doc_id"])
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert {0, 1} <= set(kept) and not {40, 41} & set(kept) and kept.count(5) == 1 and None not in kept
    assert simhash.groups(docs.limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)]
    values = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(12)} | set(centres)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(signed)], "id long, fp array<long>")
    want = {(i, j) for i in range(len(signed)) for j in range(i + 1, len(signed)) if ((signed[i] ^ signed[j]) % 2**64).bit_count() <= 2}
    for hot in (simhash.HOT, 2):  # also with every anchor split
        assert {(r["a"], r["b"]) for r in simhash.links(df, 2, hot).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 101), (100, 102), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[102] == 100


def test_suffix(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 600)
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([30, 49, 50, 51, 90, 200, 400]))) for _ in range(12)]
    noise = lambda: "".join(rng.choice("xyzü ") for _ in range(rng.randint(1, 40)))
    data = [(i * 3 % 61, "".join(rng.choice(pool) if rng.random() < 0.6 else noise() for _ in range(rng.randint(0, 6))) if i % 17 else None) for i in range(60)]
    data += [(7, "a" * 200), (None, pool[5]), (100, "a" * 120), (5, "b" * 60), (5, "b" * 60)]
    rank = lambda i: 10**9 if i is None else i
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 10**10), rank(i))
    want = collections.Counter()
    for i, t in data:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < rank(i):
                gone[p : p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        want[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("block", F.lit(1))
    assert collections.Counter(tuple(r) for r in suffix.deduplicate(df).collect()) == want
    for r in suffix.deduplicate(df, with_text=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in r["spans"]) == r["n_removed"]
    assert suffix.deduplicate(df.limit(0)).count() == 0


def test_difference_cover():
    assert {(a - b) % suffix.V for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.V))


TOKENIZER = "word_bpe_49k.json"


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(TOKENIZER)
    odd = "It's don't. A*. 5.5, x5., É. é! <|endoftext|> a<|endoftext|>. foo.bar... -- (b). 12th A1B2; ſ K İstanbul ΣΑΣ. \x0b x́. 's. AbC.,;\u0085b"
    df = docs.unionByName(spark.createDataFrame([(900, odd, *[None] * 7)], DOCS))
    folder = C.shared_dir(spark, "rec")
    shards = tokens.write(df, folder, path, shard_bytes=5_000)
    got = tokens.read(shards, folder, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    start = 0
    data = sorted([*rows, (900, odd)], key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(data) and shards.count() > 1
    for r, want in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])), data, strict=True):
        ids = [*t.encode(want[1] or "", add_special_tokens=False).ids, 2]
        assert r["doc_id"] == want[0] and r["ids"] == ids and r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    data = tokens.frame(b"abc")
    with pytest.raises(ValueError):
        tokens.unframe(data[:-5] + b"X" + data[-4:], 0)
    assert tokens.read(tokens.write(docs.limit(0), folder + "e", path), folder + "e").count() == 0


def test_warc(spark):
    big = "é" * 90_000
    data = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", big), (6, "u", "<p>x</p>"), (6, "v", "<p>x</p>"), (None, "n", "z"), (5, "w", big), (None, "n", "y" * 80_000), (None, "n", "y" * 80_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("keeper", F.lit(1))
    folder = C.shared_dir(spark, "w")
    files = warc.write(df, folder)
    tokens.write_whole(folder, "pages-000000-0000-lost.warc.gz", warc.records(77, "u", b"left by a lost task", warc.name_of(77, "x"), None, None))
    got = warc.read(spark, folder, with_payload=True, files=files).collect()
    largest = {}
    for i, _, h in data:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(data) and {r["status"] for r in got} == {"ok"}
    assert collections.Counter((r["page_id"], r["payload_digest"]) for r in got) == collections.Counter((i, warc.digest((h or "").encode())) for i, _, h in data)
    texts = {(i, warc.digest((h or "").encode())): h or "" for i, _, h in data}
    for r in got:
        h = texts[r["page_id"], r["payload_digest"]]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == warc.digest(h.encode())
        response = r["page_id"] is None or largest[h] == r["page_id"]
        assert r["record_type"] == ("response" if response else "revisit") and r["refers_to"] == (None if response else largest[h])
        assert not response or bytes(r["payload"]) == h.encode()
    assert warc.read(spark, C.shared_dir(spark, "none")).count() == 0
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_damage(spark):
    one = warc.records(1, "u", b"first", warc.name_of(1, "a"), None, None)
    cut = warc.records(2, "u", b"second" * 50, warc.name_of(2, "b"), None, None)[0]
    parts = warc.records(3, "u", bytes(range(256)) * 400, warc.name_of(3, "c"), None, None)
    wrong = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<w>", "WARC-Payload-Digest": "sha1:X", "X-Page-Id": "4"}, warc.HTTP + warc.chunked(b"fourth"))
    broken = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<f>", "X-Page-Id": "5"}, warc.HTTP + b"5\r\nabc")
    orphan = warc.records(6, "u", b"", "<r>", "<nobody>", 9)
    folder = C.shared_dir(spark, "damaged")
    spoiled = cut[:20] + bytes(8) + cut[28:]
    tokens.write_whole(folder, "a.warc.gz", [*one, spoiled, wrong, broken, *orphan, parts[0], parts[2], b"no archive at all"])
    tokens.write_whole(folder, "b.warc.gz", [*warc.records(7, "u", b"seventh", "<s>", None, None), cut[:-20]])
    got = warc.read(spark, folder).collect()
    by = {r["page_id"]: r["status"] for r in got if r["page_id"] is not None}
    assert by[1] == by[7] == "ok" and by[4] == "digest differs" and by[5].startswith("bad framing") and by[6] == "response missing" and by[3] == "segment missing"
    assert by[2] == "file ends inside the record" and sum(r["page_id"] is None and r["status"] != "ok" for r in got) >= 1
    tokens.write_whole(folder, "c.warc.gz", [parts[1], parts[3][:-1] if len(parts) > 3 else b""])
    again = {r["page_id"]: r["status"] for r in warc.read(spark, folder).collect()}
    assert again[3] != "ok" and again[1] == "ok"


def test_lm_counts_over_32_bits():
    big = np.array([1, 2**32 + 5, 7], np.int64)
    assert lm._unzip_counts(lm._zip_counts(big)).tolist() == big.tolist() and lm._unzip_counts(lm._zip_counts(big[:1])).tolist() == [1]


def test_lm(spark, docs, rows):
    ws = [[w.decode() for w in words(r[1])] for r in rows]
    total = collections.Counter(tuple(w[k : k + n]) for w in ws for n in (1, 2, 3) for k in range(len(w) - n + 1))
    n_all, want = sum(map(len, ws)), collections.Counter()
    for r, w in zip(rows, ws, strict=True):
        own = collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
        c = lambda g, own=own: total[g] - own[g]
        s = 0.0
        for i in range(len(w)):
            value = math.log((c((w[i],)) + 1) / (n_all - len(w) + 1))
            for n in (2, 3):
                if i >= n - 1:
                    g = tuple(w[i - n + 1 : i + 1])
                    value = math.log(c(g) / c(g[:-1])) if c(g) > 0 else value + math.log(0.4)
            s += value
        want[r[0], len(w), round(s, 6)] += 1
    got = lm.score(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in got) == want
    assert all((r["mean_log"] is None) == (r["n_words"] == 0) for r in got) and lm.score(docs.limit(0)).count() == 0


def test_classifier(spark, docs, rows):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = classifier.classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(x["predicted"] == x["quality"] for x in r) / len(r) > 0.95
    got = classifier.classify(docs, labels.limit(0)).collect()
    assert len(got) == len(rows) and {x["score"] for x in got} == {0.5}
    assert classifier.classify(docs.limit(0), labels).count() == 0
    assert classifier.pool(np.array([1.0, 0.0, 2.0]), np.ones(3)).tolist() == [0.5, 0.5, 2.0]


def test_decontamination(spark, docs):
    items = [(1, " ".join(f"term{k} word{k}" for k in range(12))), (2, "completely different question about something else entirely here today"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    around = " ".join(f"plain{k % 37} text{k % 23}" for k in range(60))
    leak = f"{around} {items[0][1].replace('term5 ', '')} {around}"
    extra = spark.createDataFrame([(800, leak), (801, "term1 word1 alone is no leak of anything at all")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()] == [(800, 1)]
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0
    assert decontam.lcs([1, 2, 3, 4, 5], [9, 1, 3, 4, 9, 5]) == 4


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        out = C.stage(stage(spark, docs, sf), name.replace(" ", "-"))
        if name != "sharding":
            assert out.columns == docs.columns
        if name in ("quality rules", "near duplicates", "decontamination"):
            assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() > 0
