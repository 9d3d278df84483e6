"""Nulls, repeats, clashing names and empty tables through every stage; shards and rules against brute force."""

import collections
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.llm import decontam, mixing, rules, sharding, simhash

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, shard int, generation string, `row` string, s int, id string, h int, kept boolean, __row int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, "g", "r", 2, "i", 3, True, 4) for i, t, s in rows], CLASHING).repartition(3)


def prose(rng, n):
    return " ".join(f"word{rng.randrange(400)}" for _ in range(n)) + "."


def as_rows(df):
    return collections.Counter(map(str, (tuple(r) for r in df.collect())))


def test_two_writers(spark):
    folder = C.shared_dir(spark, "two")
    sharding.append(spark.range(3), folder)
    live, done = sharding.manifest(spark, folder), []

    def write():
        try:
            done.append(sharding.commit(live, folder, 2))
        except sharding.Conflict:
            done.append(None)

    writers = [threading.Thread(target=write) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done, key=str) == [2, None, None, None] and sharding.versions(spark, folder) == [1, 2]
    assert sharding.read(spark, folder, spark.range(1).schema).count() == 3


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    shards = [(f"data/a/{k}", 0, 1, int(4 ** rng.uniform(0, 9)), rng.randrange(40)) for k in range(300)]
    got = collections.defaultdict(set)
    for r in sharding.runs(spark.createDataFrame(shards, sharding.MANIFEST).repartition(4), target=100_000).collect():
        got[r["run"]].add(r["file"])
    tiers, want = collections.defaultdict(list), []
    for file, _, _, size, seq in shards:
        if size < 100_000:
            tiers[int(math.floor(math.log(size) / math.log(4)))].append((seq, file, size))
    for members in tiers.values():
        slots, total = collections.defaultdict(set), 0
        for _, file, size in sorted(members):
            slots[total // 100_000].add(file)
            total += size
        want += [x for x in slots.values() if len(x) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert sharding.runs(spark.createDataFrame([], sharding.MANIFEST)).count() == 0


def test_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FILES", 4)
    monkeypatch.setattr(sharding, "RUN_FILES", 3)
    folder = C.shared_dir(spark, "rounds")
    sharding.append(spark.range(40).coalesce(1), folder, records=2)
    assert sharding.manifest(spark, folder).count() == 20
    assert sharding.compact(spark, folder, spark.range(1).schema) > 2
    assert sharding.manifest(spark, folder).count() == 7
    got = sharding.read(spark, folder, spark.range(1).schema)
    assert sorted(r["id"] for r in got.collect()) == list(range(40)) and got.agg(F.max("shard_docs")).first()[0] == 6


def test_verdicts_against_brute_force(spark):
    rng = random.Random(6)
    texts = {i: prose(rng, 40) if i % 3 else "".join(rng.choice("qxz# ") for _ in range(200)) + " q" * 20 for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)], "doc_id long, quality int")

    def bucket(g):
        code = int.from_bytes(g, "big") * 0x9E3779B1 % 2**32
        code = (code ^ code >> 15) * 0x85EBCA77 % 2**32
        return code >> (32 - rules.BITS)

    grams = {i: [bucket(b[k : k + 4]) for k in range(len(b) - 3)] for i, b in ((i, t.encode()) for i, t in texts.items())}
    raw, good = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if i < 30 and i % 3:
            good.update(g)
    size, total, trusted = 1 << rules.BITS, sum(raw.values()), sum(good.values())

    def ratio(g):
        rest = (raw[g] + 1) / (total + size)
        return math.log((good[g] + rules.SMOOTHING * rest) / (trusted + rules.SMOOTHING)) - math.log(rest)

    got = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    for i, g in grams.items():
        want = sum(map(ratio, g)) / max(1, len(g))
        assert got[i]["llr"] == pytest.approx(want, abs=1e-4)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["llr"] >= rules.THRESHOLD)
    assert len({r["kept"] for r in got.values()}) == 2
    assert sorted(r["doc_id"] for r in rules.keep(docs, labels).collect()) == sorted(i for i in got if got[i]["kept"])


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.randint(12, 40))] for k in range(40)}
    texts, planted = {}, set()
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        if i % 2:
            k = i % 40
            leak = [w for w in items[k] if rng.random() > 0.1]
            at = rng.randrange(len(words))
            words[at:at] = leak
        texts[i] = " ".join(words)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for i, t in texts.items():
        for k, item in items.items():
            if len(set(item) & set(t.split())) >= 0.5 * len(set(item)) and lcs(item, t.split()) >= decontam.LCS * len(item):
                planted.add((i, k))
    docs = spark.createDataFrame([*texts.items(), (None, texts[1]), (1, texts[1]), (500, None), (501, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in items.items()] + [(0, " ".join(items[0]), 2), (98, None, 1), (99, "", 1)], "item_id long, text string, doc_id long")
    got = decontam.leaks(docs.withColumn("item_id", F.lit(7)).withColumn("h", F.lit(1)), bench).collect()
    counted = collections.Counter((r["doc_id"], r["item_id"]) for r in got)
    assert set(counted) == planted | {(None, k) for i, k in planted if i == 1}
    assert all(n == (2 if pair[0] == 1 else 1) for pair, n in counted.items())


def test_near_duplicates_row_by_row(spark):
    rng = random.Random(9)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(5, a, "x"), (None, a, "x"), (None, a, "x"), (None, b, "x"), (7, b, "y"), (7, c, "y"), (7, c, "z"), (None, prose(rng, 60), None), (9, None, "n"), (3, "", "n")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(clashing(spark, rows)).collect())
    assert got == collections.Counter([(5, a), (7, b), (7, c), (None, rows[7][1]), (3, "")])
    out = simhash.keep_one(clashing(spark, rows))
    assert out.columns == clashing(spark, rows).columns


def test_mixture_row_by_row(spark):
    rng = random.Random(10)
    rows = [(None, prose(rng, 30), "s"), (None, prose(rng, 30), "s"), (1, prose(rng, 20), None), (1, prose(rng, 25), None), (2, "", "t"), (3, None, "t")]
    rows += [(4, "same words here", "u")] * 5
    docs = clashing(spark, rows)
    mixed = mixing.materialize(docs)
    taken = collections.Counter()
    for r in mixing.mix(docs, row=C.row_hash(docs)).collect():
        taken[r["row"]] += r["copies"]
    out = collections.Counter(r["h"] for r in mixed.select(C.row_hash(mixed).alias("h")).collect())
    assert mixed.columns == docs.columns and out == +taken
    assert mixing.materialize(docs.limit(0)).count() == 0
    big = mixing._times(spark.createDataFrame([("a", 2500), ("b", 0), ("c", 1000)], "v string, n long"), "n")
    assert {r["v"]: r["count"] for r in big.groupBy("v").count().collect()} == {"a": 2500, "c": 1000}


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    some = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    words = max((t.split() for _, t, _ in some), key=len)
    leaking = f"{' '.join(words[:80])}\n{item}\n{' '.join(words[80:120])}"
    docs = clashing(spark, [*some, *some[:5], (None, some[0][1], None), (None, None, "a"), (None, "", None), (77_777, leaking, "a"), (None, leaking + " more", "b")])
    for name, stage in p.STAGES:
        given = docs
        empty = C.stage(stage(spark, docs.limit(0), sf), "empty")
        docs = C.stage(stage(spark, docs, sf), name.replace(" ", "-"))
        assert empty.count() == 0 and docs.columns[: len(given.columns)] == given.columns
        if name == "decontamination":
            assert docs.filter(F.col("text").contains(item)).count() == 0 < given.filter(F.col("text").contains(item)).count()
        if name != "sharding" and name != "mixing":
            assert not as_rows(docs) - as_rows(given)
    assert docs.columns == [*given.columns, "shard_", "generation_", "shard_docs", "shard_bytes"] and docs.count() == given.count() > 0


def test_classifier_fit_against_brute_force(spark):
    import numpy as np

    from barline.llm import classifier as K

    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 17)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=240) > 0.5).astype(float)
    rows = [(bytearray(r.tobytes()), float(v)) for r, v in zip(x, y, strict=True)]
    got = K.fit(spark.createDataFrame(rows, "x binary, y double").repartition(5))
    wide = x.astype(float)
    want = K.Model(wide.mean(0), wide.std(0) + 1e-6)
    z = want.phi(wide)
    theta = np.linalg.solve(z.T @ z + K.RIDGE * np.eye(z.shape[1]), z.T @ y)
    np.testing.assert_allclose(got.phi(wide) @ got.theta, z @ theta, atol=1e-6)
    # isotonic calibration: the largest of the least means of all ranges that hold a bin
    at = np.clip(((z @ theta - K.LOW) / (K.HIGH - K.LOW) * K.BINS).astype(int), 0, K.BINS - 1)
    some = np.unique(at)
    n, s = np.array([(at == k).sum() for k in some]), np.array([y[at == k].sum() for k in some])
    mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    brute = [max(min(mean(a, b) for b in range(i, len(some))) for a in range(i + 1)) for i in range(len(some))]
    np.testing.assert_allclose(got.steps[1], brute, atol=1e-9)
    assert K.fit(spark.createDataFrame([], "x binary, y double")) is None
