"""Near duplicates against exact Jaccard similarity of five-word shingles."""

import random

from barline.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def brute(texts, limit=0.8):
    """The smallest id that chains of exact similarities lead to."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                shared = len(sets[a] & sets[b])
                if shared >= limit * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**9)}"
    return out


def held(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near(df, 5, 0.8).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(i for i in want if want[i] == i)
    return want


def test_no_pair_from_the_limit_up_is_lost(spark):
    rng = random.Random(1)
    texts = {}
    for i in range(120):  # 1 to 5 changed words of 200: similarities from 0.78 to 0.95
        base = prose(rng, 200)
        texts[i], texts[1000 + i] = " ".join(base), " ".join(edited(rng, base, 1 + i % 5))
    texts |= {2000: "", 2001: None, 2002: "one two", 2003: "ONE  two", 2004: "one two three four five", 2005: "a b c d e f"}
    want = held(spark, texts)
    assert sum(want[1000 + i] == i for i in range(120)) > 80
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_shingles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 50)  # crowded keys are also compared in blocks
    rng = random.Random(2)
    texts = {}
    base = prose(rng, 200)
    for i in range(150):  # variants of one text, many of them under 0.8 to each other
        texts[i] = " ".join(edited(rng, base, 2 + i % 4))
    template = prose(rng, 160)
    for i in range(100):  # near copies among texts that share a template
        own = prose(rng, 45)
        texts[1000 + i], texts[2000 + i] = " ".join(template + own), " ".join(template + edited(rng, own, 1))
    held(spark, texts)


def test_documents_under_the_limit_stay(spark):
    rng = random.Random(3)
    template = prose(rng, 160)
    texts = {}
    for i in range(150):  # different texts of similarity 0.72, each with one near copy
        own = prose(rng, 30)
        texts[i], texts[1000 + i] = " ".join(template + own), " ".join(template + own[:-1] + ["end"])
    want = held(spark, texts)
    assert sum(want[i] == i for i in want) == 150
