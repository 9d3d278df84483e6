"""Near duplicates go through fingerprints and anchors first."""

import random

from pyspark.sql import functions as F

from barline.llm import simhash
from tests.llm.test_near import brute, edited, prose


def texts():
    rng, out = random.Random(9), {}
    for i in range(60):  # long texts with one changed word: many are within 2 bits
        base = prose(rng, 600)
        out[i], out[1000 + i] = " ".join(base), " ".join(edited(rng, base, 1))
    return out | {2000: "a b c d e f a b c d e", 2001: "a b c d e f a b c d e f a b c d e", 2002: "", 2003: None}


def test_linked_finds_all_fingerprints_within_two_bits(spark):
    prints = {i: int.from_bytes(simhash.fingerprint((t or "").encode(), 5), "big", signed=True) for i, t in texts().items()}
    one = spark.createDataFrame(list(prints.items()), "s long, fp long")
    same, near = ({(r["a"], r["b"]) for r in x.collect()} for x in simhash.linked(one))
    least = {f: min(i for i in prints if prints[i] == f) for f in prints.values()}
    assert same == {(least[f], i) for i, f in prints.items() if least[f] != i}
    want = {(a, b) for a in least.values() for b in least.values() if a < b and ((prints[a] ^ prints[b]) % 2**64).bit_count() <= 2}
    assert near == want and any(b - a == 1000 for a, b in want)


def test_near_duplicates_ask_the_anchors(spark, monkeypatch):
    asked, links = [], simhash.links

    def spied(prints, *rest):
        asked.append({r["fp"][0] for r in prints.collect()})
        return links(prints, *rest)

    monkeypatch.setattr(simhash, "links", spied)
    rows = texts()
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near(df, 5, 0.8).collect()}
    assert got == brute(rows)
    assert asked == [{r["fp"][0] for r in simhash.fingerprints(df, 5).select(F.col("fp")).collect()}]
