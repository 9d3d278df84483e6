"""The latent basis of decontamination against all passages, and candidates that the answer words rule out."""

import random

import numpy as np
import pytest

from barline.llm import decontam as D


def passages(texts):
    """Term lists of all passages of ``2 * STRIDE`` words, half overlapping, by plain slicing."""
    out = []
    for t in texts:
        h, _ = D.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        terms = D._terms(h)
        out += [terms[k : k + 2 * D.STRIDE] for k in range(0, len(terms), D.STRIDE)]
    return out


def prose(rng, first, n):
    return " ".join(f"w{first + int(300 * rng.random() ** 2)}" for _ in range(n))


@pytest.mark.parametrize("limit", [4096, 50])
def test_basis_against_all_passages(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "PASSAGES", limit)
    rng = random.Random(5)
    # 12 subjects with words of their own: their passages have 12 directions that no item has.
    texts = [prose(rng, 1000 * (i % 12), rng.choice([1, 31, 33, 64, 200, 900])) for i in range(240)]
    items = [prose(rng, 50_000 + 1000 * i, 20) for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df, n, stored = D.survey(docs, "text")
    rows = passages(texts)
    assert n == len(rows)
    idf = np.maximum(np.log((1.0 + n) / (1.0 + df)), 1e-3)

    a = np.zeros((n + len(items), D.TERMS))
    for r, terms in enumerate([*rows, *(p for t in items for p in passages([t]))]):
        np.add.at(a[r], terms, idf[terms])
        a[r] *= (D.ITEM_WEIGHT if r >= n else min(1.0, limit / n) ** 0.5) / np.linalg.norm(a[r])
    own = bench.selectExpr("cast(text as binary) t").mapInArrow(D._item_terms, "terms binary")
    v = D.basis(stored, own, len(items), idf, n, 16).astype(np.float64)
    assert np.allclose(v.T @ v, np.eye(16), atol=1e-3)

    # a second product with all rows, which the single pass does without, finds no more of them
    g = np.random.default_rng(D.SEED).standard_normal((D.TERMS, 16 + D.EXTRA), np.float32)
    q = np.linalg.qr(a.T @ (a @ g))[0]
    values, vectors = np.linalg.eigh((a @ q).T @ (a @ q))
    want = q @ vectors[:, np.argsort(-values)[:16]]
    assert np.linalg.norm(a @ v) ** 2 >= 0.998 * np.linalg.norm(a @ want) ** 2
    assert np.allclose(np.linalg.norm(a[n:] @ v, axis=1), np.linalg.norm(a[n:] @ want, axis=1), rtol=2e-3)


def test_answerable_keeps_every_candidate_with_enough_answers():
    rng = np.random.default_rng(3)
    idf, v = np.ones(D.TERMS), rng.standard_normal((D.TERMS, 8))
    items = D.Items(list(range(30)), [" ".join(f"w{x}" for x in rng.integers(0, 60, 12)).encode() for _ in range(30)], idf, v)
    text = " ".join(f"w{x}" for x in rng.integers(0, 60, 2000)).encode()
    h, _ = D.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    lo = rng.integers(0, 1990, 4000)
    hi, which = np.minimum(lo + rng.integers(1, 60, 4000), 2000), rng.integers(0, 30, 4000)
    got = items.answerable(h, which, lo, hi)
    enough = np.array([len(items.answers[i].intersection(h[a:b].tolist())) / len(items.answers[i]) >= D.ANSWER for i, a, b in zip(which.tolist(), lo.tolist(), hi.tolist())])
    assert enough.any() and got[enough].all() and not got.all()
