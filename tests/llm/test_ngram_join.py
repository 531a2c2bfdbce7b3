import random

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import ngram_join

from .samples import ODD, documents, prose
from .test_neardup import brute, edited, shingles


def found(docs, **how):
    return sorted(map(tuple, ngram_join.linked(docs, **how).collect()))


def crowd(rng):
    """Near copies at all distances, chains, stars, and texts that share a frame."""
    texts = list(ODD)
    for i in range(25):
        base = prose(i, 30 + 12 * i)
        texts += [base, base.upper(), base]
        texts += [edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05)]
        texts += [base + " " + prose(900 + i, n) for n in (1, 3, 8)]
    chain = prose(77, 250)
    for _ in range(30):
        chain = edited(rng, chain, 0.01)
        texts.append(chain)
    star = prose(99, 150)
    texts += [edited(rng, star, 0.02) for _ in range(120)]
    frame = prose(55, 120)
    texts += [f"{frame} {prose(2000 + i, 20 + i % 7)}" for i in range(80)]
    return texts


def test_components_equal_brute_force(spark):
    texts = crowd(random.Random(2))
    docs = documents(spark, texts).withColumns({c: F.lit("clash") for c in ("key", "node", "n", "component_id", "set")})
    assert found(docs) == [x[:3] for x in brute(texts, 4, 85)]


def test_packs_and_frequent_ngrams(spark, monkeypatch):
    """Groups in many packs; n-grams that the sample shows to be frequent."""
    monkeypatch.setattr(ngram_join, "PACK", 1 << 11)
    monkeypatch.setattr(ngram_join, "SAMPLE", 200)
    monkeypatch.setattr(ngram_join, "OFTEN", 5)
    texts = crowd(random.Random(4))
    assert found(documents(spark, texts)) == [x[:3] for x in brute(texts, 4, 85)]


def test_other_sizes_and_thresholds(spark):
    texts = crowd(random.Random(6))[:200]
    for shingle, percent in ((1, 60), (5, 95)):
        assert found(documents(spark, texts), shingle=shingle, percent=percent) == [x[:3] for x in brute(texts, shingle, percent)]


def test_pairs_at_the_threshold(spark):
    rng = random.Random(9)
    texts, pairs = [], []
    while len(pairs) < 400:
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(20, 90))]
        other = list(base)
        at = rng.randrange(len(base))
        other[at : at + 2] = [f"e{rng.randrange(10**7)}" for _ in other[at : at + 2]]
        a, b = shingles(" ".join(base), 4), shingles(" ".join(other), 4)
        if 83 <= 100 * len(a & b) / len(a | b) <= 87:
            pairs.append((len(texts), len(texts) + 1, 100 * len(a & b) >= 85 * len(a | b)))
            texts += [" ".join(base), " ".join(other)]
    got = {i: c for i, _, c in found(documents(spark, texts))}
    assert [p for p in pairs if (got[p[1]] == p[0]) != p[2]] == []
    assert 50 < sum(p[2] for p in pairs) < 350


def test_trie_counts_what_plain_sets_count():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 120, rng.integers(1, 110))) for _ in range(40)]
        sets += [np.unique(np.append(sets[0], rng.integers(0, 120, k))) for k in range(4)] + [sets[1]]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        n = np.array([len(s) for s in sets]) + rng.integers(0, 4, len(sets))
        trie = ngram_join.Trie(np.concatenate(sets), bounds, n)
        q, i = trie.partners(sets, n, n, 60, 120)
        plain = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if 160 * len(np.intersect1d(sets[a], sets[b])) >= 60 * (n[a] + n[b])}
        assert set(zip(q.tolist(), i.tolist(), strict=True)) == plain


def test_empty_null_and_repeated_ids(spark):
    assert ngram_join.linked(documents(spark, [])).count() == 0
    base = prose(3, 60)
    rows = [(7, base), (9, base + " end"), (9, "other text of few words here"), (4, "other text of few words here"), (None, base), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.linked(docs).collect()}
    assert got == {(7, 4), (9, 4), (4, 4), (None, None), (11, 11)}
