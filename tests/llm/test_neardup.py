import random
import re

from pyspark.sql import functions as F

from skyloom.llm import neardup
from skyloom.llm.graph import components

from .samples import ODD, documents, prose


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def edited(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    texts = list(ODD)
    for i in range(25):
        base = prose(i, 30 + 10 * i)
        texts += [base, base.upper(), base]
        texts += [edited(rng, base, s) for s in (0.02, 0.04, 0.05, 0.06, 0.1, 0.3)]
    chain = prose(77, 200)
    for _ in range(30):
        chain = edited(rng, chain, 0.04)
        texts.append(chain)
    star = prose(99, 120)
    texts += [edited(rng, star, 0.05) for _ in range(120)]
    docs = documents(spark, texts).withColumn("key", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    out = neardup.near_duplicates(docs, shingle=2)
    assert sorted(map(tuple, out.collect())) == brute(texts, 2, 80)


def test_no_pair_near_the_threshold_is_lost(spark):
    """Thousands of pairs of similarity 0.80 to 0.82, each of which has to be linked."""
    rng = random.Random(6)
    texts, pairs = [], []
    while len(pairs) < 3000:
        n = rng.randrange(40, 120)
        base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        other = list(base)
        runs = rng.randrange(1, 4)
        for _ in range(runs):
            at, size = rng.randrange(n), max(1, round(n * 0.1 / runs) - 1)
            other[at : at + size] = [f"e{rng.randrange(10**7)}" for _ in other[at : at + size]]
        a, b = shingles(" ".join(base), 2), shingles(" ".join(other), 2)
        if 80 <= 100 * len(a & b) / len(a | b) <= 82:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(base), " ".join(other)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), shingle=2).collect()}
    assert [p for p in pairs if got[p[0]] != p[0] or got[p[1]] != p[0]] == []


def test_group_of_several_components_and_packs(spark, monkeypatch):
    """One large group of texts that share half of their words, in many components."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(7)
    shared = prose(1, 60)
    texts = []
    for i in range(60):
        own = f"{shared} {prose(1000 + i, 25)}"
        texts += [own, edited(rng, own, 0.03)]
    out = neardup.near_duplicates(documents(spark, texts), shingle=2)
    assert sorted(map(tuple, out.collect())) == brute(texts, 2, 80)


def test_rows_of_crowded_groups_do_not_multiply(spark, monkeypatch):
    """However many times BLOCK a group holds, none of its members becomes a row for each part of it."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = {}

    def written(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    keep = neardup.written
    monkeypatch.setattr(neardup, "written", written)
    rng = random.Random(11)
    shared = prose(3, 100)
    texts = [f"{edited(rng, shared, 0.03)} {prose(2000 + i, 22)}" for i in range(150)]
    texts += [edited(rng, shared, 0.04) for _ in range(50)]
    out = neardup.near_duplicates(documents(spark, texts), shingle=2)
    assert sorted(map(tuple, out.collect())) == brute(texts, 2, 80)
    assert rows["crowded"] > 0
    assert rows["close"] <= rows["members"]


def test_empty_and_null_ids(spark):
    assert neardup.near_duplicates(documents(spark, []), shingle=5).count() == 0
    docs = documents(spark, ["a b c", "a b c"]).unionByName(spark.createDataFrame([(None, "a b c", None, None, None)], documents(spark, []).schema))
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, shingle=5).collect()}
    assert got == {(0, 0, True), (1, 0, False), (None, None, True)}


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}
