import random
import re

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import decontaminate

from .samples import ODD, documents, prose


def split(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def edit(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["other%d" % rng.randrange(99)] if x < share else [w]
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    items = {i: prose(5000 + i, 12 + 5 * i) for i in range(12)}
    texts = list(ODD)
    for i in range(60):
        passage = edit(rng, items[i % 12].split(), (0, 0.1, 0.25, 0.6)[i % 4])
        texts.append(prose(i, rng.randrange(0, 60)) + " " + " ".join(passage) + ". " + prose(900 + i, rng.randrange(0, 60)))
    texts += [prose(7000 + i, 200) for i in range(20)] + [items[3].upper() + "!", items[3] + " and " + items[3]]
    bench = spark.createDataFrame([*items.items(), (50, None), (51, ""), (52, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(documents(spark, texts).repartition(4), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in items.items():
            s = smith_waterman(split(x), split(t)) / (2 * len(split(x)))
            if s >= 0.5:
                want[d, i] = s
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_places_types_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW", 1)
    monkeypatch.setattr(decontaminate, "TOGETHER", 2)
    items = {i: prose(5000 + i, 20) for i in range(5)}
    bench = spark.createDataFrame([*((float(k), v) for k, v in items.items()), (9.0, items[0])], "item_id double, text string")
    docs = documents(spark, [f"{prose(1, 7)} {items[i]} {prose(2, 9)}" for i in range(5)] + [f"{prose(1, 7)} {items[1]} {prose(2, 9)}"])
    docs = docs.withColumns({c: F.lit("clash") for c in ("k1", "g", "words", "item_id", "score")}).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert got == sorted([(f"d{i}", float(i), 1.0, 7, 26) for i in range(5)] + [("d5", 1.0, 1.0, 7, 26), ("d0", 9.0, 1.0, 7, 26)])
    every = documents(spark, [" . ".join(items.values())])
    assert {r["item_id"] for r in decontaminate.leaks(every, bench).collect()} == {0.0, 1.0, 2.0, 3.0, 4.0, 9.0}


def test_short_items_match_exactly(spark):
    bench = spark.createDataFrame([(1, "Zebra"), (2, "blue  zebra!"), (3, ""), (4, "...")], "item_id long, text string")
    docs = documents(spark, ["a zebra here", "a blue, Zebra", "zebras", "blue x zebra", None])
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["first_word"], r["last_word"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1, 1.0, 1, 1), (1, 1, 1.0, 2, 2), (1, 2, 1.0, 1, 2), (3, 1, 1.0, 2, 2)]


def test_edited_copies_are_recalled(spark):
    """Recall by share of edited words, among copies whose alignment is good enough."""
    rng = random.Random(11)
    items = {i: prose(9000 + i, 30 + i % 50) for i in range(60)}
    texts, truth = [], []
    for share in (0.05, 0.15, 0.25):
        for i, x in items.items():
            passage = edit(rng, x.split(), share)
            truth.append((share, i, smith_waterman(split(x), split(" ".join(passage))) >= len(split(x))))
            texts.append(f"{prose(i, 30)} {' '.join(passage)} {prose(i + 300, 30)}")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    for share, least in ((0.05, 1.0), (0.15, 1.0), (0.25, 0.97)):
        wanted = [(d, i) for d, (s, i, good) in enumerate(truth) if s == share and good]
        assert len(wanted) > 30 and sum(x in got for x in wanted) >= least * len(wanted)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents(spark, ["a b c"]), none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.leaks(documents(spark, []), some).count() == 0
