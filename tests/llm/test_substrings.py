import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import substrings

from .samples import ODD, documents, prose


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for k, r in enumerate(raws):
        mark, end = [False] * len(r), 0
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    mark[j] = True
                end = i + length
        left = bytes(b for b, m in zip(r, mark, strict=True) if not m)
        runs = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((k, len(r), sum(mark), runs, hashlib.sha256(left).hexdigest()))
    return out


def texts():
    rng = random.Random(4)
    passage, long_one = prose(1000, 90), prose(1001, 400)
    out = [*ODD, "ab" * 900, "ab" * 700, "x" * 3000, "x" * 401 + "y", "é" * 500, prose(5, 30) * 40]
    for i in range(60):
        out.append(f"{prose(i, rng.randrange(5, 80))} {passage} {prose(i + 500, rng.randrange(5, 80))}")
    for i in range(20):
        out.append(("a", "b", "ab", "ba")[i % 4] + passage + ("", "c", "d")[i % 3])
    for i in range(6):
        w = long_one.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    out += [long_one, long_one, long_one[:399], long_one[:400], long_one[50:450] + "!" + long_one[449:900]]
    return out


@pytest.mark.parametrize("crowd", [1000, 8])
def test_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    data = texts()
    docs = documents(spark, data).withColumn("row_key", F.lit("clash")).withColumn("n_bytes", F.lit("clash")).repartition(5)
    out = substrings.repeated_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, out)) == brute(data)


def test_order_equals_plain_sort():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 4, 200):
        text = np.append(rng.integers(97 if alphabet < 100 else 0, 97 + alphabet if alphabet < 100 else 200, 900).astype(np.uint8), 255).astype(np.uint8)
        wanted = rng.random(901) < 0.4
        wanted[-420:] = False
        got = substrings.two_stage_order(text, wanted, 400)
        raw = text.tobytes()
        assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [raw[i : i + 400] for i in got]
        assert keys == sorted(keys)


def test_null_ids_and_empty(spark):
    assert substrings.repeated_substrings(documents(spark, [])).count() == 0
    long_one = prose(3, 300)
    schema = documents(spark, []).schema
    docs = spark.createDataFrame([(None, long_one, None, None, None), (None, "new " + long_one, None, None, None), (7, None, None, None, None)], schema)
    out = {r["n_bytes"]: (r["n_removed"], r["n_spans"]) for r in substrings.repeated_substrings(docs).collect()}
    n = len(long_one.encode())
    assert out == {n: (n, 1), n + 4: (n, 1), 0: (0, 0)}


def brute_passages(texts, n=50):
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    lists = [[(t or "").encode()[a:z] for a, z in spans] for t, spans in zip(texts, found, strict=True)]
    holders = defaultdict(set)
    for k, w in enumerate(lists):
        for i in range(len(w) - n + 1):
            holders[tuple(w[i : i + n])].add(k)
    out = []
    for w, spans in zip(lists, found, strict=True):
        runs = []
        for i in range(len(w) - n + 1):
            if len(holders[tuple(w[i : i + n])]) > 1:
                a, z = spans[i][0], spans[i + n - 1][1]
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
        out.append([tuple(r) for r in runs])
    return out


def test_passages_below_length_equal_brute_force(spark):
    rng = random.Random(6)
    short = [" ".join(w[:5] for w in prose(2000 + k, 51 + 5 * k).split()) for k in range(3)]
    assert all(len(p) < 400 for p in short)
    data = texts()
    for i in range(40):
        data.append(f"{prose(i + 3000, rng.randrange(5, 80))} {short[i % 3]}\n{prose(i + 4000, rng.randrange(5, 80))}")
    only_here = " ".join(w[:5] for w in prose(2100, 60).split())
    data += [short[0], short[0], short[1].replace(" ", " \t"), f"{short[1]} x {short[1]} y {short[1]}", f"{only_here} x {only_here}", " ".join(short[0].split()[:50]), " ".join(short[2].split()[1:50])]
    data += ["and " * 300, "and " * 70 + "or", prose(5000, 49), prose(5000, 49), prose(5001, 50), prose(5001, 50)]
    for i in range(30):
        data += [f"{prose(i + 6000, 20)} {f'same{i} ' * n}{prose(i + 7000 + n, 3)}" for n in (51, 52)]
    docs = documents(spark, data).repartition(5)
    got = {r["doc_id"]: [tuple(x) for x in r["passages"]] for r in substrings.repeated_substrings(docs).select("doc_id", "passages").collect()}
    want = brute_passages(data)
    assert [got[i] for i in range(len(data))] == want
    at = data.index(short[0])
    assert want[at] == [(0, len(short[0]))] and not want[data.index(f"{only_here} x {only_here}")]


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"abcdefgh   ", np.uint8), 60_000)
    off = np.array([0, len(data)])
    made = []
    for piece in (substrings._PIECE, 5_000):
        monkeypatch.setattr(substrings, "_PIECE", piece)
        _, anchor, _, lo, hi, _ = substrings._segments(data, off, 400)
        _, word_anchor, _, start, stop = substrings._word_segments(data, off)
        made.append(({(a, w) for a, x, y in zip(anchor, lo, hi, strict=True) for w in range(x, y + 1)}, set(word_anchor), min(start), max(stop)))
    assert made[0] == made[1]
