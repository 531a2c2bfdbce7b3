import math
import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import rules
from skyloom.llm.bounds import binomial_tail, upper_bound

from .samples import ODD, documents, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_equal_brute_force(spark):
    texts = [*ODD, prose(1, 3000), prose(2, 40) + "\n" + prose(3, 9) + "\n" + prose(2, 40) + "\n" + prose(3, 9), "Ünï cödé " * 30]
    got = {r["doc_id"]: tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rules.statistics(documents(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bounds():
    assert abs(upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert abs(binomial_tail(1, 2, 0.5) - 0.75) < 1e-12
    assert upper_bound(5, 5, 0.05) == 1.0 == upper_bound(0, 0, 0.05)


def test_bounds_of_large_counts_end_soon():
    began = time.time()
    top = upper_bound(100_000, 10_000_000, 0.05)
    assert 0.01 < top < 0.0101 and time.time() - began < 1
    for k, n, p in ((3, 10, 0.5), (5, 200, 0.02), (50, 100, 0.6), (9, 10, 0.3), (0, 10, 0.1)):
        assert abs(binomial_tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-10


def test_paths_are_nested_and_skip_rules_that_catch_no_bad():
    counts = np.zeros((len(rules.RULES), rules.BINS + 1, 2), np.int64)
    counts[:, 0] = (50, 1000)
    counts[0, 0, 0], counts[0, 100, 0], counts[0, 60, 1] = 30, 20, 5
    path = rules._path(counts)
    assert (np.diff(path, axis=0) <= 0).all() and (path[:, 1:] == rules.BINS).all()
    assert path[0, 0] == 60 and path[-1, 0] == 0


def test_certified_levels_pass_their_part_on():
    lost, n = np.array([0, 1, 2]), 400
    alone = rules.certified([np.array([0, 30])], [n], 0.02, 0.05)
    assert alone == [1]
    late = np.array([3, 3, 3])
    assert upper_bound(3, n, 0.05) <= 0.02 < upper_bound(3, n, 0.025)
    assert rules.certified([lost[:2], late], [n, n], 0.02, 0.05) == [2, 3]
    assert rules.certified([np.array([40]), late], [n, n], 0.02, 0.05) == [0, 0]


def test_risk_holds_over_resamples():
    """Of many label samples, few certify a level that loses too many good documents in truth."""
    rng = np.random.default_rng(9)
    truth = np.array([0.002, 0.01, 0.019, 0.021, 0.03])
    wrong = 0
    for _ in range(2000):
        first = np.searchsorted(truth, rng.random(600), "right")
        rejected = np.array([(first <= j).sum() for j in range(len(truth))])
        wrong += rules.certified([rejected], [600], 0.02, 0.05)[0] > 3
    assert wrong <= 0.06 * 2000


def test_small_strata_are_pooled():
    assert rules._pools(np.array([1000, 1000, 1000, 1000]), 0.02, 0.05) == [[0], [1], [2], [3]]
    assert rules._pools(np.array([5, 1000, 10, 1000]), 0.02, 0.05) == [[0, 1], [2, 3]]
    assert rules._pools(np.array([0, 0, 0, 0]), 0.02, 0.05) == [[0, 1, 2, 3]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_cutoffs_exist_on_the_given_tables(spark):
    """The method decides: at the given labels some rules get cutoffs, and few labelled good documents are lost."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).cache()
    assert rules.fit_cutoffs(stats, labels)
    out = rules.quality_rules(stats, labels).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("share"))
    share = {r["quality"]: r["share"] for r in out.collect()}
    stats.unpersist()
    assert share[1] <= 0.02 and share[0] > share[1]


def test_clashing_columns_and_repeats(spark):
    docs = documents(spark, [prose(1, 50), None]).withColumns({c: F.lit("clash") for c in ("n_words", "kept", "s", "_id", "quality")})
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    out = rules.quality_rules(rules.statistics(docs.union(docs)), labels).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], r["kept"]) for r in out] == [(0, 50, True)] * 2 + [(1, 0, False)] * 2


def test_cutoffs_reject_bad_and_keep_good(spark):
    good = [prose(i, 30) for i in range(3000)]
    bad = [prose(i, 30).replace(" ", "## ") for i in range(300)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = rules.quality_rules(rules.statistics(docs), labels).select("doc_id", "kept", "base_failed").collect()
    assert all(not r["kept"] for r in out if r["doc_id"] >= 3000)
    assert sum(not r["kept"] and not r["base_failed"] for r in out if r["doc_id"] < 3000) <= 0.02 * 3000


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.quality_rules(rules.statistics(docs), labels).count() == 0
    out = rules.quality_rules(rules.statistics(documents(spark, [None, prose(1, 50)])), labels).orderBy("doc_id").collect()
    assert [r["kept"] for r in out] == [False, True]
