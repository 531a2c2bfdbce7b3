import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import neardup, pieces, rules
from skyloom.llm.textops import PLAIN_WORD, eights, grams_hash, same_bytes, spans_hash, words

from .samples import documents
from .test_rules import brute


def thue_morse(n, a, b):
    """A string and its complement, on which polynomial hashes modulo a power of two agree."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in ones), "".join(b if x else a for x in ones)


@pytest.mark.parametrize("n", [16, 64, 1024, 1 << 15])
def test_arranged_words_differ(n):
    a, b = thue_morse(n, "a", "b")
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), PLAIN_WORD)
    x, y, z = spans_hash(eights(data, True), start, end)
    assert x != y and x == z
    assert same_bytes(eights(data, True), start, start[[2, 0, 0]], end - start).tolist() == [True, False, True]


def test_equal_spans_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 31, 63, 64, 65, 300):
        span = rng.integers(97, 123, n, dtype=np.uint8)
        data = np.concatenate([span, [32], span, [32, 33], span]).astype(np.uint8)
        start = np.array([0, n + 1, 2 * n + 3])
        assert len(set(spans_hash(eights(data, False), start, start + n).tolist())) == 1
    texts = [bytes(rng.integers(97, 99, rng.integers(1, 20), dtype=np.uint8)) for _ in range(5000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert len(set(spans_hash(eights(data, False), off[:-1], off[1:]).tolist())) == len(set(texts))


def test_operators_tell_arranged_texts_apart(spark):
    a, b = thue_morse(1024, "a", "b")
    docs = documents(spark, [f"x {a}", f"x {b}"])
    assert [r["component_id"] for r in neardup.near_duplicates(docs, shingle=2).orderBy("doc_id").collect()] == [0, 1]
    encoded = pieces.round_trip(docs).collect()
    assert all(r["round_trip"] for r in encoded) and len({r["ids_sha256"] for r in encoded}) == 2
    text = f"{a} one two three four {b} one two three four {a}"
    row = rules.statistics(documents(spark, [text])).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").first()
    assert tuple(row) == brute(text)
    assert docs.filter(F.lit(False)).count() == 0


@pytest.mark.parametrize("n", [0, 31, 32, 33, 1000])
def test_grams_hash_equals_spans_hash(n):
    text = eights(np.random.default_rng(n).integers(0, 256, n).astype(np.uint8), False)
    at = np.arange(max(n - 31, 0))
    assert (grams_hash(text, 32, some=100) == spans_hash(text, at, at + 32)).all()
