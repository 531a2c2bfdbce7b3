import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import langid

from .samples import ODD, documents

EN = "the house and the river with thousands of things that were there when this other weather came"
DE = "der schnelle und die strasse zwischen schwarzen dächern nicht ein einziges schönes mädchen über"
RU = "быстрая река течет мимо старого города и больших домов под тихим небом"


def training(spark):
    rng = random.Random(5)
    rows = []
    for i in range(90):
        lang, base = (("en", EN), ("de", DE), ("ru", RU))[i % 3]
        ws = base.split()
        rows.append((i, " ".join(rng.choice(ws) for _ in range(60)), lang, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "x", None, "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 6, 0, 3]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(bounds[-1], 3)).astype(np.float32)
    got = langid.viterbi(scores, bounds, 0.7)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        def value(path, a=a):
            return sum(scores[a + i, p] for i, p in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(got[a:b]) - best) < 1e-4


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = [0, 1, 2, 3, 50, 7, 400, 0, 90, 5]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(bounds[-1], 4)).astype(np.float32) * 2
    whole = langid.viterbi(scores, bounds, 1.5)
    monkeypatch.setattr(langid, "LONG", 5)
    cut = langid.viterbi(scores, bounds, 1.5)
    assert len(np.unique(whole)) == 4 and (whole == cut).all()


def test_a_text_of_a_million_words_ends_soon():
    scores = np.repeat(np.random.default_rng(1).normal(size=(1000, 3)), 1000, axis=0).astype(np.float32)
    began = time.time()
    got = langid.viterbi(scores, np.array([0, len(scores)]))
    assert time.time() - began < 30 and (got[500::1000] == scores[500::1000].argmax(1)).mean() > 0.99


def test_mixed_text_is_labelled_in_spans(spark):
    model = langid.fit(training(spark))
    assert model.languages == ["de", "en", "ru"]
    mixed = f"{EN}. {DE}. {RU}"
    out = langid.identify(documents(spark, [mixed, EN, DE, RU, *ODD]), model).orderBy("doc_id").collect()
    raw = mixed.encode()
    spans = [(s["lang"], raw[s["start"] : s["end"]].decode()) for s in out[0]["spans"]]
    assert [s[0] for s in spans] == ["en", "de", "ru"]
    assert [s[1].split()[0] for s in spans] == ["the", "der", "быстрая"]
    assert [r["lang_pred"] for r in out[1:4]] == ["en", "de", "ru"]
    for r, text in zip(out[4:], ODD, strict=True):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")), text
        assert 0 <= r["score"] <= 1


def test_no_training_rows(spark):
    model = langid.fit(training(spark).filter(F.lit(False)))
    assert [r["lang_pred"] for r in langid.identify(documents(spark, [EN, None]), model).collect()] == ["und", "und"]
    assert langid.identify(documents(spark, []), model).count() == 0


def test_rare_language_is_found(spark):
    """One word in ten thousand is of the third language, in the script of the first."""
    fi = "hyvää huomenta kaikille ystäville jotka asuvat pienessä kylässä järven rannalla talvella"
    common = spark.range(240).select("id", F.lit(f"{EN} " * 300).alias("text"), F.lit("en").alias("lang"))
    other = spark.createDataFrame([(900, f"{fi} " * 11, "fi"), (901, RU, "ru")], "id long, text string, lang string")
    model = langid.fit(common.union(other))
    n = {"en": 240 * 300 * len(EN.split()), "fi": 11 * len(fi.split())}
    assert n["fi"] / n["en"] <= 1.0e-4
    got = langid.identify(documents(spark, [fi, EN, RU]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["fi", "en", "ru"]


def test_more_than_256_languages():
    want = np.array([0, 299, 299, 256, 7])
    scores = np.where(np.arange(300) == want[:, None], 9.0, 0.0)
    assert langid.viterbi(scores, np.array([0, 3, 5]), 0.5).tolist() == want.tolist()


def grams(word):
    padded = b" " + word.lower() + b" "
    codes = [(padded[i] << 16) | (padded[i + 1] << 8) | padded[i + 2] for i in range(len(word))]
    return [(c * 2654435761 % (1 << 32)) >> (32 - langid.BITS) for c in codes]


def plain(train, texts):
    """Language and share of letters per text, word by word in Python."""
    counts, scripts = {}, {}
    words = lambda t: re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").encode())
    script = lambda w: max(langid._SCRIPT[b] for b in w)
    for text, lang in train:
        for w in words(text):
            counts.setdefault(lang, Counter()).update(grams(w))
            scripts.setdefault(lang, set()).add(script(w))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.1 * langid.CELLS for x in langs}
    out = []
    for t in texts:
        best, back = None, []
        for w in words(t):
            allowed = {x for x in langs if script(w) in scripts[x]} or set(langs)
            mark = {x: sum(math.log((counts[x][g] + 0.1) / total[x]) for g in grams(w)) - 1e4 * (x not in allowed) for x in langs}
            if best is None:
                best, came = mark, {x: x for x in langs}
            else:
                came = {x: max(langs, key=lambda y: (best[y] - langid.SWITCH * (y != x), y == x)) for x in langs}
                best = {x: best[came[x]] - langid.SWITCH * (came[x] != x) + mark[x] for x in langs}
            back.append(came)
        letters = Counter()
        if back and any(c.isalpha() for c in t):
            x = max(langs, key=lambda y: best[y])
            for w, came in zip(reversed(words(t)), reversed(back), strict=True):
                letters[x] += len(w.decode())
                x = came[x]
            top = max(langs, key=lambda y: (letters[y], -langs.index(y)))
            out.append((top, letters[top] / sum(letters.values())))
        else:
            out.append(("und", 0.0))
    return out


def test_equals_word_by_word_computation(spark):
    docs = training(spark)
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(60):
        texts.append(". ".join(" ".join(rng.choices(x.split(), k=rng.randrange(1, 9))) for x in rng.choices((EN, DE, RU), k=rng.randrange(1, 5))))
    want = plain([(r["text"], r["lang"]) for r in docs.collect() if r["lang"]], texts)
    got = langid.identify(documents(spark, texts), langid.fit(docs), spans=False).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [x for x, _ in want]
    assert all(abs(r["score"] - s) < 1e-9 for r, (_, s) in zip(got, want, strict=True))


def test_letters_are_characters(spark):
    """More letters of English than of Russian, in fewer bytes."""
    en, ru = "the quick brown fox jumps over the lazy dog today", "быстрая коричневая лиса прыгает через"
    count = lambda t: sum(c.isalpha() for c in t)
    assert count(en) > count(ru) and len(en.encode()) < len(ru.encode())
    row = langid.identify(documents(spark, [f"{en}. {ru}"]), langid.fit(training(spark))).first()
    assert row["lang_pred"] == "en" and abs(row["score"] - count(en) / (count(en) + count(ru))) < 1e-9


def test_clashing_columns_and_repeats(spark):
    docs = documents(spark, [EN, RU, None]).withColumns({c: F.lit("clash") for c in ("_text", "_lang", "lang_pred", "score", "spans")})
    model = langid.fit(training(spark).withColumn("_text", F.lit(1)))
    out = langid.identify(docs.union(docs), model, keep=["source"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["lang_pred"], r["source"]) for r in out] == [(0, "en", "src0")] * 2 + [(1, "ru", "src0")] * 2 + [(2, "und", "src0")] * 2
