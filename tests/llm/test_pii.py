import hashlib
import re
import time

from pyspark.sql import functions as F

from skyloom.llm import pii

from .samples import ODD, documents, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*(sum(f[0] == k for f in found) for k in PATTERNS), hashlib.sha256(line.encode()).hexdigest()), line


HARD = [
    "a@b.c.d@e.f a@b.cd_x@e.f a@b@c.d é😀 x.y%z+1-2@a-b.c-d. mail me@x",
    "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3 999999999999999999999.1.1.1 1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 0000000000000 1-2-3 12345678901234567890",
    "+1 (555) 123-4567 +49 30 1234567 +1 2 +123456789012345678 ++1 234 567 890) +1((((((2 +5 555555555.",
    "\x01a@b.c\x02 \x01+1 (555) 123-4567\x02 \x03",
    "a.b.c." * 3000 + "@x.y",
    "1." * 5000 + "1 " + "7 " * 3000,
    "x@" + "a." * 4000 + "z " + "+1" + " " * 4000 + "2",
    "a@b.c " * 700,
]


def test_base_equals_brute_force(spark):
    texts = [*ODD, *HARD, prose(1, 2000) + " call +1 (784) 555-8120, token = \"3f76bb46f51625a07193ae74d1cc485f188b9b5d\" end", "mail joe (at) example (dot) com now"]
    docs = documents(spark, texts).withColumn("proposed", pii.proposals(F.col("text"))).withColumn("spans", F.lit("clash"))
    model = pii.fit(docs)
    out = pii.digest(docs, model).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        want, line = brute(t)
        assert tuple(r[1:6]) == want, t
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    assert "secret:" in out[-2]["spans"]


def test_redaction_and_reliability(spark):
    texts = [f"{prose(i, 20)} write to user{i}@mail.example.com or token = \"{i:08x}f51625a07193ae74d1cc485f188b9b5d\" {prose(i + 99, 9)}" for i in range(40)] + [None, "clean text"]
    docs = documents(spark, texts)
    model = pii.fit(docs.select(pii.proposals(F.col("text")).alias("proposed")))
    out = pii.find(docs, model).withColumn("text", pii.redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    for i, r in enumerate(out[:40]):
        assert r["text"] == f"{prose(i, 20)} write to <email> or token = \"<secret>\" {prose(i + 99, 9)}"
    assert [r["text"] for r in out[40:]] == [None, "clean text"]
    assert model.reliability[1, 0, 2] > model.reliability[0, 0, 2]


def test_long_secrets_are_found_whole(spark):
    key = lambda n, i=0: "".join("aZ3_b9-Q"[(k * k + k // 7 + i) % 8] for k in range(n - 1)) + "7"
    alone = [key(20), key(128), key(129), key(300), key(20000), "x" * 150 + "1", "1" * 150 + "x", "-" * 150 + "a1", key(19)[:19], "x" * 300, "_1" * 3 + "-" * 300, "é" + key(129) + "é"]
    docs = documents(spark, [f"key = {t} end" for t in alone]).select("doc_id", F.filter(pii.proposals(F.col("text")), lambda s: s["kind"] == 4).alias("s"))
    got = [[(s["start"], s["end"]) for s in r["s"]] for r in docs.orderBy("doc_id").collect()]
    want = [[(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9_-]{20,}", f"key = {t} end") if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())] for t in alone]
    assert got == want and [bool(w) for w in want] == [True] * 8 + [False] * 3 + [True]

    signature = lambda i: (hashlib.sha512(str(i).encode()).hexdigest() * 20)[: (40, 129, 300, 2000)[i % 4]]
    texts = [f"{prose(i, 20)} write to user{i}@mail.example.com or token = \"{signature(i)}\" {prose(i + 99, 9)}" for i in range(40)]
    docs = documents(spark, texts)
    model = pii.fit(docs.select(pii.proposals(F.col("text")).alias("proposed")))
    out = pii.find(docs, model).withColumn("text", pii.redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [f"{prose(i, 20)} write to <email> or token = \"<secret>\" {prose(i + 99, 9)}" for i in range(40)]


def test_a_megabyte_of_matches_ends_soon(spark):
    """Time follows the length of a text, also where all of it is matches, base and added, and it is redacted."""
    text = "".join(f"a{i}@b.cd, é{i % 250}.1.2.3 jo{i} (at) ex.com; " for i in range(20000))
    docs = documents(spark, [text, "x " + text[:3000]])
    began = time.time()
    proposed = docs.withColumn("proposed", pii.proposals(F.col("text")))
    model = pii.fit(proposed)
    r = pii.digest(proposed, model).orderBy("doc_id").first()
    assert len(text) > 800_000 and tuple(r[1:6]) == brute(text)[0] and r["n_email"] == 20000 and r["n_ip"] == 20000
    found = pii.find(docs, model).withColumn("text", pii.redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").first()
    assert found["text"].startswith("<email>, é<ip> ") and found["text"].count("<email>") >= 20000 and "@" not in found["text"]
    assert time.time() - began < 120


def test_redaction_of_overlapping_spans_and_wide_characters(spark):
    text = "é😀 call +1 (555) 123-4567 or 4111 1111 1111 1111 at 1.2.3.4, ü@x me@é.fr a@b.cd"
    spans = [(3, 9, 26), (2, 30, 49), (1, 53, 60), (0, 14, 40)]
    rows = [(k, a, b, len(text[:a].encode()), len(text[:b].encode())) for k, a, b in spans]
    df = spark.createDataFrame([(text, rows), (text, []), (None, [])], "text string, spans array<struct<kind:int,start:int,end:int,b0:int,b1:int>>")
    out = [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("spans"))).collect()]
    assert out == [text[:9] + "<phone>" + text[49:53] + "<ip>" + text[60:], text, None]


def test_running_totals_over_blocks(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        df = spark.range(1).select(F.array(*(F.lit(i % 7) for i in range(n))).cast("array<bigint>").alias("v"))
        got = df.select(pii.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.lit(-1), F.greatest).alias("m")).first()
        values = [i % 7 for i in range(n)]
        assert got["s"] == [sum(values[:i]) for i in range(n)] and got["m"] == [max(values[:i], default=-1) for i in range(n)]


def test_empty(spark):
    docs = documents(spark, []).withColumn("proposed", pii.proposals(F.col("text")))
    assert pii.digest(docs, pii.fit(docs)).count() == 0
