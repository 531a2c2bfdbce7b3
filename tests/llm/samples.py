"""Small inputs that every operator is tried on."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing near old stone walls and rivers flow past green hills".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("%d" % ((x >> 16) % 50) if x % 3 else ""))
    return " ".join(out)


ODD = [None, "", " ", "\n\n", "x", "one two", "a\tb\rc\x0bd", "é ü ñ", "漢字 かな", "a" * 5000, "same same same same same same same same same same same same", "line one here\nline one here\n\nother", "#$%& *** <<>>||", "tail\n", "\nhead"]


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)
