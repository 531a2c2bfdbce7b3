import hashlib

from pyspark.sql import functions as F

from skyloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, items string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|im_end|>", "<<|", "\n\n", "", "é漢😀<|", "a" * 3000, "ends with \\", "<\\n x"]


def test_round_trip_and_masks(spark):
    data = []
    for c in range(4):
        for t in range(40):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            data.append((c, t, role, NASTY[(c + t) % len(NASTY)] * (1 + t % 3)))
    data += [(9, 1, None, None), (9, None, "us\ner<|", "x"), (9, 1, "assistant", "twice"), (9, 1, "assistant", "twice"), (None, 0, "assistant", "no id")]
    windows = chat.format_windows(rows(spark, data), budget=256, reserve=64, history=2)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(windows)).collect()}
    for c in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in windows.collect():
        assert r["text"].count(chat.START) == r["text"].count(chat.END) == r["n_turns"]
        if r["conv_id"] == 1:
            assert r["text"].startswith(chat.START + "system\n")
        if r["window"]:
            assert 0 < r["n_repeated"] <= 3


def test_budget_holds_when_turns_are_short(spark):
    data = [(1, t, "user", "word " * 20) for t in range(100)]
    sizes = chat.format_windows(rows(spark, data), budget=512, reserve=128, history=2).select(F.floor(F.length("text") / 4).alias("n")).collect()
    assert len(sizes) > 10 and max(r["n"] for r in sizes) <= 512 + 100


def size(text):
    return (len(text.encode()) + 3) // 4 + 4


def blocks(window):
    """(role, tokens) of each turn in a window; texts without special signs."""
    parts = [b.removesuffix(chat.END + "\n").split("\n", 1) for b in window["text"].split(chat.START)[1:]]
    return [(role, size(text)) for role, text in parts]


def test_no_window_exceeds_the_budget(spark):
    data = [(c, t, ("user", "assistant")[t % 2], "x" * (4 * n - 16)) for c, n in ((1, 524), (2, 700), (3, 760), (4, 1100), (5, 2048)) for t in range(60)]
    data += [(6, t, ("user", "assistant")[t % 2], "y" * (t * 7919 % 4100)) for t in range(200)]
    for c, n in ((7, 300), (8, 1500), (9, 1537), (10, 2048)):
        data += [(c, 0, "system", "s" * (4 * n - 16))] + [(c, t, ("user", "assistant")[t % 2], "z" * (t * 7919 % 8176)) for t in range(1, 100)]
    windows = chat.format_windows(rows(spark, data)).collect()
    for w in windows:
        assert sum(n for _, n in blocks(w)) <= 2048, (w["conv_id"], w["window"])
    assert all(w["n_repeated"] for w in windows if w["conv_id"] == 1 and w["window"])  # beside two turns of 524 a third has room
    for c in (7, 8):
        mine = [w for w in windows if w["conv_id"] == c]
        for w in mine:
            fresh = sum(n for _, n in blocks(w)[w["n_repeated"] :])
            system = next(r[3] for r in data if r[0] == c)
            assert (blocks(w)[0][0] == "system") == (not w["window"] or fresh + size(system) <= 2048)
    for c in range(1, 11):
        mine = sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window"])
        assert [w["window"] for w in mine] == list(range(len(mine)))
        assert [b for w in mine for b in blocks(w)[w["n_repeated"] :]] == [(r[2], size(r[3])) for r in data if r[0] == c]


def test_turn_longer_than_the_budget_is_alone_and_whole(spark):
    data = [(1, t, ("system", "user", "assistant")[t and 1 + t % 2], "x" * (20000 if t in (5, 6, 20) else 400)) for t in range(30)]
    over = [w for w in chat.format_windows(rows(spark, data)).collect() if sum(n for _, n in blocks(w)) > 2048]
    assert len(over) == 3
    for w in over:
        assert w["n_turns"] - w["n_repeated"] == 1
        assert sum(n for _, n in blocks(w)[: w["n_repeated"]]) <= 512 and blocks(w)[0][0] == "system"


def test_empty(spark):
    out = chat.digests(chat.read_back(chat.format_windows(rows(spark, []))))
    assert out.count() == 0
