"""Personal data in texts, in DataFrame functions only.

Patterns propose spans. Labelers vote on each (+1, -1 or 0): a strict rule, a
gazetteer, cue words before the span, its shape, and what borders on it.
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and each pattern's probability of being personal data; a
logistic span classifier is trained on these. Vote patterns are few (at most
5 * 3**5 * 3), so their counts are all that reaches the driver.

Spans that the base rules find always stay; the classifier adds others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds in results. "secret" is found by the method only.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns. What stands before a match makes a search start at the head of a run only; possessive
#: repetition never gives characters back. Neither changes which matches are found; both keep the time linear.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What the method proposes beside them. A secret is a whole run of 20 or more with a digit and a letter, however long.
MORE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{2,64}} ?(?:\(at\)|\[at\]) ?{_LABEL}{{2,63}}(?: ?(?:\(dot\)|\[dot\]|\.) ?{_LABEL}{{2,63}}){{1,6}}",
    "phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
}
#: A text without this has no match.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
#: Top-level domains, card prefixes and cue words of the gazetteer and context labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|us|ca"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
CUES = {"email": "mail|contact|write|address", "ip": r"ip|host|server|address|client", "card": "card|visa|mastercard|credit|payment", "phone": "phone|tel|call|fax|mobile|contact", "secret": "token|key|secret|passw(or)?d|api|auth|credential"}
LABELERS = ("strict", "gazetteer", "context", "shape", "border")
REACH = 48
#: Every match of any pattern has one of these, so a text without needs one scan only.
ANY = r"[0-9@]|[(\[]at"
OPEN, CLOSE, PLAIN = "\x01", "\x02", "\x03"
#: Elements that are taken together in a running total.
BLOCK = 256
SPAN = "array<struct<kind:int,start:int,end:int,b0:int,b1:int,base:boolean,votes:array<int>,size:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, the combination of all before it; ``zero`` changes nothing that it is combined with.

    Made in blocks and then over blocks: growing an array by one copies it, so
    one pass would take the square of the length.
    """
    kind = "struct<at:bigint,out:array<bigint>>"
    start = F.struct(zero.alias("at"), F.array().alias("out")).cast(kind)

    def step(acc: Column, value: Column) -> Column:
        return F.struct(combine(acc["at"], value).cast("bigint").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start, step))
        before = lambda x: F.aggregate(F.transform(x, lambda y: y["at"]), start, step)["out"]
        shifted = lambda x: F.flatten(F.zip_with(x, before(x), lambda y, shift: F.transform(y["out"], lambda z: combine(shift, z))))
        return F.when(F.size(v) > 0, let(blocks, shifted)).otherwise(F.array().cast("array<bigint>"))

    return let(values, of)


def _found(text: Column, pattern: str, kind: str, own: bool, entry: Callable[[Column], Column]) -> Column:
    """``entry`` of each match of a pattern, leftmost and non-overlapping: start, end, the same in bytes, text, what is before and after."""
    hint = HINT[kind] if own else None
    possible = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]" if kind != "email" else r"[(\[]at")
    pieces = F.when(possible, F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)).otherwise(F.array(F.lit("")))
    total = lambda p, size: running(F.transform(p, lambda x: (size(x) - 1).cast("bigint")), F.lit(0), lambda x, y: x + y)

    def one(p: Column, at: Column, byte: Column, i: Column) -> Column:
        hit, rest = F.substring_index(p[i], CLOSE, 1), F.substring_index(p[i], CLOSE, -1)
        plain = lambda x: F.translate(x, CLOSE, "")
        before = F.right(F.concat(F.when(i > 1, plain(p[i - 2])).otherwise(F.lit("")), plain(p[i - 1])), F.lit(REACH))
        spot = F.struct((at[i] + 1).alias("start"), (byte[i] + 1).alias("b0"), hit.alias("text"), before.alias("before"), F.substring(rest, 1, 1).alias("after"))
        return let(spot, lambda x: entry(F.struct(x["start"], (x["start"] + F.length(x["text"])).alias("end"), x["b0"], (x["b0"] + F.octet_length(x["text"])).alias("b1"), x["text"], x["before"], x["after"])))

    def of(p: Column) -> Column:
        spans = let(total(p, F.length), lambda at: let(total(p, F.octet_length), lambda byte: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: one(p, at, byte, i))))
        return F.when(F.size(p) > 1, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return let(pieces, of)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda i: F.substring(digits, F.length(digits) - i, 1).cast("int")
    part = lambda i: F.when(i % 2 == 0, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _strict(kind: str, text: Column) -> Column:
    digits = _digits(text)
    byte = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    if kind == "ip":
        return text.rlike(rf"^({byte}\.){{3}}{byte}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1).otherwise(0) if no is not None else out.otherwise(-1)).cast("int")


def _votes(kind: str, own: bool, x: Column) -> list[Column]:
    """One vote of each labeler on a match (own: of a base pattern)."""
    text, digits = x["text"], _digits(x["text"])
    strict = _vote(_strict(kind, text)) if own else F.lit(-1) if kind != "secret" else _vote(text.rlike("^([0-9a-f]{32,}|(AKIA|ghp_|sk-)[A-Za-z0-9_-]{16,})$"))
    gazetteer = {
        "email": _vote(text.rlike(rf"(?i)(\.|dot\)? ?|dot\] ?)({DOMAINS})$")),
        "ip": _vote(~text.rlike(r"^(0|10|127|255)\.")),
        "card": _vote(digits.rlike(ISSUERS)),
        "phone": _vote(digits.rlike("^[1-9]")),
        "secret": F.lit(0),
    }[kind]
    context = _vote(F.lower(x["before"]).rlike(rf"\b({CUES[kind]})\b[^a-z0-9]*$|\b({CUES[kind]})[^a-z]{{0,8}}$"), F.lit(False))
    shape = {
        "email": _vote(F.length(text) <= 80),
        "ip": _vote(~text.rlike(r"(^|\.)0[0-9]")),
        "card": _vote(F.length(digits).between(13, 19) & text.rlike("^([0-9]+|([0-9]{4}[ -]){3}[0-9]{1,7})$")),
        "phone": _vote(F.length(digits).between(9, 13)),
        "secret": _vote((F.length(digits) >= 4) & (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= 4) & ~text.rlike("[a-z]{9,}")),
    }[kind]
    border = _vote(~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z0-9]"))
    return [strict, gazetteer, context, shape, border]


def _entry(kind: str, own: bool):
    def entry(x: Column) -> Column:
        length = x["end"] - x["start"]
        size = F.when(length < 12, 0).when(length < 24, 1).otherwise(2)
        votes = _votes(kind, own, x)
        base = votes[0] == 1 if own else F.lit(False)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["b0"].alias("b0"), x["b1"].alias("b1"), base.alias("base"), F.array(*votes).alias("votes"), size.alias("size"))

    return entry


def proposals(text: Column) -> Column:
    """All proposed spans of a text: kind, start and end in code points, the same in bytes, base or not, votes, size class."""
    text = F.coalesce(text, F.lit(""))
    clean = F.translate(text, OPEN + CLOSE, PLAIN + PLAIN)
    parts = [_found(clean, p, kind, own, _entry(kind, own)) for own, patterns in ((True, BASE), (False, MORE)) for kind, p in patterns.items()]
    return F.when(text.rlike(ANY), F.concat(*parts)).otherwise(F.array().cast(SPAN))


@dataclass
class Model:
    """Weights of the span classifier: bias, kinds, labelers, size classes; reliabilities from EM: P(vote | personal or not)."""

    weights: np.ndarray
    reliability: np.ndarray


def _features(kind: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(kind), 1)), np.eye(len(KINDS))[kind], votes, np.eye(3)[size]])


def fit(proposed: DataFrame, spans_col: str = "proposed", rounds: int = 50) -> Model:
    """Learn from rows of :func:`proposals`, without labels. No spans give a model that adds nothing."""
    s = F.explode(spans_col).alias("s")
    rows = proposed.select(s).groupBy("s.kind", "s.votes", "s.size", "s.base").count().collect()
    n_features = 1 + len(KINDS) + len(LABELERS) + 3
    if not rows:
        return Model(np.append(-20.0, np.zeros(n_features - 1)), np.full((2, len(LABELERS), 3), 1 / 3))
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["size"], r["base"]))
    kind, votes = np.array([r["kind"] for r in rows]), np.array([r["votes"] for r in rows])
    size, count, base = np.array([r["size"] for r in rows]), np.array([float(r["count"]) for r in rows]), np.array([r["base"] for r in rows])
    p = np.where(base, 0.9, 1 / (1 + np.exp(-votes.sum(1).astype(float))))  # a start only: every round estimates base spans like the others
    for _ in range(rounds):
        like = np.zeros((2, len(rows)))
        table = np.zeros((2, len(LABELERS), 3))
        for y, q in ((0, 1 - p), (1, p)):
            for k in range(len(LABELERS)):
                table[y, k] = np.bincount(votes[:, k] + 1, weights=q * count, minlength=3) + 1
            table[y] /= table[y].sum(1, keepdims=True)
            prior = np.bincount(kind, weights=q * count, minlength=len(KINDS)) + 1
            like[y] = np.log(prior[kind]) + sum(np.log(table[y, k, votes[:, k] + 1]) for k in range(len(LABELERS)))
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
    x, w = _features(kind, votes, size), np.zeros(n_features)
    weight = count / count.sum() * len(rows) * 10
    for _ in range(rounds):
        s_ = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (weight * s_ * (1 - s_))[:, None]).T @ x + 0.5 * np.eye(n_features)
        w = w + np.linalg.solve(hessian, x.T @ (weight * (p - s_)) - 0.5 * w)
    return Model(w, table)


def chance(model: Model, s: Column) -> Column:
    """The classifier's probability that a proposed span is personal data."""
    w = [float(x) for x in model.weights]
    k, v = 1 + len(KINDS), 1 + len(KINDS) + len(LABELERS)
    linear = F.lit(w[0]) + F.element_at(F.array(*map(F.lit, w[1:k])), s["kind"] + 1) + F.element_at(F.array(*map(F.lit, w[v:])), s["size"] + 1)
    for i in range(len(LABELERS)):
        linear = linear + s["votes"][i] * w[k + i]
    return 1 / (1 + F.exp(-linear))


def accepted(model: Model, proposed: Column, threshold: float = 0.9) -> Column:
    """Base spans, and those the classifier adds beside them, by kind and start; with places in bytes.

    An added span never overlaps a base span, nor another added span that begins before it (of two that begin together, the earlier kind comes first).
    """
    likely = F.filter(proposed, lambda s: s["base"] | (chance(model, s) >= threshold))
    ordered = F.array_sort(F.transform(likely, lambda s: F.struct(s["start"], s["kind"], s["end"], s["b0"], s["b1"], s["base"])))
    never, top = F.lit(-1).cast("bigint"), F.lit((1 << 31) - 1).cast("bigint")
    number = lambda c: c.cast("bigint")
    last_end = lambda v, base: running(F.transform(v, lambda x: F.when(x["base"] == base, number(x["end"])).otherwise(never)), never, F.greatest)
    next_start = lambda v: F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["base"], number(x["start"])).otherwise(top))), top, F.least))
    free = lambda v: let(last_end(v, F.lit(True)), lambda e: let(next_start(v), lambda n: F.filter(v, lambda x, i: x["base"] | ((e[i] <= x["start"]) & (n[i] >= x["end"])))))
    single = lambda v: let(last_end(v, F.lit(False)), lambda e: F.filter(v, lambda x, i: x["base"] | (e[i] <= x["start"])))
    kept = let(ordered, lambda v: let(free(v), single))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["b0"], s["b1"])))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """Adds ``spans`` (kind, start, end; kinds count from 0 in KINDS) to each row. Null and empty texts have none; repeated rows have equal spans."""
    proposed = docs.withColumn("_proposed", proposals(F.col(text_col)))  # a column of its own, so that it is made once
    return proposed.withColumn("spans", accepted(model, F.col("_proposed"), threshold)).drop("_proposed")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span of :func:`accepted` replaced by its kind in angle brackets; of overlapping spans, the one that starts first is shown."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["b0"], s["b1"], s["kind"])))
    ends = lambda v: running(F.transform(v, lambda s: s["b1"].cast("bigint")), F.lit(0), F.greatest)
    cut = lambda raw, a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")

    def shown(raw: Column, v: Column, e: Column) -> Column:
        parts = F.transform(v, lambda s, i: F.when(e[i] <= s["b0"], F.concat(cut(raw, e[i], s["b0"]), F.lit("<"), name(s["kind"]), F.lit(">"))).otherwise(F.lit("")))
        last = F.array_max(F.transform(v, lambda s: s["b1"]))
        return F.concat(F.array_join(parts, ""), cut(raw, last, F.octet_length(raw)))

    done = let(text.cast("binary"), lambda raw: let(ordered, lambda v: let(ends(v), lambda e: shown(raw, v, e))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(proposed: DataFrame, model: Model, id_col: str = "doc_id", spans_col: str = "proposed", threshold: float = 0.9) -> DataFrame:
    """Counts and texts of the spans per row; ``n_secret`` and ``n_added`` count what the classifier adds (secrets, all kinds)."""
    base = F.array_sort(F.transform(F.filter(spans_col, lambda s: s["base"]), lambda s: F.struct(s["kind"], s["start"], s["end"])))
    found = proposed.select(id_col, base.alias("_base"), accepted(model, F.col(spans_col), threshold).alias("_all"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    secrets = F.size(F.filter("_all", lambda s: s["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret")
    added = (F.size("_all") - F.size("_base")).cast("long").alias("n_added")
    return found.select(id_col, *(count(k) for k in KINDS[:4]), F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(F.col("_all")).alias("spans"), secrets, added)
