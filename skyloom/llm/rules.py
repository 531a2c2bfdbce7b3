"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when a ratio of its text exceeds a cutoff. All
rules of a stratum (size class) tighten together, along one path of joint rule
sets from lenient to strict. Labelled documents are split in two by a hash of
their id. One half shapes the path: at each level a rule's cutoff lets through
all but a small share of good documents, and a rule takes part only where it
catches bad ones more often. The other half decides how far to go: level by
level, the exact binomial (Clopper-Pearson) upper bound of the share of good
documents that the joint set rejects must stay within ``alpha``; testing stops
at the first that fails. A fixed sequence needs no correction within a path, so
all levels up to there hold, and the one is taken that rejects the largest share
of bad documents above that of good ones, on the half that shaped the path.
Over strata, the error probability is split evenly, and a stratum whose path is
certified to its end passes its part on to the others (Holm). So, with
probability 1 - ``delta``, no stratum loses more than ``alpha`` of its good
documents to the rules. Strata with too few good labels to certify anything are
pooled with a neighbour, and hold to the guarantee together.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.bounds import upper_bound
from skyloom.llm.textops import STATS, doc_stats, slices

#: Size classes: words below these.
STRATA = (50, 200, 1000)
#: A ratio in [0, 1] of each document, named.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "exclaims": ("n_exclaim", "n_words"),
    "upper": ("n_upper", "n_letters"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "same": ("n_same", "n_words"),
}
BINS = 200
#: Share of good documents that a rule's cutoff lets go, level by level, on the half of the labels that shapes the path.
LEVELS = (0.0, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_stats`` of each row, beside the id and the columns in ``keep``."""
    fields = [f for f in docs.schema.fields if f.name in {id_col, *(keep or [])}]
    names = [f.name for f in fields]
    picked = docs.select(*names, F.col(text_col).alias("_text"))

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            stats = doc_stats(data, off)
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(x)) for x in names), *(pa.array(stats[:, i]) for i in range(len(STATS)))], [*names, *STATS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{x} long" for x in STATS)])
    return picked.mapInArrow(run, schema)


def stratum(n_words: Column) -> Column:
    out = F.lit(0)
    for i, size in enumerate(STRATA):
        out = F.when(n_words >= size, i + 1).otherwise(out)
    return out


def bin_of(rule: str) -> Column:
    """The grid cell of a ratio, 0 for none; ratios above 1 count as 1."""
    top, base = RULES[rule]
    ratio = F.least(F.lit(1.0), F.col(top) / F.greatest(F.col(base), F.lit(1)))
    return F.ceil(ratio * BINS).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _pools(good: np.ndarray, alpha: float, delta: float) -> list[list[int]]:
    """Strata in neighbouring pools, each with enough good labels that a level which loses none can be certified."""
    pools = [[s] for s in range(len(good))]
    while len(pools) > 1:
        size = [int(good[p].sum()) for p in pools]
        least = int(np.argmin(size))
        if size[least] >= math.log(delta / len(pools)) / math.log1p(-alpha):
            break
        at = min((k for k in (least - 1, least + 1) if 0 <= k < len(pools)), key=lambda k: size[k])
        low, high = min(least, at), max(least, at)
        pools[low : high + 1] = [pools[low] + pools[high]]
    return pools


def _path(counts: np.ndarray) -> np.ndarray:
    """[level, rule] cutoffs (bins), never rising from level to level, from counts [rule, bin, label]; BINS where a rule takes no part."""
    above = counts[:, ::-1].cumsum(1)[:, ::-1]
    above = np.concatenate([above[:, 1:], np.zeros_like(above[:, :1])], axis=1)
    good, bad = (above[..., y] / max(1, counts[0, :, y].sum()) for y in (1, 0))
    out = np.full((len(LEVELS), len(counts)), BINS)
    for j, share in enumerate(LEVELS):
        for k in range(len(counts)):
            b = int(np.argmax(good[k] <= share))
            if bad[k, b] > 0 and bad[k, b] >= 2 * good[k, b]:
                out[j, k] = b
    return np.minimum.accumulate(out, axis=0)


def certified(rejected: list[np.ndarray], totals: list[int], alpha: float, delta: float) -> list[int]:
    """Levels certified for each path, from the good documents that each level rejects and how many there are."""
    reached = [0] * len(totals)
    share = [delta / max(1, len(totals))] * len(totals)
    moved = True
    while moved:
        moved = False
        for i, lost in enumerate(rejected):
            while reached[i] < len(lost) and upper_bound(int(lost[reached[i]]), totals[i], share[i]) <= alpha:
                reached[i] += 1
            rest = [k for k in range(len(totals)) if reached[k] < len(rejected[k])]
            if reached[i] == len(lost) and share[i] and rest:
                for k in rest:
                    share[k] += share[i] / len(rest)
                share[i], moved = 0.0, True
    return reached


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id") -> dict[tuple[int, str], int]:
    """{(stratum, rule): bin}; documents in a higher bin are rejected. Rules that take no part are absent.

    Only counts reach the driver: per stratum, rule, bin and label at most
    4 * 6 * 201 * 2 rows, and per stratum, half, label and level 4 * 2 * 2 * 9. Labels other than 0
    and 1 are ignored.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col(id_col).alias("_id"), F.col("quality").alias("_quality"))
    rows = stats.filter(~base_failed()).join(known, F.col(id_col) == F.col("_id")).withColumn("s", stratum(F.col("n_words")))
    held = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(2)) == 1
    bins = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bin_of(r).alias("b")) for r in RULES))).alias("x")
    cells = rows.filter(~held).select("s", "_quality", bins).groupBy("s", "x.rule", "x.b", "_quality").count().collect()
    counts = np.zeros((len(STRATA) + 1, len(RULES), BINS + 1, 2), np.int64)
    for r in cells:
        counts[r["s"], list(RULES).index(r["rule"]), r["b"], r["_quality"]] += r["count"]
    good = np.zeros(len(STRATA) + 1, np.int64)
    test = rows.filter(held).filter("_quality = 1")
    for r in test.groupBy("s").count().collect():
        good[r["s"]] = r["count"]
    pools = _pools(good, alpha, delta)
    paths = [_path(counts[p].sum(0)) for p in pools]
    level = F.lit(len(LEVELS))
    for p, path in zip(pools, paths, strict=True):
        first = F.lit(len(LEVELS))
        for j in range(len(LEVELS) - 1, -1, -1):
            over = [bin_of(r) > int(path[j, k]) for k, r in enumerate(RULES) if path[j, k] < BINS]
            first = F.when(reduce(lambda a, b: a | b, over), j).otherwise(first) if over else first
        level = F.when(F.col("s").isin(*p), first).otherwise(level)
    seen = np.zeros((len(STRATA) + 1, 2, 2, len(LEVELS) + 1), np.int64)
    for r in rows.groupBy("s", held.cast("int").alias("held"), "_quality", level.alias("level")).count().collect():
        seen[r["s"], r["held"], r["_quality"], r["level"]] += r["count"]
    pooled = np.stack([seen[p].sum(0)[..., :-1].cumsum(-1) for p in pools])
    total = np.stack([np.maximum(1, seen[p].sum(0).sum(-1)) for p in pools])
    out = {}
    for i, n in enumerate(certified(list(pooled[:, 1, 1]), [int(good[p].sum()) for p in pools], alpha, delta)):
        gain = [0.0] + [pooled[i, 0, 0, j] / total[i, 0, 0] - pooled[i, 0, 1, j] / total[i, 0, 1] for j in range(n)]
        best = int(np.argmax(gain)) - 1
        if best >= 0:
            out |= {(s, r): int(paths[i][best, k]) for s in pools[i] for k, r in enumerate(RULES) if paths[i][best, k] < BINS}
    return out


def verdict(cutoffs: dict[tuple[int, str], int]) -> Column:
    """True where no rule of the document's stratum rejects it."""
    out = F.lit(True)
    for (s, rule), b in sorted(cutoffs.items()):
        out = out & ~((stratum(F.col("n_words")) == s) & (bin_of(rule) > b))
    return out


def quality_rules(stats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows of :func:`statistics`.

    Null or empty texts have no words and so fail the base rule. Repeated rows
    are judged alike; ids that several labels share count once for each. With
    empty labels no cutoff can be certified, and only the base rule rejects.
    """
    cutoffs = fit_cutoffs(stats, labels, alpha, delta, id_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(cutoffs))
