"""Text quality by kernel ridge regression on random Fourier features.

Document statistics (ratios and logarithms, no label, language, source or id)
are standardised and lifted by cosines of random projections, which
approximate a Gaussian kernel. Tasks sum the normal equations over their
labelled rows; the driver solves one system of fixed size. Isotonic regression
over a histogram of held-back training scores turns the ridge output into
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import sums as sums_of
from skyloom.llm.textops import STATS, doc_stats, slices

FEATURES = 256
GAMMA = 0.04
RIDGE = 1e-3
CELLS = 1000


@dataclass
class Model:
    """mean and scale of the statistics, the projection, ridge weights, and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray


def describe(batch: pa.RecordBatch) -> np.ndarray:
    """Statistics of each row of ``doc_stats`` columns, as floats. Empty texts give finite values."""
    v = {x: batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(float) for x in STATS}
    w, c, lines = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1), np.maximum(v["n_lines"], 1)
    return np.stack(
        [np.log1p(v["n_words"]), np.log1p(v["word_chars"] / w), np.log1p(w / lines), v["n_symbols"] / c, np.log1p(v["n_symbols"] / w), v["n_exclaim"] / w, v["n_upper"] / np.maximum(v["n_letters"], 1), v["n_digits"] / c, v["n_stops"] / w, v["n_wide"] / c, v["n_distinct"] / w, v["n_same"] / w, v["n_repeat_words"] / w, v["n_dup_lines"] / lines],
        axis=1,
    )


def _lift(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    return np.hstack([np.cos(z @ m.project + m.phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _map_sums(rows: DataFrame, sum_rows) -> dict[str, np.ndarray]:
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                y = b.column(b.schema.get_field_index("_quality")).to_numpy(zero_copy_only=False).astype(float)
                for k, v in sum_rows(describe(b), y).items():
                    total[k] = total.get(k, 0) + v
        yield sums_of.batch(total)

    return sums_of.add_up(rows.mapInArrow(run, sums_of.SCHEMA))


def pool_adjacent(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing rates closest to good/total by weight; cells without rows take their block's rate."""
    blocks: list[list[float]] = []
    for g, n in zip(good, total, strict=True):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), (g + 0.5) / (n + 1)) for g, n, k in blocks])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", seed: int = 11) -> Model | None:
    """Learn from rows of ``statistics`` whose id has a label 0 or 1; the caller leaves out what is held out.

    A quarter of them (by a hash of the id) calibrates, the rest fits. Labels
    for one id that repeat count as often. None if no label joins a row.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col(id_col).alias("_id"), F.col("quality").alias("_quality"))
    rows = stats.select(F.col(id_col).alias("_doc"), *STATS).join(known, F.col("_doc") == F.col("_id")).withColumn("_part", F.pmod(F.xxhash64("_doc"), F.lit(4)))
    moments = _map_sums(rows, lambda x, y: {"n": np.array([float(len(x))]), "s": x.sum(0), "q": (x * x).sum(0)})
    if not moments:
        return None
    n = moments["n"][0]
    mean = moments["s"] / n
    scale = np.sqrt(np.maximum(moments["q"] / n - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    m = Model(mean, scale, rng.normal(size=(len(mean), FEATURES)) * np.sqrt(2 * GAMMA), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(x, y):
        z = _lift(x, m)
        gram = z.T @ z
        return {"y": z.T @ y, "n": np.array([float(len(x))])} | {f"g{i}": gram[i] for i in range(FEATURES + 1)}

    half = _map_sums(rows.filter(F.col("_part") != 0), normal)
    if not half:
        return None
    gram = np.stack([half[f"g{i}"] for i in range(FEATURES + 1)])
    m.weights = np.linalg.solve(gram + RIDGE * half["n"][0] / FEATURES * np.eye(FEATURES + 1), half["y"])

    def histogram(x, y):
        cell = np.clip(((_lift(x, m) @ m.weights + 0.5) / 2 * CELLS).astype(int), 0, CELLS - 1)
        return {"good": np.bincount(cell, weights=y, minlength=CELLS), "all": np.bincount(cell, minlength=CELLS).astype(float)}

    held = _map_sums(rows.filter(F.col("_part") == 0), histogram) or _map_sums(rows, histogram)
    m.curve_x = (np.arange(CELLS) + 0.5) / CELLS * 2 - 0.5
    m.curve_y = pool_adjacent(held["good"], held["all"])
    return m


def score(stats: DataFrame, model: Model | None, threshold: float = 0.7, keep: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, kept columns, ``score`` in [0, 1] and ``predicted`` (1 from the threshold up).

    Empty and null texts are scored from their (zero) statistics. Without a
    model every score is 0.5. Repeated rows get equal scores. Within a flat
    step of the calibration the ridge output orders, by at most 0.001.
    """
    names = [id_col, *(keep or [])]
    fields = [stats.schema[x] for x in names]

    def run(batches):
        for b in batches:
            if model is None or not b.num_rows:
                p = np.full(b.num_rows, 0.5)
            else:
                raw = _lift(describe(b), model) @ model.weights
                p = 0.999 * np.interp(raw, model.curve_x, model.curve_y) + 0.001 * np.clip(raw, 0, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    return stats.select(*names, *STATS).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, whose score reaches the threshold; texts pass through the tasks once."""

    def run(batches):
        for rows, data, off in slices(batches, text_col):
            stats = doc_stats(data, off)
            raw = _lift(describe(pa.RecordBatch.from_arrays([pa.array(stats[:, i]) for i in range(len(STATS))], list(STATS))), model) @ model.weights
            p = 0.999 * np.interp(raw, model.curve_x, model.curve_y) + 0.001 * np.clip(raw, 0, 1)
            yield rows.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
