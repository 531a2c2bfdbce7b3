"""Adding up fixed-size vectors that tasks have summed over their rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "key string, sums array<double>"


def batch(vectors: dict[str, np.ndarray]) -> pa.RecordBatch:
    keys = sorted(vectors)
    values = [pa.array([vectors[k] for k in keys], pa.list_(pa.float64()))] if keys else [pa.array([], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *values], ["key", "sums"])


def add_up(parts: DataFrame) -> dict[str, np.ndarray]:
    """Total vector per key, of columns as in SCHEMA.

    The parts of a key are added in one task per key, one vector held at a
    time; the driver gets one vector a key. The number of keys and the length
    of the vectors are the caller's constants, whatever the corpus.
    """

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for key, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[key] = total.get(key, 0) + sums.values.to_numpy()
        yield batch(total)

    return {r["key"]: np.array(r["sums"]) for r in parts.repartition("key").mapInArrow(add, SCHEMA).collect()}
