"""Centroid clustering on integer vectors: exact Lloyd rounds, most distances left out by geometric drift bounds.

Each vector carries a lower bound of its distance to every centroid but its
own. When centroids move, the vectors of a cluster lie in a sphere around its
old centroid. For another centroid that moved from p to q, how much nearer it
can have come to a point x of that sphere is a matter of the plane through p, q
and the sphere's centre: with m the middle of p and q, |x - p| - |x - q| is at
most |p - q| times the cosine of the angle at m between q and x (as
|x - p| + |x - q| >= 2 |x - m|), and over the sphere that angle is smallest
where a tangent from m touches it. So bounds are loosened by less than the full
drift, and not at all by centroids that moved away. Vectors whose own centroid
isn't surely the nearest are scanned against all centroids, in integers.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.scratch import written

#: Integer components are below this in size, so that squared distances of up to 2**13 components are exact.
LARGEST = 1 << 24
#: Vectors in one step of a scan.
STEP = 4096


class Centroids(NamedTuple):
    """Centroids now, where they were before, and the radius of each cluster around its place before."""

    now: np.ndarray
    before: np.ndarray
    radius: np.ndarray


def loosening(c: Centroids) -> np.ndarray:
    """For each cluster, by how much lower bounds of its vectors fall: the most that any other centroid came nearer to its sphere."""
    k = len(c.now)
    now, before = c.now.astype(float), c.before.astype(float)
    drift = np.sqrt(((now - before) ** 2).sum(1))
    out = np.zeros(k)
    for j in np.flatnonzero(drift > 0):
        along = (now[j] - before[j]) / drift[j]
        to = before - (now[j] + before[j]) / 2
        distance = np.sqrt((to**2).sum(1))
        cosine = np.clip((to @ along) / np.maximum(distance, 1e-300), -1, 1)
        inside = distance <= c.radius * (1 + 1e-9)
        tangent = np.arcsin(np.clip(c.radius / np.maximum(distance, 1e-300), 0, 1))
        nearest = np.maximum(0, np.arccos(cosine) - tangent)
        came = drift[j] * np.where(inside, 1.0, np.clip(np.cos(nearest) + 1e-7, 0, 1))
        came[j] = 0
        out = np.maximum(out, came)
    return out * (1 + 1e-9) + 1e-9 * (out > 0)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [vectors, centroids]."""
    if max(abs(x).max(initial=0), abs(c).max(initial=0)) * float(np.sqrt(x.shape[1])) < 1 << 24:
        a, b = x.astype(float), c.astype(float)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def _assign(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, c: Centroids, loose: np.ndarray):
    """Nearest centroid (ties: smaller number), squared distance to it, lower bound of all others, and how many vectors were scanned.

    A cluster of -1 is unknown; its vector is scanned.
    """
    known = cluster >= 0
    own = np.where(known, cluster, 0)
    squared = ((x - c.now[own]) ** 2).sum(1)
    lower = np.where(known, lower - loose[own], -1.0)
    upper = np.sqrt(squared.astype(float))
    doubt = np.flatnonzero(~(upper * (1 + 1e-9) + 1e-9 < lower))
    cluster = own.copy()
    for at in range(0, len(doubt), STEP):
        rows = doubt[at : at + STEP]
        d = _squared(x[rows], c.now)
        near = d.argmin(1)
        cluster[rows], squared[rows] = near, d[np.arange(len(rows)), near]
        d = d.astype(float)
        d[np.arange(len(rows)), near] = np.inf
        lower[rows] = np.sqrt(d.min(1)) * (1 - 1e-9)
    return cluster, squared, lower, len(doubt)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int, scale: int = 256) -> DataFrame:
    """(id, x) of the rows kept; x: floor(scale * component) of each, as integers."""
    v = F.col(vector_col)
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    kept = rows.filter((F.size(v) == size) & F.forall(v, fine))
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    in_range = F.forall(scaled, lambda c: F.abs(c) < LARGEST)
    checked = F.when(in_range, scaled).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<bigint>"))
    return kept.select(F.col(id_col), checked.cast("array<int>").alias("x"))


def start_order(id_col: str) -> Column:
    """Vectors in this order are the first centroids."""
    return F.sha2(F.concat(F.lit("2:"), F.col(id_col).cast("string")), 256)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), size).astype(np.int64)


def _assigned(vectors: DataFrame, c: Centroids, id_col: str, size: int) -> DataFrame:
    """The vectors (id, x, cluster, lower) with cluster, lower and squared distance as of the centroids in ``c``."""
    loose = loosening(c)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), size)
            cluster, squared, lower, n = _assign(x, b.column(2).to_numpy(), b.column(3).to_numpy(), c, loose)
            scanned = np.zeros(len(x), np.int64)
            scanned[:1] = n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(lower), pa.array(squared), pa.array(scanned)], [id_col, "x", "cluster", "lower", "squared", "scanned"])

    return vectors.select(id_col, "x", "cluster", "lower").mapInArrow(run, f"`{id_col}` {kind}, x array<int>, cluster int, lower double, squared long, scanned long")


def _totals(vectors: DataFrame, size: int) -> dict[int, tuple[int, float, list[int], int]]:
    """Number, radius, component sums and scanned vectors of each cluster: each batch adds up its own, Spark adds the batches up; one row a cluster and component reaches the driver."""

    def run(batches):
        for b in batches:
            x, cluster = _matrix(b.column(0), size), b.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            ids, first = np.unique(cluster[order], return_index=True)
            sums = np.add.reduceat(x[order], first, axis=0)
            far = np.maximum.reduceat(b.column(2).to_numpy()[order], first)
            scanned = np.add.reduceat(b.column(3).to_numpy()[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(np.append(first, len(x)))), pa.array(far), pa.array(scanned), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "far", "scanned", "sums"])

    parts = vectors.select("x", "cluster", "squared", "scanned").mapInArrow(run, "cluster int, n long, far long, scanned long, sums array<long>")
    out: dict[int, tuple[int, float, list[int], int]] = {}
    each = parts.select("cluster", "n", "far", "scanned", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at")
    for r in each.agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("scanned").alias("scanned"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r["cluster"], (r["n"], float(np.sqrt(float(r["far"]))), [0] * size, r["scanned"]))[2][r["at"]] = int(r["s"])
    return out


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64) -> DataFrame:
    """id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of each kept vector, and ``scanned``.

    Kept are vectors of ``size`` components, none null or non-finite; other
    rows are left out. Components become floor(256 * x); a vector whose
    integers reach 2**24 raises an error. The first centroids are the ``k``
    kept vectors with the smallest SHA-256 of ``2:<id>``; fewer vectors give
    fewer centroids, none an empty result. Rows that repeat, with an id or
    without one, are vectors of their own; those without an id are the last to
    become a centroid; rows of one id come in the order of their components.
    Distances are squared and exact, ties go to the smaller number. Each round
    moves every non-empty cluster's centroid to floor(sum / count) of its
    vectors. ``scanned``: how many vectors, over all rounds, were compared with
    all centroids. Columns not named are not read.
    """
    fields = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}"
    vectors = written(integer_vectors(rows, id_col, vector_col, size), "vectors")
    first = vectors.orderBy(start_order(id_col).asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], f"{fields}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long")
    now = np.array([r["x"] for r in first], np.int64)
    c = Centroids(now, now, np.zeros(len(now)))
    state = vectors.withColumns({"cluster": F.lit(-1), "lower": F.lit(-1.0)})
    scanned = 0
    for _ in range(rounds):
        state = written(_assigned(state, c, id_col, size), "assigned")
        found = _totals(state, size)
        moved, radius = c.now.copy(), np.zeros(len(now))
        for i, (n, far, sums, some) in found.items():
            moved[i], radius[i] = [s // n for s in sums], far
            scanned += some
        c = Centroids(moved, c.now, radius)
    state = written(_assigned(state, c, id_col, size), "assigned")
    last = state.groupBy("cluster").agg(F.sum(F.col("squared").cast("decimal(38,0)")).alias("total"), F.sum("scanned").alias("scanned")).collect()
    per = {r["cluster"]: int(r["total"]) for r in last}
    scanned += sum(r["scanned"] for r in last)
    digest = lambda i: hashlib.sha256(",".join(map(str, c.now[i].tolist())).encode()).hexdigest()
    named = rows.sparkSession.createDataFrame([(i, per[i], digest(i)) for i in sorted(per)], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = state.select(id_col, "cluster", F.col("squared").alias("distance")).join(F.broadcast(named), "cluster")
    return out.select(id_col, "cluster", "distance", "cluster_inertia", F.lit(sum(per.values())).cast("long").alias("inertia"), "centroid_sha256", F.lit(scanned).cast("long").alias("scanned"))


def rounds_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """The same clustering in SQL, one step after the other, on one row per vector and component."""
    assign = lambda r: f"""
, d{r} AS MATERIALIZED (SELECT v.row, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY 1, 2)
, a{r} AS MATERIALIZED (SELECT row, (min((d, c)))[2] AS c, (min((d, c)))[1] AS d FROM d{r} GROUP BY 1)"""  # noqa: E731
    move = lambda r: f"""
, c{r + 1} AS MATERIALIZED (
  SELECT c.c, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
  FROM c{r} c LEFT JOIN (SELECT a.c, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (row) GROUP BY 1, 2) s ON s.c = c.c AND s.i = c.i)"""  # noqa: E731
    return (
        f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1 AS row, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = {size}
), v AS MATERIALIZED (
  SELECT row, i, floor(256 * e[i]::DOUBLE)::BIGINT AS x FROM (SELECT row, e, unnest(range(1, {size + 1})) AS i FROM kept)
), c0 AS MATERIALIZED (SELECT row AS c, i, x FROM v WHERE row < {k})"""
        + "".join(assign(r) + move(r) for r in range(rounds))
        + assign(rounds)
        + f"""
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.d) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (row) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) h USING (c)
"""
    )
