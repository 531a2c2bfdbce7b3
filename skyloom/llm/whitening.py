"""Whitening of embeddings with MLlib's distributed block matrices.

Rows get numbers from 0, are centred, and become the rows of a BlockMatrix X.
Its transpose times itself is the scatter matrix, the only matrix that reaches
the driver (its size is the dimension's square); the driver takes its
eigenvectors. X times the whitening matrix is a BlockMatrix again, whose rows
go back to their ids by their numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.scratch import written

#: Rows of a block; a block of 64 doubles a row is 512 KB.
BLOCK_ROWS = 1024
#: Blocks that one task multiplies and adds up.
BLOCKS_A_TASK = 8
#: Up to so many rows are sent to every task; beyond, the join shuffles.
FEW = 500_000
#: Components with less than this share of the largest eigenvalue can't be scaled to unit variance in doubles.
FLAT = 1e-12


def numbered(rows: DataFrame, name: str = "row") -> DataFrame:
    """``rows`` (a written table) with numbers from 0 without gaps: places within partitions, and the rows of the partitions before, summed over one row a partition."""
    placed = written(rows.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("_place", 33)
    parts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = parts.selectExpr("_part", "sum(_rows) over (order by _part rows between unbounded preceding and current row) - _rows as _before")
    before = written(before, "before")
    out = placed.withColumn("_part", part).join(F.broadcast(before) if before.count() <= FEW else before, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_place")


def block_matrix(rows: DataFrame, size: int) -> BlockMatrix:
    """(row, values) as a matrix of blocks of BLOCK_ROWS rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, 0, size).toBlockMatrix(BLOCK_ROWS, size)


def scatter(x: BlockMatrix) -> np.ndarray:
    """X'X as a local matrix.

    PySpark's ``multiply`` has no number of splits of the inner dimension;
    without it, all blocks of X meet in the one task of the one result block.
    So the method is called with it, over the same object.
    """
    splits = max(1, -(-x.numRows() // (BLOCK_ROWS * BLOCKS_A_TASK)))
    product = x.transpose()._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, x.numCols(), x.numCols()).toLocalMatrix().toArray()


def multiplied(x: BlockMatrix, right: np.ndarray, spark) -> DataFrame:
    """(row, values) of X times a local matrix."""
    one = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(*right.shape, right.ravel(order="F").tolist()))]), *right.shape)
    rows = x.multiply(one).toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector.toArray().tolist()))
    return rows.toDF("row long, values array<double>")


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows kept, x: floor(64 * component) + 1000000 of each component."""
    v = F.col(vector_col)
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    kept = rows.filter((F.size(v) > 0) & F.forall(v, fine))
    return kept.select(id_col, F.transform(v, lambda c: F.floor(c.cast("double") * 64) + 1_000_000).alias("x"))


def whitened(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: one row for each kept row and component, from 1.

    Kept are vectors that aren't null or empty and hold no null or non-finite
    entry, of the length that most of them have (the longer, on ties). The fit
    covers all of them. ``deviation`` is the exact sum over dimensions of
    (n x - S)^2, a decimal(38,0). Components without variance (below 1e-12 of
    the largest eigenvalue) give no rows, so equal vectors give none; nor does
    an empty table. Rows that repeat, with an id or without one, are vectors of
    their own. Columns not named are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    kept = written(integer_vectors(rows, id_col, vector_col), "vectors")
    sizes = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    nothing = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not sizes:
        return nothing
    size, n = sizes[0]["size"], sizes[0]["count"]
    kept = numbered(kept.filter(F.size("x") == size))
    each = kept.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(each.collect())]
    whole, rest = F.lit([s // n for s in sums]).cast("array<bigint>"), F.lit([(s % n) / n for s in sums]).cast("array<double>")
    centred = F.zip_with(F.zip_with("x", whole, lambda x, w: x - w), rest, lambda x, r: x.cast("double") - r)
    exact = F.zip_with("x", F.lit([str(s) for s in sums]).cast("array<decimal(38,0)>"), lambda x, s: x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s)
    squares = F.aggregate(exact, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")).cast("decimal(38,0)"))
    fitted = written(kept.select(id_col, "row", centred.alias("values"), squares.alias("deviation")), "centred")
    x = block_matrix(fitted, size)
    values, vectors = np.linalg.eigh(scatter(x) / n)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > FLAT * max(values.max(), 0)]
    if not len(order):
        return nothing
    scores = written(multiplied(x, vectors[:, order] / np.sqrt(values[order]), spark), "scores")
    mean = [float(m) for m in scores.agg(*(F.avg(F.col("values")[i]) for i in range(len(order)))).first()]
    means = F.lit(mean).cast("array<double>")
    again = scatter(block_matrix(scores.select("row", F.zip_with("values", means, lambda v, m: v - m).alias("values")), len(order))) / n
    error = float(np.abs(again - np.eye(len(order))).max())
    explained = F.lit([float(v) for v in values[order] / values.sum()]).cast("array<double>")
    out = fitted.select(id_col, "row", "deviation").join(scores, "row").select(id_col, "deviation", F.posexplode("values").alias("_at", "whitened"))
    return out.select(id_col, (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
