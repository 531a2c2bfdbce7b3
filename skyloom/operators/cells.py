"""Sky cells of variable depth: a cover planned by size, points placed in it, and files laid out by cell.

Cells are NESTED: the cells of a finer order within a cell are one range of
numbers, so a cover is a list of ranges that do not overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators.quantiles import numbered
from skyloom.operators.sky import small

#: Rows that a task sorts and writes.
RANGE = 100_000


def cover(points: DataFrame, cell: str, coarsest: int, finest: int, row_bytes: float, target_bytes: float) -> DataFrame:
    """(ord, cell, n_rows, est_bytes, oversize, start, stop): the cells, from ``coarsest`` to ``finest``, that together hold all points.

    ``cell`` is a point's cell at the finest order. A cell of more than
    ``target_bytes`` (rows times ``row_bytes``) is split into its four children;
    at the finest order it stays, as oversize. A cell is in the cover if it
    fits (or is of the finest order) and its parent does not. Points are counted
    once, at the finest order; the other orders add up these counts. ``start``
    and ``stop`` are the cell's range of finest cells. Points without a cell are
    left out.
    """
    fine = points.filter(F.col(cell).isNotNull()).groupBy(F.col(cell).cast("long").alias("_fine")).agg(F.count("*").alias("_n"))
    up = F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.shiftright("_fine", 2 * (finest - o)).alias("cell")) for o in range(coarsest, finest + 1)))).alias("_c")
    counts = fine.select(up, "_n").groupBy("_c.ord", "_c.cell").agg(F.sum("_n").alias("n_rows"))
    counts = counts.withColumn("est_bytes", F.col("n_rows") * F.lit(float(row_bytes)))
    split = counts.filter((F.col("est_bytes") > target_bytes) & (F.col("ord") < finest)).select((F.col("ord") + 1).alias("ord"), F.col("cell").alias("_parent"))
    whole = counts.join(split.withColumn("cell", F.explode(F.array(*(F.shiftleft("_parent", 2) + i for i in range(4))))).select("ord", "cell", F.lit(True).alias("_below")), ["ord", "cell"], "left")
    fits = (F.col("est_bytes") <= target_bytes) | (F.col("ord") == finest)
    kept = whole.filter(fits & ((F.col("ord") == coarsest) | F.col("_below")))
    width = reduce(lambda a, o: a.when(F.col("ord") == o, F.lit(4 ** (finest - o))), range(coarsest, finest), F.when(F.col("ord") == finest, F.lit(1))).cast("long")
    return kept.select("ord", "cell", "n_rows", "est_bytes", (F.col("est_bytes") > target_bytes).alias("oversize"), (F.col("cell") * width).alias("start"), ((F.col("cell") + 1) * width).alias("stop"))


def placed(points: DataFrame, cell: str, plan: DataFrame, coarsest: int, finest: int) -> DataFrame:
    """``points`` with ``ord`` and ``hp_uniq`` of the cover's cell they lie in; points outside the cover are left out.

    The range of each finest cell is looked up once; points join on their
    finest cell, so they are neither repeated nor sorted.
    """
    fine = points.select(F.col(cell).cast("long").alias("_fine")).distinct()
    starts = F.array(*(F.struct(F.lit(o).alias("ord"), F.shiftleft(F.shiftright("_fine", 2 * (finest - o)), 2 * (finest - o)).alias("start")) for o in range(coarsest, finest + 1)))
    found = fine.withColumn("_c", F.explode(starts)).select("_fine", "_c.*").join(small(plan.select("ord", "start", "stop", "cell")), ["ord", "start"])
    found = found.filter((F.col("_fine") >= F.col("start")) & (F.col("_fine") < F.col("stop"))).select("_fine", "ord", _uniq().alias("hp_uniq"))
    return points.withColumn("_fine", F.col(cell).cast("long")).join(small(found), "_fine").drop("_fine")


def _uniq():
    return F.expr("shiftleft(4L, 2 * ord) + cell")


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt to tasks of about RANGE rows by ranges of hp_uniq and ``order``, and sorted there: a crowded cell is several tasks' work."""
    ranges = max(1, -(-rows.count() // RANGE))
    return rows.repartitionByRange(ranges, "hp_uniq", *order).sortWithinPartitions("hp_uniq", *order)


def in_cells(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``hp_row``, a row's place in its cell (ties of ``order`` in any order)."""
    at = numbered(rows, ["hp_uniq", order], "_at")
    first = at.groupBy("hp_uniq").agg(F.min("_at").alias("_first"))
    return at.join(small(first), "hp_uniq").withColumn("hp_row", (F.col("_at") - F.col("_first")).cast("int")).select(*rows.columns, "hp_row")


def write_cells(rows: DataFrame, path: str, key: str, order: str) -> None:
    """``rows`` (with hp_uniq) as files by cell, sorted within: ``hp_row`` is the row's place in its cell. Beside them, what was written.

    The notes have each cell's rows and the order-free checksum of their
    contents. Rows that bring their ``hp_row`` (see :func:`in_cells`, best made
    before wide columns are joined) keep it. No task holds a whole cell.
    """
    in_ranges(rows if "hp_row" in rows.columns else in_cells(rows, order), ["hp_row"]).write.partitionBy("hp_uniq").parquet(f"{path}/rows")
    summed(rows, key).withColumnRenamed("n", "noted").write.parquet(f"{path}/notes")


def summed(rows: DataFrame, key: str) -> DataFrame:
    """(hp_uniq, n, checksum): rows of each cell, and a sum over hashes of the key and all other columns, in any order of rows."""
    columns = sorted(set(rows.columns) - {"hp_uniq", "hp_row", key})
    return rows.groupBy("hp_uniq").agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, *columns).cast("decimal(38,0)")).alias("checksum"))


def replace_cells(rows: DataFrame, path: str) -> None:
    """Replace the stored cells that ``rows`` (as stored, with hp_row) holds; others, and the notes, stay."""
    in_ranges(rows, ["hp_row"]).write.partitionBy("hp_uniq").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/rows")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").withColumn("hp_uniq", F.col("hp_uniq").cast("long"))


def read_cells(spark: SparkSession, path: str, wanted: DataFrame, row: str | None = None) -> DataFrame:
    """Stored rows of the cells in ``wanted`` (hp_uniq and, if given, ``row``, a place in the cell); other columns of ``wanted`` are added.

    Cells are partitions of the files. The wanted cells, in the partitions' own
    type and under a comparison, let Spark prune files by them at run time.
    """
    rows = spark.read.parquet(f"{path}/rows")
    cell = F.col("hp_uniq").try_cast(rows.schema["hp_uniq"].dataType)
    on = ["hp_uniq", *([row] if row else [])]
    return rows.join(small(wanted.withColumn("hp_uniq", cell).filter("hp_uniq > 0")), on)


def verify(spark: SparkSession, path: str, plan: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Per cell: rows ``planned``, ``stored`` and ``noted``, whether the contents equal the ``original``'s, and whether all is as it should be.

    Stored rows are counted by the files' footers (no column is read); contents
    are compared by a checksum per cell, made from the original and from the
    files, so nothing is joined row by row.
    """
    rows = spark.read.parquet(f"{path}/rows")
    footers = rows.groupBy("hp_uniq").agg(F.count("*").alias("stored"))
    found = summed(rows, key).select("hp_uniq", F.col("checksum").alias("_found"))
    wanted = summed(original, key).select("hp_uniq", F.col("checksum").alias("_wanted"))
    notes = spark.read.parquet(f"{path}/notes").select("hp_uniq", "noted", F.col("checksum").alias("_noted"))
    sides = [plan.select(_uniq().alias("hp_uniq"), F.col("n_rows").alias("planned")), footers, notes, found, wanted]
    both = reduce(lambda a, b: a.join(b, "hp_uniq", "full"), sides).na.fill(0, ["planned", "stored", "noted"])
    same = F.col("_found").eqNullSafe(F.col("_wanted")) & F.col("_noted").eqNullSafe(F.col("_wanted"))
    ok = (F.col("planned") == F.col("stored")) & (F.col("stored") == F.col("noted")) & same
    return both.select("hp_uniq", "planned", "stored", "noted", same.alias("same"), ok.alias("ok"))


def sky_cells(df: DataFrame, order: int) -> DataFrame:
    """``df`` with ``fine``, the cell of (ra, dec) at an order."""
    return df.withColumn("fine", S.sky_cell("ra", "dec", order))
