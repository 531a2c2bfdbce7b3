"""Layouts by sky cell: covers against brute force, pruned reads, and damage that the check finds; ingest without reading the target."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import cells
from skyloom.sources import readers
from skyloom.streaming.ingest import incremental_ingest

LOW, HIGH = 1, 5


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    fine = [*rng.integers(0, 12 * 4**HIGH, 600).tolist(), *[77] * 300, *rng.integers(4000, 4030, 400).tolist(), None]
    return spark.createDataFrame([(i, f, float(i) / 3) for i, f in enumerate(fine)], "id long, fine long, v double")


def cover_by_hand(fine, most):
    def split(order, cell, values):
        if len(values) <= most or order == HIGH:
            return [(order, cell, len(values), len(values) > most)]
        parts = {}
        for v in values:
            parts.setdefault(v >> 2 * (HIGH - order - 1), []).append(v)
        return [x for c, vs in parts.items() for x in split(order + 1, c, vs)]

    top = {}
    for v in fine:
        top.setdefault(v >> 2 * (HIGH - LOW), []).append(v)
    return sorted(x for c, vs in top.items() for x in split(LOW, c, vs))


def test_cover_and_places_equal_splitting_by_hand(points):
    plan = cells.cover(points, "fine", LOW, HIGH, 10.0, 500.0)
    got = sorted((r["ord"], r["cell"], r["n_rows"], r["oversize"]) for r in plan.collect())
    assert got == cover_by_hand([r["fine"] for r in points.collect() if r["fine"] is not None], 50)
    assert sum(o for *_, o in got) == 1
    placed = Counter(r["hp_uniq"] for r in cells.placed(points, "fine", plan, LOW, HIGH).collect())
    assert placed == {4 * 4**o + c: n for o, c, n, _ in got}
    assert cells.cover(points.limit(0), "fine", LOW, HIGH, 10.0, 500.0).count() == 0


def test_layout_is_pruned_and_damage_is_found(spark, points):
    plan = readers.kept(cells.cover(points, "fine", LOW, HIGH, 10.0, 500.0))
    rows = cells.placed(points, "fine", plan, LOW, HIGH).select("hp_uniq", "id", "v")
    path = readers.shared_folder(spark)
    cells.write_cells(rows, path, "id", "id")
    assert cells.verify(spark, path, plan, rows, "id").filter("not ok").count() == 0
    some = [r["hp_uniq"] for r in plan.select(F.expr("shiftleft(4L, 2 * ord) + cell").alias("hp_uniq")).orderBy("hp_uniq").limit(3).collect()]
    found = cells.read_cells(spark, path, spark.createDataFrame([(c,) for c in some], "hp_uniq long"))
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.collect() if r["hp_uniq"] in some)
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert any("dynamicpruning" in line for line in scans)
    assert found.select(F.input_file_name().alias("f")).distinct().count() == 3 < plan.count()
    bad = readers.kept(cells.stored(spark, path).filter(F.col("hp_uniq") == some[0]).withColumn("v", F.col("v") + 1))
    cells.replace_cells(bad, path)
    wrong = cells.verify(spark, path, plan, rows, "id").filter("not ok").collect()
    assert [(r["hp_uniq"], r["stored"] == r["planned"], r["same"]) for r in wrong] == [(some[0], True, False)]


def test_ingest_meets_late_and_repeated_files(spark):
    root = readers.shared_folder(spark)
    schema = "id long, v double"
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/new")
    fields = spark.createDataFrame([], schema).schema
    for rows in ([(1, 0.5), (2, 0.5)], [(2, 0.5), (3, 0.5), (3, 0.5), (None, 1.0)], [(1, 0.5)]):
        make(rows)
        incremental_ingest(spark, f"{root}/new", f"{root}/done", f"{root}/state", fields, "id")
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/done").collect()) == [1, 2, 3]


def test_a_crowded_cell_is_written_by_several_tasks(spark, points, monkeypatch):
    monkeypatch.setattr(cells, "RANGE", 100)
    plan = readers.kept(cells.cover(points, "fine", LOW, HIGH, 10.0, 500.0))
    rows = cells.placed(points, "fine", plan, LOW, HIGH).select("hp_uniq", "id", "v")
    path = readers.shared_folder(spark)
    cells.write_cells(rows, path, "id", "id")
    assert cells.verify(spark, path, plan, rows, "id").filter("not ok").count() == 0
    found = cells.stored(spark, path).select("hp_uniq", "hp_row", "id", F.input_file_name().alias("f")).collect()
    crowd = [r for r in found if r["hp_uniq"] == Counter(r["hp_uniq"] for r in found).most_common(1)[0][0]]
    assert len(crowd) >= 300 and len({r["f"] for r in crowd}) >= 3
    assert max(Counter(r["f"].rsplit("/", 1)[1].split("-c")[0] for r in found).values()) < 200  # files of a task share a name
    for cell in {r["hp_uniq"] for r in found}:
        assert [r["hp_row"] for r in sorted((r for r in found if r["hp_uniq"] == cell), key=lambda r: r["id"])] == list(range(sum(r["hp_uniq"] == cell for r in found)))
