"""Files and lists whose size does not grow with the table."""

import glob
import hashlib
import json

from pyspark.sql import functions as F

from skyloom.plans import file_queries, quality_queries
from skyloom.sources import readers


def watched(monkeypatch, tmp_path):
    paths = []
    monkeypatch.setattr(readers, "shared_folder", lambda spark: paths.append(f"{tmp_path}/{len(paths)}") or paths[-1])
    return paths


def test_bench_documents_are_bounded(spark, monkeypatch, tmp_path):
    paths = watched(monkeypatch, tmp_path)
    rows = spark.range(0, 40000, 1, 2).select(F.lit("N").alias("ord"), F.lit("O").alias("variant"), F.col("id").cast("double").alias("ms"), F.to_date(F.lit("1995-01-01")).alias("run"))
    out = file_queries.read_bench_json(lambda v: rows).collect()
    assert [(r["n"], r["mean"]) for r in out] == [(40000, 19999.5)]
    docs = [json.load(open(f)) for f in glob.glob(f"{paths[0]}/*.json")]
    assert len(docs) == 6 and max(len(x["ms_per_gal"]) for d in docs for x in d["results"]) <= 8192


def test_logs_of_one_user_are_many_files_read_in_pieces(spark, monkeypatch, tmp_path):
    paths = watched(monkeypatch, tmp_path)
    rows = spark.range(0, 6000, 1, 3).select(F.col("id").alias("event_id"), F.lit(5).alias("user_id"), (F.col("id") % 7).cast("double").alias("value"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1009")
    try:
        out = {r["sca"]: r["s"] for r in file_queries.read_run_logs(lambda v: rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for i in range(6000):
        want[i % 18 + 1] = want.get(i % 18 + 1, 0) + i % 7
    assert out == want and len(glob.glob(f"{paths[0]}/*.txt")) == 3
    assert spark.read.parquet(paths[1]).select("path", "piece").distinct().count() > 30


def test_list_in_many_files_is_numbered_as_one(spark, tmp_path):
    names = [("garbage" if i % 7 == 0 else f"name {i}",) for i in range(1000)]
    (tmp_path / "list").mkdir()
    for k in range(3):
        with open(f"{tmp_path}/list/part-{k:05}.txt", "w") as f:
            f.writelines(n + "\n" for (n,) in names[k * 400 : k * 400 + 400])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1009")
    try:
        out = sorted(map(tuple, readers.template_lines(spark, f"{tmp_path}/list").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out == [(i, f"name {i}") for i in range(1000) if i % 7]


def test_file_list_is_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality_queries, "BRANCH", 10)
    rows = [(g, i) for g in (1, 2) for i in range(0, 700, g)]
    df = spark.createDataFrame(rows, "src_group int, catalog_index long").repartition(3)
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    want = {}
    for g in (1, 2):
        level = {i: f"file_{i}" for x, i in rows if x == g}
        for _ in range(2):
            level = {b: sha([level[i] for i in sorted(level) if i // 10 == b]) for b in {i // 10 for i in level}}
        want[g] = sha([level[b] for b in sorted(level)])[:12]
    assert {r["src_group"]: r["hash"] for r in quality_queries.file_list_hash(lambda v: df).collect()} == want
