"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, neardup, pieces, pii, quality, rules
from skyloom.llm.scratch import bounded_batches, written

#: Up to so many ids are sent to every task; beyond, the join shuffles.
FEW_IDS = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row's key in doc_id: its id, or for rows without one a number beyond all ids; the id itself moves to ``_own``.

    Ids are integers, far enough below 2**63 for the numbers to follow. Rows
    without an id are written once with their numbers, so that a lost executor
    does not number them anew.
    """
    lost = docs.filter("doc_id is null")
    with_ids = docs.filter("doc_id is not null").withColumn("_own", F.col("doc_id"))
    if lost.isEmpty():
        return with_ids
    last = docs.agg(F.max("doc_id")).first()[0]
    first = 0 if last is None else max(last + 1, 0)
    numbered = written(lost.withColumn("_own", F.col("doc_id")).withColumn("doc_id", F.lit(first) + F.monotonically_increasing_id()), "numbered")
    return with_ids.unionByName(numbered)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of :func:`keyed` documents whose key is not in ``ids``, with their own ids again."""
    ids = written(ids.select("doc_id").distinct(), "dropped")
    left = docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_anti")
    return left.withColumn("doc_id", F.col("_own")).select(*(c for c in docs.columns if c != "_own"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted to ``labels``, scores below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(written(rules.statistics(docs.filter(~quality.held_out())), "stats"), labels)
    return docs if model is None else quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles at 0.8; those without an id come after all others."""
    docs = keyed(docs)
    return without(docs, neardup.near_duplicates(docs, shingle=5, percent=80).filter(~F.col("kept")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also edited."""
    docs = keyed(docs)
    return without(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows where the text changed."""
    proposed = written(docs.withColumn("_proposed", pii.proposals(F.col("text"))), "proposed")
    model = pii.fit(proposed, "_proposed")
    found = proposed.withColumn("spans", pii.accepted(model, F.col("_proposed")))
    text = pii.redacted(F.col("text"), F.col("spans"))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether decoding gives the text back."""
    encoded = pieces.encode(docs, keep=["lang", "source"], check=True)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_personal_data),
    ("tokens", tokens),
]
#: No SQL: classifier, alignment and tokenizer have none; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
