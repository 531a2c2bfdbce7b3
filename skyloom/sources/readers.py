"""Reading and writing survey tables. Texts are parsed by column functions, never row by row in Python."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name, type, unit and description of each catalog column.
CATALOG = [
    ("ra", T.DoubleType(), "deg", "right ascension"), ("dec", T.DoubleType(), "deg", "declination"), ("type", T.StringType(), "", "PSF or SER"),
    ("n", T.FloatType(), "", "Sersic index"), ("half_light_radius", T.FloatType(), "arcsec", "half-light radius"), ("pa", T.FloatType(), "deg", "position angle"),
    ("ba", T.FloatType(), "", "axis ratio"), ("F158", T.FloatType(), "maggies", "flux in the reference band"), ("z_obs", T.FloatType(), "", "observed redshift"),
    ("z_cosmo", T.FloatType(), "", "cosmological redshift"), ("sed_index", T.IntegerType(), "", "row of the spectrum"), ("flux_scale", T.FloatType(), "", "factor on the spectrum"),
    ("sim", T.ShortType(), "", "partition of the spectrum"), ("src_index", T.IntegerType(), "", "row in the original"),
]


def catalog_schema() -> T.StructType:
    """The catalog's columns, with unit and description as field metadata."""
    return T.StructType([T.StructField(n, t, True, {"unit": u, "description": d}) for n, t, u, d in CATALOG])


def as_catalog(df: DataFrame) -> DataFrame:
    """Columns of the catalog schema, cast and with its metadata; those that df lacks are null. Other columns are dropped."""
    out = []
    for f in catalog_schema().fields:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        out.append(source.cast(f.dataType).alias(f.name, metadata=f.metadata))
    return df.select(*out)


def column_dictionary(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("unit", ""), f.metadata.get("description", "")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, unit string, description string")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Catalog rows and the wavelength grid of a folder."""
    return spark.read.schema(catalog_schema()).parquet(f"{path}/catalog"), spark.read.parquet(f"{path}/wavelengths")


def read_pointings(spark: SparkSession, path: str, bandpass: str, schema: str) -> DataFrame:
    """Pointing table of blank-separated values with a header and # comments; one element's rows."""
    return spark.read.schema(schema).csv(path, sep=" ", header=True, comment="#").filter(F.col("BANDPASS") == bandpass)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share. Where that is unset, a temporary folder, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/skyloom-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: made once, and not lost with an executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df`` written as a table bucketed and sorted by its keys, under the shared folder; the session's catalog knows it by a name of its own."""
    path = shared_folder(df.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _fields(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Blank-separated words of each line that is not empty or a comment; with a header, without the first line of each file."""
    lines = spark.read.schema("value string").csv(path, sep="\x01", header=True) if header else spark.read.text(path)
    lines = lines.select(F.trim("value").alias("line")).filter("line is not null")
    return lines.filter(~F.col("line").rlike("^(#.*)?$")).select(F.split("line", r"\s+").alias("w"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, piece, line, value): lines in order of line within a piece of a file, pieces by where they start. Written once, so that all readers see the same pieces."""
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("line"), "value")
    return kept(read).withColumn("file", F.element_at(F.split("path", "/"), -1))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): lines with their number from 0 over all files in order of name. Numbers within pieces plus the lines of the pieces before; only one row a piece goes through the single-task window."""
    lines = _lines(spark, path)
    pieces = lines.groupBy("path", "piece").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(pieces.select("path", "piece", (before - F.col("first")).alias("shift")), ["path", "piece"]).select((F.col("line") + F.col("shift")).cast("int").alias("at"), "value")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(ra, dec) of lines with exactly two columns; any other line is an error."""
    w = F.when(F.size("w") == 2, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), F.array_join("w", " "))))
    return _fields(spark, path).select(w.alias("w")).select(F.col("w")[0].cast("double").alias("ra"), F.col("w")[1].cast("double").alias("dec"))


def read_star_table(spark: SparkSession, path: str) -> DataFrame:
    """Four of a star file's columns, after one header line."""
    w = lambda i: F.col("w")[i]
    return _fields(spark, path, header=True).select(w(0).cast("double").alias("ra"), w(1).cast("double").alias("dec"), w(2).cast("double").alias("mag"), w(3).cast("int").alias("template"))


def template_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name) of a line-numbered list in one or more files, without 'garbage' slots."""
    return _numbered(spark, path).select(F.col("at").alias("idx"), F.trim("value").alias("name")).filter("name <> 'garbage' and name <> ''")


def read_source_index(df: DataFrame) -> DataFrame:
    """Six typed columns of a survey index."""
    return df.select(F.col("ra").cast("double"), F.col("dec").cast("double"), F.col("sim").cast("smallint"), F.col("sed_index").cast("int").alias("idx"), F.col("mag").cast("float"), F.col("z_obs").cast("float").alias("z"))


def read_sensitivity(mapping: DataFrame, curves: DataFrame, scas: DataFrame) -> DataFrame:
    """Curve of each (sca, ord) through a map to curve names; a detector without a map entry is an error."""
    known = scas.join(mapping, "sca", "left")
    name = F.when(F.col("curve").isNotNull(), F.col("curve")).otherwise(F.raise_error(F.concat(F.lit("no curve for detector "), F.col("sca").cast("string"))))
    return known.withColumn("curve", name).join(curves, "curve").select("sca", "ord", "wavelength", "sens")


def product_names(files: DataFrame) -> DataFrame:
    """(path, sca, prefix) of paths named <prefix>_sca<nn>.<ext>; of others by their last number."""
    name = F.element_at(F.split("path", "/"), -1)
    first, second = F.regexp_extract(name, r"^(.*)_sca(\d+)\.", 2), F.regexp_extract(name, r"(\d+)\D*$", 1)
    number = F.when(first != "", first).otherwise(second)
    return files.select("path", F.nullif(number, F.lit("")).cast("int").alias("sca"), F.regexp_extract(name, r"^(.*)_sca(\d+)\.", 1).alias("prefix")).filter("sca is not null")


def discover_products(spark: SparkSession, path: str) -> DataFrame:
    """:func:`product_names` of all files under a folder; contents are not read."""
    return product_names(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path"))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, sca, seconds by step) of worker logs: lines 'SCA n' and 'step: x s'; the last header holds until the next in a file."""
    header = F.nullif(F.regexp_extract("value", r"\bSCA (\d+)", 1), F.lit("")).cast("int")
    lines = _lines(spark, path).withColumn("header", header)
    w = Window.partitionBy("path", "piece").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = lines.groupBy("path", "piece").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line"))).alias("last"))
    pieces = pieces.select("path", "piece", F.last("last", ignorenulls=True).over(before).alias("carried"))
    step, seconds = F.regexp_extract("value", r"(\w+): ([\d.]+) s", 1), F.nullif(F.regexp_extract("value", r"(\w+): ([\d.]+) s", 2), F.lit("")).cast("double")
    filled = lines.withColumn("own", F.last("header", ignorenulls=True).over(w)).join(pieces, ["path", "piece"])
    found = filled.select(F.col("file").alias("run"), F.coalesce("own", "carried").alias("sca"), step.alias("step"), seconds.alias("s"))
    return found.filter("s is not null and sca is not null").groupBy("run", "sca", "step").agg(F.sum("s").alias("s"))


BENCH_SCHEMA = "meta struct<gpu:string>, results array<struct<`order`:string,variant:string,ms_per_gal:array<double>>>"


def read_bench_json(spark: SparkSession, path: str) -> DataFrame:
    """(gpu, order, variant, ms) rows of benchmark documents."""
    docs = spark.read.schema(BENCH_SCHEMA).json(path, multiLine=True)
    return docs.select("meta.gpu", F.explode("results").alias("x")).select("gpu", "x.order", "x.variant", F.explode("x.ms_per_gal").alias("ms"))


def write_seds(df: DataFrame, path: str, key: str = "sim") -> None:
    """Replace the partitions that df holds; others stay as they are."""
    df.write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_with_provenance(df: DataFrame, path: str, provenance: dict) -> None:
    """The table with its provenance as metadata of its first column, and so inside the files' schema."""
    first = df.schema.fields[0]
    noted = df.withMetadata(first.name, first.metadata | {"provenance": json.dumps(provenance, sort_keys=True)})
    noted.write.mode("overwrite").parquet(path)


def read_provenance(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).schema.fields[0].metadata["provenance"])


def write_summary_tables(df: DataFrame, path: str) -> None:
    """A summary (few rows by construction) as one CSV and one JSON file."""
    one = df.coalesce(1)
    one.write.mode("overwrite").csv(f"{path}/csv", header=True)
    one.write.mode("overwrite").json(f"{path}/json")
