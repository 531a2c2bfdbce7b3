"""Queries that write what they derive from the tables to files in the shared folder, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.plans.join_queries import targets
from skyloom.plans.registry import query
from skyloom.plans.scalar_queries import r
from skyloom.sources import readers
from skyloom.streaming.ingest import incremental_ingest


#: Header and timing pairs in a log file; times in a benchmark document, as a power of two.
LINES, TIMES_BITS = 100_000, 13


def text_of(df, *cols):
    return df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in cols)).alias("value"))


@query("read_targets", "SELECT round(9.0 + (p_partkey * 7919 % 20011) / 10000.0, 6) AS ra, round(-1.0 + (p_partkey * 6367 % 20011) / 10000.0, 6) AS dec FROM {part}")
def read_targets(t):
    df = targets(t)
    spark, path = df.sparkSession, readers.shared_folder(df.sparkSession)
    text_of(df, "ra0", "dec0").union(spark.sql("select '# ra dec' as value")).write.text(path)
    out = readers.read_targets(spark, path)
    return out.select(r(F.col("ra")).alias("ra"), r(F.col("dec")).alias("dec"))


@query("read_catalog", "SELECT type, count(*) AS n, round(sum(ra), 4) AS ra, (SELECT count(*) FROM {grid}) AS n_wl FROM {sources} GROUP BY type")
def read_catalog(t):
    """A catalog folder, written and read: typed rows and the wavelength grid."""
    df = t("sources")
    path = readers.shared_folder(df.sparkSession)
    readers.as_catalog(df).write.parquet(f"{path}/catalog")
    t("grid").select("wavelength").write.parquet(f"{path}/wavelengths")
    rows, grid = readers.read_catalog(df.sparkSession, path)
    return rows.groupBy("type").agg(F.count("*").alias("n"), r(F.sum("ra"), 4).alias("ra")).crossJoin(F.broadcast(grid.agg(F.count("*").alias("n_wl"))))


@query("read_pointings", "SELECT c_custkey AS pointing_id, round(9.0 + (c_custkey * 7919 % 20011) / 10000.0, 4) AS ra, round(-1.0 + (c_custkey * 6367 % 20011) / 10000.0, 4) AS dec FROM {customer} WHERE c_custkey % 5 <> 0")
def read_pointings(t):
    """Pointing tables of as many rows as there are customers, one in five for another element."""
    c = F.col("c_custkey")
    df = t("customer").select(c.alias("ID"), F.round(9.0 + (c * 7919 % 20011) / 10000.0, 4).alias("RA"), F.round(-1.0 + (c * 6367 % 20011) / 10000.0, 4).alias("DEC"), F.when(c % 5 == 0, "PRISM").otherwise("GRISM").alias("BANDPASS"))
    path = readers.shared_folder(df.sparkSession)
    df.write.csv(path, sep=" ", header=True)
    out = readers.read_pointings(df.sparkSession, path, "GRISM", "ID long, RA double, DEC double, BANDPASS string")
    return out.select(F.col("ID").alias("pointing_id"), F.col("RA").alias("ra"), F.col("DEC").alias("dec"))


@query("read_star_table", "SELECT round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag, sed_index AS template FROM {sources} WHERE type = 'PSF'")
def read_star_table(t):
    df = t("sources").filter("type = 'PSF'")
    path = readers.shared_folder(df.sparkSession)
    df.select(F.concat_ws("   ", "ra", "dec", "mag", "sed_index", "sim").alias("ra dec mag tmpl sim")).write.csv(path, header=True, sep="\x01")
    out = readers.read_star_table(df.sparkSession, path)
    return out.select(r(F.col("ra")).alias("ra"), r(F.col("dec")).alias("dec"), r(F.col("mag")).alias("mag"), "template")


@query("template_lines", "SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS idx, p_name AS name FROM {part} QUALIFY p_partkey % 7 <> 0")
def template_lines(t):
    """A list with every seventh slot marked as garbage; its files follow one another in order of name."""
    df = t("part").orderBy("p_partkey").select(F.when(F.col("p_partkey") % 7 == 0, "garbage").otherwise(F.col("p_name")).alias("value"))
    path = readers.shared_folder(df.sparkSession)
    df.write.text(path)
    return readers.template_lines(df.sparkSession, path)


@query("discover_products", "SELECT DISTINCT sca FROM {manifest}")
def discover_products(t):
    """Files named by detector, found again by their names."""
    df = t("manifest")
    path = readers.shared_folder(df.sparkSession)
    df.select("catalog_index", F.concat(F.lit("image_sca"), F.lpad(F.col("sca").cast("string"), 2, "0"), F.lit(".fits")).alias("product")).write.partitionBy("product").parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "product=([^/]*)/", 1).alias("path"))
    return readers.product_names(files).select("sca").distinct()


LOGS = "(SELECT (user_id % 5)::VARCHAR AS run, event_id % 18 + 1 AS sca, round(value, 2) AS v FROM {events})"


@query("read_run_logs", f"SELECT sca::INT AS sca, 'sed' AS step, round(sum(v), 2) AS s FROM {LOGS} GROUP BY sca")
def read_run_logs(t):
    """Worker logs, as many as the events fill: a header line per detector, then a timing line."""
    e = t("events")
    path = readers.shared_folder(e.sparkSession)
    pair = F.concat(F.lit("start SCA "), (F.col("event_id") % 18 + 1).cast("string"), F.lit("\n  sed: "), F.format_string("%.2f", F.round("value", 2)), F.lit(" s"))
    e.select(pair.alias("value")).write.option("maxRecordsPerFile", LINES).text(path)
    out = readers.read_run_logs(e.sparkSession, path)
    return out.groupBy("sca", "step").agg(F.round(F.sum("s"), 2).alias("s"))


@query("read_bench_json", "SELECT ord, variant, count(*) AS n, round(avg(ms), 3) AS mean FROM {bench} GROUP BY ord, variant")
def read_bench_json(t):
    """Documents of at most 2**TIMES_BITS times, from rows that follow one another in a partition."""
    b = t("bench")
    path = readers.shared_folder(b.sparkSession)
    rows = b.withColumn("m", F.shiftright(F.monotonically_increasing_id(), TIMES_BITS)).groupBy("m", "ord", "variant").agg(F.collect_list("ms").alias("ms_per_gal"))
    docs = rows.groupBy("m").agg(F.collect_list(F.struct(F.col("ord").alias("order"), "variant", "ms_per_gal")).alias("results")).select(F.struct(F.lit("gpu").alias("gpu")).alias("meta"), "results")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    out = readers.read_bench_json(b.sparkSession, path)
    return out.groupBy(F.col("order").alias("ord"), "variant").agg(F.count("*").alias("n"), r(F.avg("ms"), 3).alias("mean"))


@query("write_seds", "SELECT sim, count(*) AS n, sum(len(embedding))::BIGINT AS bins FROM {spectra} GROUP BY sim")
def write_seds(t):
    """All partitions written, one replaced: the others stay."""
    s = t("spectra").select("sim", "sed_index", F.transform("embedding", lambda x: F.abs(x)).alias("flux"))
    path = readers.shared_folder(s.sparkSession)
    readers.write_seds(s, path)
    readers.write_seds(s.filter("sim = 2"), path)
    return s.sparkSession.read.parquet(path).groupBy("sim").agg(F.count("*").alias("n"), F.sum(F.size("flux")).alias("bins"))


@query("write_manifest", "SELECT sca, ord, count(*) AS n, round(sum(xsca), 3) AS x FROM {manifest} GROUP BY sca, ord")
def write_manifest(t):
    m = t("manifest")
    path = readers.shared_folder(m.sparkSession)
    readers.write_manifest(m, path)
    return m.sparkSession.read.parquet(path).groupBy("sca", "ord").agg(F.count("*").alias("n"), r(F.sum("xsca"), 3).alias("x"))


@query("write_with_provenance", "SELECT 'manifest' AS made_from, count(*) AS n_rows FROM {manifest}")
def write_with_provenance(t):
    m = t("manifest")
    spark, path = m.sparkSession, readers.shared_folder(m.sparkSession)
    readers.write_with_provenance(m, path, {"made_from": "manifest"})
    note = readers.read_provenance(spark, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows")).select(F.lit(note["made_from"]).alias("made_from"), "n_rows")


@query("write_summary_tables", "SELECT sca::INT AS sca, count(*) AS n FROM {residuals} GROUP BY sca")
def write_summary_tables(t):
    s = t("residuals").groupBy("sca").agg(F.count("*").alias("n"))
    path = readers.shared_folder(s.sparkSession)
    readers.write_summary_tables(s, path)
    return s.sparkSession.read.schema("sca int, n long").json(f"{path}/json")


@query("incremental_ingest", "SELECT sca, count(*) AS n FROM {manifest} GROUP BY sca")
def incremental_ingest_query(t):
    """Half of the manifest, then all of it again as new files, then nothing new: each source arrives once."""
    m = t("manifest").select("catalog_index", "sca")
    spark, path = m.sparkSession, readers.shared_folder(m.sparkSession)
    for part in (m.filter("catalog_index % 2 = 0"), m, None):
        if part is not None:
            part.write.mode("append").parquet(f"{path}/new")
        incremental_ingest(spark, f"{path}/new", f"{path}/done", f"{path}/state", m.schema, "catalog_index")
    return spark.read.parquet(f"{path}/done").groupBy("sca").agg(F.count("*").alias("n"))
