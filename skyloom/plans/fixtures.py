"""Views over the given tables that carry the schemas of a survey catalog.

Each is one SQL text that runs unchanged in Spark and in DuckDB, so queries and
their SQL start from the same rows. ``{name}`` refers to a table or a view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "sources": """
SELECT o_orderkey AS catalog_index,
  CAST(9.0000317 AS DOUBLE) + CAST((o_orderkey * 1299709) % 2000003 AS DOUBLE) / 1000000 AS ra,
  CAST(-1.0000173 AS DOUBLE) + CAST((o_orderkey * 15485863) % 2000003 AS DOUBLE) / 1000000 AS dec,
  CASE WHEN o_orderkey % 10 = 0 THEN 'PSF' ELSE 'SER' END AS type,
  CAST(16.0031 AS DOUBLE) + CAST((o_orderkey * 31) % 1201 AS DOUBLE) / 100 AS mag,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(1 + o_orderkey % 4 AS INT) END AS sim,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST((o_orderkey * 13) % 20 AS INT) ELSE CAST((o_orderkey * 13) % (SELECT CAST(floor(count(*) / 4) AS BIGINT) + 2 FROM {embeddings}) AS INT) END AS sed_index,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((o_orderkey * 17) % 90 AS DOUBLE) / 100 END AS half_light_radius,
  CASE WHEN o_orderkey % 10 = 0 THEN pow(CAST(10 AS DOUBLE), -0.4 * (CAST(16.0031 AS DOUBLE) + CAST((o_orderkey * 31) % 1201 AS DOUBLE) / 100)) ELSE CAST(1 AS DOUBLE) END AS flux_scale,
  CAST(o_custkey % 18 AS INT) AS src_group,
  CAST((o_orderkey * 7) % 300 AS DOUBLE) / 100 AS z_obs
FROM {orders}""",
    "spectra": """
SELECT vec_id, CAST(1 + vec_id % 4 AS INT) AS sim, CAST(floor(vec_id / 4) AS INT) AS sed_index, embedding FROM {embeddings}""",
    "pointings": """
SELECT n_nationkey AS pointing_id,
  CAST(9.21 AS DOUBLE) + n_nationkey * CAST(0.0613 AS DOUBLE) AS ra0,
  CAST(-0.79 AS DOUBLE) + n_nationkey * CAST(0.0647 AS DOUBLE) AS dec0,
  CAST((n_nationkey * 15) % 360 AS DOUBLE) AS pa,
  CASE WHEN n_nationkey % 5 = 0 THEN 'PRISM' ELSE 'GRISM' END AS bandpass,
  n_nationkey % 3 AS visit, n_nationkey % 7 AS exposure, CAST(190.22287 AS DOUBLE) AS exposure_time
FROM {nation}""",
    "visits": """
SELECT c_custkey AS pointing_id, CAST(9.21 AS DOUBLE) + CAST((c_custkey * 7919) % 20011 AS DOUBLE) / 10000 AS ra0, CAST(-0.79 AS DOUBLE) + CAST((c_custkey * 6367) % 15013 AS DOUBLE) / 10000 AS dec0,
  CAST((c_custkey * 15) % 360 AS DOUBLE) AS pa, CASE WHEN c_custkey % 5 = 0 THEN 'PRISM' ELSE 'GRISM' END AS bandpass, CAST(1 + c_custkey % 18 AS INT) AS sca, CAST(1.55 + (c_custkey % 7) * 0.001 AS DOUBLE) AS wl_ref
FROM {customer}""",
    "pixels": """
SELECT CAST(1 + l_suppkey % 18 AS INT) AS sca, CAST(l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
  sum(l_quantity) AS value_a, sum(l_quantity * (1 + l_discount / 1000)) AS value_b
FROM {lineitem} GROUP BY 1, 2, 3""",
    "residuals": """
SELECT l_orderkey AS catalog_index, CAST(1 + l_suppkey % 18 AS INT) AS sca,
  min((l_extendedprice - 50000) / 1000000) AS d_disp_old,
  min((l_extendedprice - 50000) / 1000000 + l_tax / 100) AS d_disp_new
FROM {lineitem} GROUP BY 1, 2""",
    "campaign_old": """
SELECT l_orderkey AS catalog_index, CAST(1 + l_suppkey % 18 AS INT) AS sca, CAST(l_linenumber % 3 AS INT) AS ord, CAST(l_partkey % 5 AS INT) AS line_id,
  min(l_extendedprice / 25) AS xsca, min(l_quantity * 80) AS ysca
FROM {lineitem} WHERE l_discount < 0.075 GROUP BY 1, 2, 3, 4""",
    "campaign_new": """
SELECT l_orderkey AS catalog_index, CAST(1 + l_suppkey % 18 AS INT) AS sca, CAST(l_linenumber % 3 AS INT) AS ord, CAST(l_partkey % 5 AS INT) AS line_id,
  min(l_extendedprice / 25 + l_tax) AS xsca, min(l_quantity * 80 - l_tax / 2) AS ysca
FROM {lineitem} WHERE l_discount > 0.015 GROUP BY 1, 2, 3, 4""",
    "calibration": """
SELECT CAST(n_nationkey + 1 AS INT) AS sca, ord, CAST(2044.5 AS DOUBLE) AS crpix, CAST(0.11 AS DOUBLE) AS pixel_scale, CAST(100.0 AS DOUBLE) AS plate_scale,
  (CAST(n_nationkey % 6 AS DOUBLE) - 2.5) * 44.0 AS xcen, (CAST(floor(n_nationkey / 6) AS DOUBLE) - 1.0) * 44.0 AS ycen,
  CASE ord WHEN '0' THEN 'log' ELSE 'linear' END AS kind, CAST(1.55 AS DOUBLE) AS wl_ref,
  CAST(0.001 AS DOUBLE) * n_nationkey AS x00, CAST(327.272727 AS DOUBLE) AS x10, CAST(0.02 AS DOUBLE) AS x01, CAST(0.5 AS DOUBLE) AS x11,
  CASE ord WHEN '1' THEN CAST(0.1 AS DOUBLE) WHEN '2' THEN CAST(-3.0 AS DOUBLE) ELSE CAST(4.0 AS DOUBLE) END AS y00, CAST(0.03 AS DOUBLE) AS y10, CAST(327.272727 AS DOUBLE) AS y01, CAST(0.4 AS DOUBLE) AS y11,
  CAST(0.0 AS DOUBLE) AS c0, CAST(0.002 AS DOUBLE) AS c1, CAST(0.0003 AS DOUBLE) AS c2, CAST(0.001 AS DOUBLE) AS cx,
  CAST(0.0 AS DOUBLE) AS d0, CASE ord WHEN '1' THEN CAST(9.0 AS DOUBLE) WHEN '2' THEN CAST(18.0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS d1, CAST(0.05 AS DOUBLE) AS d2, CAST(0.01 AS DOUBLE) AS dx
FROM {nation}, (VALUES ('0'), ('1'), ('2')) AS o(ord) WHERE n_nationkey < 18""",
    "lines": """
SELECT CAST(line_id AS BIGINT) AS line_id, CAST(center_a AS DOUBLE) AS center_a, CAST(10 AS DOUBLE) AS fwhm_a, CAST(amp AS DOUBLE) AS amp_rel
FROM (VALUES (0, 11000, 5), (1, 12500, 6), (2, 15500, 8), (3, 17000, 9), (4, 19000, 10)) AS l(line_id, center_a, amp)""",
    "grid": """
SELECT DISTINCT CAST(l_orderkey % 64 AS INT) AS i, CAST(9000 + 200 * (l_orderkey % 64) AS DOUBLE) AS wavelength FROM {lineitem}""",
    "bandpass": """
SELECT i, wavelength, CASE WHEN wavelength <= 13800 OR wavelength >= 17700 THEN CAST(0 AS DOUBLE) WHEN wavelength < 14200 THEN (wavelength - 13800) / 400
  WHEN wavelength > 17300 THEN (17700 - wavelength) / 400 ELSE CAST(1 AS DOUBLE) END AS transmission FROM {grid}""",
    "sensitivity": """
SELECT sca, ord, i, wavelength, greatest(CAST(0 AS DOUBLE), 1 - abs(wavelength - 14500) / 6500) * (1 + CAST(sca AS DOUBLE) / 100)
  * CASE ord WHEN '1' THEN CAST(1 AS DOUBLE) WHEN '0' THEN CAST(0.02 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END AS sens
FROM {calibration}, {grid}""",
    "manifest": """
SELECT catalog_index, CAST(1 + catalog_index % 18 AS INT) AS sca, CAST(CAST(floor(catalog_index / 18) AS BIGINT) % 3 AS VARCHAR(1)) AS ord, type, ra, dec, flux_scale, mag, sim, src_group,
  CAST((catalog_index * 7919) % 4600003 AS DOUBLE) / 1000 - 255.9997 AS xsca, CAST((catalog_index * 104729) % 4600003 AS DOUBLE) / 1000 - 255.9997 AS ysca
FROM {sources}""",
    "placements": """
SELECT catalog_index, CAST(1 + (catalog_index + 7 * k) % 18 AS INT) AS sca, ord, xsca + CAST(3.5 AS DOUBLE) * k AS xsca, ysca - CAST(2.25 AS DOUBLE) * k AS ysca
FROM {manifest}, (VALUES (0), (1), (2)) AS v(k)""",
    "log_lines": """
SELECT user_id AS file_id, event_id AS line_no, event_type, value, event_id % 18 + 1 AS sca FROM {events}""",
    "bench": """
SELECT l_returnflag AS ord, l_linestatus AS variant, l_extendedprice AS ms, l_shipdate AS run FROM {lineitem}""",
    "cells": """
SELECT catalog_index, CAST((catalog_index * 48271) % 196608 AS BIGINT) AS pix, CAST((catalog_index * 48271) % 196608 AS BIGINT) % 3 AS half, sim, sed_index FROM {sources}""",
}


#: Views of unnested arrays, for which the two dialects differ: (Spark's select expressions over a table, DuckDB's query).
UNNESTED = {
    "curves": (
        "embeddings",
        ["vec_id AS curve", "posexplode(embedding) AS (i, f)"],
        ["curve", "i", "CAST(9000 + 200 * i AS DOUBLE) AS wavelength", "abs(CAST(f AS DOUBLE)) AS sens"],
        "SELECT curve, i, CAST(9000 + 200 * i AS DOUBLE) AS wavelength, abs(CAST(f AS DOUBLE)) AS sens FROM (SELECT vec_id AS curve, CAST(unnest(range(0, len(embedding))) AS INT) AS i, unnest(embedding) AS f FROM {embeddings})",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in UNNESTED:
        table, rows, columns, _ = UNNESTED[name]
        return view(spark, sf_dir, table).selectExpr(*rows).selectExpr(*columns)
    text = VIEWS[name]
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{u: view(spark, sf_dir, u) for u in used})


def with_views(sql: str) -> str:
    """SQL for DuckDB: ``{name}`` of views become common table expressions before it."""
    order: list[str] = []
    texts = VIEWS | {n: u[-1] for n, u in UNNESTED.items()}

    def need(text: str) -> None:
        for u in re.findall(r"\{(\w+)\}", text):
            if u in texts and u not in order:
                need(texts[u])
                order.append(u)

    need(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = ", ".join(f"{u} AS ({plain(texts[u])})" for u in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
