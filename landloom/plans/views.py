"""Cadastral tables derived from the test tables. Each SQL text runs unchanged in Spark and DuckDB."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rings import rect_rings

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]



def bend(x: str, y: str) -> str:
    """A thin-plate surface over the corners of a 1200 x 900 sheet, whose weights have no moments."""
    def at(sign, a, b):
        r2 = f"(({x} - {a}) * ({x} - {a}) + ({y} - {b}) * ({y} - {b}))"
        return f"{sign} CASE WHEN {r2} > 0 THEN 5e-1 * {r2} * ln({r2}) ELSE 0e0 END"
    return "2e-5 * (" + " ".join(at(*c) for c in (("", "0e0", "0e0"), ("-", "1.2e3", "0e0"), ("+", "1.2e3", "9e2"), ("-", "0e0", "9e2"))) + ")"


def bent(x: str, y: str) -> tuple[str, str]:
    """Where the known spline takes a place of a sheet."""
    return (f"1.02e0 * {x} - 3.0e-2 * {y} + 1.2e1 + {bend(x, y)}", f"3.0e-2 * {x} + 9.8e-1 * {y} - 7.0e0 - {bend(x, y)}")


VIEW_SQL = {
    "parcels": """
SELECT i AS parcel_id, CASE WHEN i % 7 = 0 THEN concat(CAST(100 + i AS STRING), '/1') ELSE CAST(100 + i AS STRING) END AS khasra_no,
  owner_name, village, concat(village, ' T', CAST(i % 3 AS STRING)) AS tehsil, district, alignment_status, alignment_confidence,
  x0, y0, x0 + 1.0e-3 AS x1, y0 + 1.0e-3 AS y1
FROM (SELECT c.c_custkey AS i, c.c_name AS owner_name, n.n_name AS village, r.r_name AS district,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'DRAFT' WHEN 'BUILDING' THEN 'ALIGNED_DRAFT' WHEN 'FURNITURE' THEN 'TOPOLOGY_CLEANED'
    WHEN 'HOUSEHOLD' THEN 'ULPIN_ASSIGNED' ELSE 'PUBLISHED' END AS alignment_status,
  round((c.c_acctbal + 1.0e3) / 1.1e4, 6) AS alignment_confidence,
  80.9010e0 + (c.c_custkey % 40) * 1.0e-3 + CASE WHEN c.c_custkey % 5 = 1 THEN -4.5e-7 WHEN c.c_custkey % 5 = 3 THEN 2.7e-7 ELSE 0e0 END AS x0,
  26.7605e0 + floor(c.c_custkey / 40) * 1.2e-3 AS y0
 FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey) t""",
    "approvals": """
SELECT o_orderkey AS approval_id, o_custkey AS parcel_id, concat('patwari_', CAST(o_orderkey % 9 AS STRING)) AS requested_by,
  CASE WHEN o_orderkey % 11 = 0 THEN 'revision_requested' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS status,
  o_orderdate AS requested_at, o_orderpriority AS remarks FROM {orders}""",
    "gcps": """
SELECT l_suppkey AS sheet_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS gcp_id,
  l_quantity * 2.0e1 AS sx, (l_partkey % 1000) * 1.0e0 AS sy,
  1.02e0 * (l_quantity * 2.0e1) - 3.0e-2 * (l_partkey % 1000) + 1.2e1 + l_tax AS tx,
  3.0e-2 * (l_quantity * 2.0e1) + 9.8e-1 * (l_partkey % 1000) - 7.0e0 - l_discount AS ty FROM {lineitem}""",
    # Control points on the known spline: those above, and the corners of every sheet.
    "spline_gcps": f"""
SELECT sheet_id, gcp_id, sx, sy, {bent("sx", "sy")[0]} AS tx, {bent("sx", "sy")[1]} AS ty FROM (
 SELECT l_suppkey AS sheet_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS gcp_id, l_quantity * 2.0e1 AS sx, (l_partkey % 1000) * 1.0e0 AS sy FROM {{lineitem}}
 """ + " ".join(f"UNION ALL SELECT s_suppkey, 'corner {i}', {x}, {y} FROM {{supplier}}" for i, (x, y) in enumerate((("0e0", "0e0"), ("1.2e3", "0e0"), ("1.2e3", "9e2"), ("0e0", "9e2")))) + ") t",
    "survey_events": """
SELECT event_id, ts, user_id AS parcel_id, user_id % 10 AS batch_id,
  CASE event_type WHEN 'view' THEN 'DRAFT_PUT' WHEN 'click' THEN 'DRAFT_DISCARD' WHEN 'signup' THEN 'SUBMIT' WHEN 'purchase' THEN 'APPROVE' ELSE 'FAIL' END AS action, value FROM {events}""",
    "descriptors": """
SELECT vec_id, label AS sheet_id, CASE WHEN vec_id % 2 = 0 THEN 'src' ELSE 'tgt' END AS side, embedding FROM {embeddings}""",
    "pixels": """
SELECT l_suppkey AS tile_id, l_orderkey * 10 + l_linenumber AS px_id, CAST((l_partkey * 7) % 256 AS INT) AS r, CAST((l_orderkey * 13) % 256 AS INT) AS g,
  CAST((l_partkey + l_orderkey * 3) % 256 AS INT) AS b, l_linestatus = 'O' AS in_mask FROM {lineitem}""",
    # Plots drawn on a sheet: one per line of an order, as pixel boxes on a 1200 x 900 canvas.
    "plots": """
SELECT l_suppkey AS sheet_id, (l_orderkey * 10 + l_linenumber) * 1000000000 + CAST(round(l_extendedprice * 1.0e2) AS BIGINT) AS plot_no, CAST((l_partkey * 37) % 1150 AS DOUBLE) AS x, CAST((l_orderkey * 17 + l_linenumber * 101) % 850 AS DOUBLE) AS y,
  CAST(12 + l_partkey % 60 AS DOUBLE) AS bw, CAST(10 + l_orderkey % 50 AS DOUBLE) AS bh,
  l_extendedprice / 4.0e1 AS area_px, CAST(3 + l_linenumber % 4 AS INT) AS n_vertices,
  round(5.0e1 + l_quantity - 2.0e2 * l_discount, 1) AS confidence_score, l_extendedprice / 2.0e1 AS area_sqm,
  CASE WHEN l_returnflag = 'A' THEN 'green' WHEN l_returnflag = 'R' THEN 'red' ELSE 'orange' END AS status_color FROM {lineitem}""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in (names or TABLES)}


def _used(sql: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in sql]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEW_SQL[name]
    return spark.sql(sql, **load(spark, sf_dir, *_used(sql)))


def oracle_view(name: str) -> str:
    return VIEW_SQL[name].format(**{t: t for t in TABLES})


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind a WITH list that defines the named views."""
    parts = [f"{n} AS ({oracle_view(n)})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with rings and box columns; the rectangle corners stay for the oracle twins."""
    p = view(spark, sf_dir, "parcels")
    return p.select("*", rect_rings("x0", "y0", "x1", "y1").alias("rings"), F.col("x0").alias("minx"),
                    F.col("y0").alias("miny"), F.col("x1").alias("maxx"), F.col("y1").alias("maxy"))
