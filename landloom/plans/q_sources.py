"""Readers and writers over documents that Spark derives from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions import scores as S
from ..operators import relational as RL
from ..sources import readers as RD
from ..session import run_dir
from ..sources import writers as WR
from .registry import query
from .views import load, parcels, view, with_views

PER_DOC = 50


def _document(df, key, order, text, head, tail, sep=","):
    """One document per key from its ordered pieces; keys hold a bounded number of rows by construction."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"])
    return df.groupBy(key).agg(F.concat(F.lit(head), F.array_join(pieces, sep), F.lit(tail)).alias("value"))


def layer_documents(spark, d):
    """Feature collections of fifty parcels: some named by khasra_no, some by id, some not at all;
    some multipolygons; some with too short a ring."""
    p, i = parcels(spark, d), F.col("parcel_id")
    ring = R.geojson_coordinates(F.when(i % 25 == 24, F.transform(F.col("rings"), lambda r: F.slice(r, 1, 2))).otherwise(F.col("rings")))
    props = F.struct(F.when((i % 3 != 0) & (i % 10 != 0), F.col("khasra_no")).alias("khasra_no"), F.when((i % 3 == 0) & (i % 10 != 0), F.concat(F.lit("id"), i.cast("string"))).alias("id"),
                     F.when(i % 2 == 0, i + 0.5).alias("area_sqm"), F.col("owner_name"))
    one = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry")))
    many = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))
    rows = p.select(F.floor(i / PER_DOC).alias("doc"), i.alias("i"), F.when(i % 4 == 1, many).otherwise(one).alias("t"))
    docs = _document(rows, "doc", ["i"], "t", '{"type":"FeatureCollection","features":[', "]}")
    return docs.select(F.concat(F.lit("/layers/sheet_"), F.col("doc").cast("string"), F.lit(".geojson")).alias("path"), "doc", "value")


@query("s1_read_geojson", with_views("""SELECT concat('/layers/sheet_', CAST(CAST(floor(parcel_id / 50) AS BIGINT) AS VARCHAR), '.geojson') AS path, CAST(parcel_id % 50 AS INT) AS feature_no,
 CASE WHEN parcel_id % 10 = 0 THEN CAST(101 + parcel_id % 50 AS VARCHAR) WHEN parcel_id % 3 = 0 THEN concat('id', CAST(parcel_id AS VARCHAR)) ELSE khasra_no END AS khasra_no,
 CASE WHEN parcel_id % 2 = 0 THEN parcel_id + 0.5e0 ELSE 145e1 END AS area_sqm, round(x0, 9) AS minx, round(y1, 9) AS maxy, owner_name FROM parcels WHERE parcel_id % 25 <> 24""", "parcels"))
def s1(spark, d):
    p = RD.parse_geojson(layer_documents(spark, d)).select("*", R.bbox(F.col("rings")).alias("b"))
    return p.select("path", "feature_no", "khasra_no", "area_sqm", F.round("b.minx", 9).alias("minx"), F.round("b.maxy", 9).alias("maxy"), F.col("legacy_props")["owner_name"].alias("owner_name"))


@query("s2_profile_layers", with_views("""WITH k AS (SELECT CAST(floor(parcel_id / 50) AS BIGINT) AS doc, count(*) AS n FROM parcels GROUP BY 1)
SELECT CASE WHEN doc % 5 = 4 THEN concat('/layers/sheet_', CAST(doc AS VARCHAR), '.geojson.png') ELSE concat('/layers/sheet_', CAST(doc AS VARCHAR), '.geojson') END AS path,
 CASE WHEN doc % 5 <> 4 AND doc % 7 <> 3 THEN 'GeoJSON' END AS type, CASE WHEN doc % 5 <> 4 AND doc % 7 <> 3 THEN n END AS features_count, CASE WHEN doc % 5 <> 4 THEN doc % 7 <> 3 END AS parsed_successfully FROM k""", "parcels"))
def s2(spark, d):
    k = F.col("doc")
    docs = layer_documents(spark, d).select(F.when(k % 5 == 4, F.concat("path", F.lit(".png"))).otherwise(F.col("path")).alias("path"),
                                            F.when(k % 7 == 3, F.concat(F.lit("{"), "value")).otherwise(F.col("value")).alias("value"))
    return RD.profile_documents(docs).select("path", "type", F.col("features_count").cast("bigint").alias("features_count"), "parsed_successfully")


@query("s3_profile_rasters", with_views("""SELECT CAST(floor(parcel_id / 50) AS BIGINT) AS doc, CASE WHEN floor(parcel_id / 50) % 7 <> 3 THEN CAST(count(*) AS INT) END AS width,
 CASE WHEN floor(parcel_id / 50) % 7 <> 3 THEN CAST(1 + floor(parcel_id / 50) % 3 AS INT) END AS height,
 CASE WHEN floor(parcel_id / 50) % 7 <> 3 THEN CASE WHEN floor(parcel_id / 50) % 2 = 0 THEN 3 ELSE 1 END END AS channels FROM parcels GROUP BY floor(parcel_id / 50)""", "parcels"))
def s3(spark, d):
    # A picture of each fifty parcels, a pixel a parcel, in lines of grey or colour; some files are no pictures.
    i, k = F.col("parcel_id"), F.col("doc")
    value = (i % 256).cast("string")
    rows = parcels(spark, d).select(F.floor(i / PER_DOC).alias("doc"), "parcel_id", F.when(F.floor(i / PER_DOC) % 2 == 0, F.concat_ws(" ", value, value, value)).otherwise(value).alias("t"))
    docs = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parcel_id", "t"))), lambda s: s["t"]), " ").alias("line"), F.count("*").alias("w"))
    h = 1 + k % 3
    head = F.concat(F.when(k % 7 == 3, "Q").otherwise("P"), F.when(k % 2 == 0, "3").otherwise("2"), F.lit("\n# parcels\n"), F.col("w").cast("string"), F.lit(" "), h.cast("string"), F.lit("\n255"))
    folder = run_dir(spark, "pictures")
    docs.select("doc", F.concat_ws("\n", head, F.array_join(F.array_repeat("line", h.cast("int")), "\n")).alias("value")).write.partitionBy("doc").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return RD.profile_raster_headers(files).select(F.regexp_extract("path", r"/doc=(\d+)/", 1).cast("bigint").alias("doc"), "width", "height", "channels")


@query("s4_decode_geometry", with_views("""SELECT parcel_id, CASE WHEN parcel_id % 11 = 0 THEN 0 WHEN parcel_id % 5 = 4 THEN -1 WHEN parcel_id % 5 = 3 THEN 2 ELSE 1 END AS n_parts,
 CASE WHEN parcel_id % 11 <> 0 AND parcel_id % 5 <> 4 THEN x0 END AS first_x, CASE WHEN parcel_id % 11 <> 0 AND parcel_id % 5 <> 4 THEN y1 END AS third_y, parcel_id % 11 <> 0 AND parcel_id % 5 = 4 AS failed FROM parcels""", "parcels"))
def s4(spark, d):
    p, i = parcels(spark, d), F.col("parcel_id")
    js = F.to_json(F.struct(F.lit("Polygon").alias("type"), R.geojson_coordinates(F.col("rings")).alias("coordinates")))
    ring = F.array_join(F.transform(F.col("rings")[0], lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ", ")
    wkt = F.concat(F.lit("POLYGON (("), ring, F.lit("))"))
    multi = F.concat(F.lit("SRID=4326;MULTIPOLYGON ((("), ring, F.lit(")), (("), ring, F.lit(")))"))
    text = F.when(i % 11 == 0, F.lit(None)).when(i % 5 == 0, js).when(i % 5 == 1, wkt).when(i % 5 == 2, F.concat(F.lit(" SRID=4326;"), wkt)).when(i % 5 == 3, multi).otherwise(F.lit("LINESTRING (0 0, 1 1)"))
    g = RD.decode_geometry(p.select("parcel_id", text.alias("geometry")))
    first = F.get(F.col("rings"), F.lit(0))
    return g.select("parcel_id", F.coalesce(F.size("parts"), F.lit(-1)).alias("n_parts"), F.get(first, F.lit(0))["x"].alias("first_x"), F.get(first, F.lit(2))["y"].alias("third_y"), F.col("error").isNotNull().alias("failed"))


GCP_FORMS = """g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 2e1 AS sx, (l_partkey % 1000) * 1e0 AS sy, l_quantity * 2e1 + 5e0 AS tx, (l_partkey % 1000) - 3e0 AS ty FROM lineitem)"""


def gcp_documents(spark, d):
    """Control-point files of an order each, every point written in one of four styles."""
    g = load(spark, d, "lineitem")["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") * 20.0).alias("sx"), (F.col("l_partkey") % 1000).cast("double").alias("sy"))
    g = g.withColumn("tx", F.col("sx") + 5.0).withColumn("ty", F.col("sy") - 3.0)

    def pair(x, y):
        return F.array(F.col(x), F.col(y))

    def lnglat(x, y):
        return F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))

    k = F.col("l_linenumber") % 4
    a = F.to_json(F.struct(F.lit("a").alias("name"), lnglat("sx", "sy").alias("source"), lnglat("tx", "ty").alias("target")))
    b = F.to_json(F.struct(F.lit("b").alias("name"), F.col("sx").alias("source_x"), F.col("sy").alias("source_y"), F.col("tx").alias("target_x"), F.col("ty").alias("target_y")))
    c = F.to_json(F.array(pair("sx", "sy"), pair("tx", "ty")))
    e = F.to_json(F.struct(F.lit("d").alias("name"), F.array(26.0 + F.col("sy") * 1e-3, 80.0 + F.col("sx") * 1e-3).alias("legacy"), F.array(F.col("tx")).alias("drone")))
    rows = g.withColumn("t", F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(e))
    return _document(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "t", "[", "]").select(F.col("l_orderkey").cast("string").alias("path"), "value")


@query("s5_read_gcps", "WITH " + GCP_FORMS + """, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS gcp_no, l_linenumber % 4 IN (1, 2) AS p FROM g)
SELECT CAST(l_orderkey AS VARCHAR) AS path, gcp_no, CASE l_linenumber % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS name,
 CASE WHEN p AND sx BETWEEN 5 AND 40 AND sy BETWEEN 60 AND 100 THEN sy ELSE sx END AS sx, CASE WHEN p AND sx BETWEEN 5 AND 40 AND sy BETWEEN 60 AND 100 THEN sx ELSE sy END AS sy,
 CASE WHEN p AND tx BETWEEN 5 AND 40 AND ty BETWEEN 60 AND 100 THEN ty ELSE tx END AS tx, CASE WHEN p AND tx BETWEEN 5 AND 40 AND ty BETWEEN 60 AND 100 THEN tx ELSE ty END AS ty FROM n WHERE l_linenumber % 4 <> 3""")
def s5(spark, d):
    return RD.parse_gcps(gcp_documents(spark, d)).drop("error_m")


def svg_documents(spark, d):
    li = load(spark, d, "lineitem")["lineitem"]
    w, h = 12 + F.col("l_partkey") % 60, 10 + F.col("l_orderkey") % 50
    x, y = F.col("l_partkey") * 37 % 1150, F.col("l_linenumber") * 101 % 850

    def at(a, b):
        return F.concat(a.cast("string"), F.lit(","), b.cast("string"))

    pts = F.concat_ws(" ", at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     F.concat(F.lit('<polygon class="plot" points="'), pts, F.lit('" fill="none"/><!-- <polygon points="0,0 90,0 90,90"/> -->')).alias("t"))
    return _document(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "t", '<svg xmlns="http://www.w3.org/2000/svg">', "</svg>", "\n").select(
        F.col("l_orderkey").cast("string").alias("path"), "value")


@query("s6_read_svg_polygons", """WITH b AS (SELECT *, (12 + l_partkey % 60) * (10 + l_orderkey % 50) AS a FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS VARCHAR) AS plot_id,
 CAST(a AS DOUBLE) AS area_px, round(a * 0.12e0 * 12e0, 1) AS area_sqm FROM b WHERE a > 400""")
def s6(spark, d):
    return RD.parse_svg_polygons(svg_documents(spark, d)).select("path", "plot_id", "area_px", "area_sqm")


@query("s7_generate_parcels", """SELECT c_custkey AS i, 'sheet' AS layout, round(80.901e0 + c_custkey % 6 * 0.0014e0, 9) AS minx, round(26.7605e0 + floor(c_custkey / 6) * 0.0011e0, 9) AS miny FROM customer
UNION ALL SELECT c_custkey, 'defects', round(80.9451e0 + c_custkey % 5 * 0.0002e0 + CASE WHEN c_custkey % 5 >= 1 THEN -4.5e-7 ELSE 0e0 END + CASE WHEN c_custkey % 5 >= 3 THEN 2.7e-7 ELSE 0e0 END, 9), round(26.8467e0 + floor(c_custkey / 5) * 0.0004e0, 9) FROM customer
UNION ALL SELECT c_custkey, 'jitter', round(80.901e0 + floor(c_custkey / 4) * 0.0012e0 - 0.000024e0, 9), round(26.7605e0 + c_custkey % 4 * 0.0012e0, 9) FROM customer""")
def s7(spark, d):
    ids = load(spark, d, "customer")["customer"].select(F.col("c_custkey").alias("i"))
    out = None
    for layout in ("sheet", "defects", "jitter"):
        g = RD.generate_parcels(ids, layout).select("i", F.lit(layout).alias("layout"), F.round("minx", 9).alias("minx"), F.round("miny", 9).alias("miny"))
        out = g if out is None else out.unionByName(g)
    return out


@query("s8_write_geojson", with_views("""SELECT parcel_id, khasra_no, 'Feature' AS type, CAST(parcel_id AS VARCHAR) AS id, x1 AS second_x, alignment_confidence, TRUE AS null_kept FROM parcels""", "parcels"))
def s8(spark, d):
    p = parcels(spark, d).withColumns({c: F.lit(None).cast(t) for c, t in (("ulpin", "string"), ("area_sqm", "double"), ("centroid_lat", "double"), ("centroid_lon", "double"))})
    folder = run_dir(spark, "features")
    WR.write_geojson(WR.parcel_features(p), folder)
    back = F.from_json("value", "type string, geometry struct<coordinates:array<array<array<double>>>>, properties struct<id:string,khasra_no:string,alignment_confidence:double>")
    f = spark.read.text(folder).select(back.alias("f"), F.col("value").contains('"ulpin":null').alias("null_kept"))
    return f.select(F.col("f.properties.id").cast("bigint").alias("parcel_id"), "f.properties.khasra_no", "f.type", "f.properties.id",
                    F.col("f.geometry.coordinates")[0][1][0].alias("second_x"), "f.properties.alignment_confidence", "null_kept")


@query("s8_write_aligned_layer", with_views("""SELECT sheet_id, plot_no, CASE WHEN confidence_score >= 85 THEN 'VERIFIED_CLEAR' WHEN confidence_score >= 60 THEN 'OCCLUDED' ELSE 'GOVT_ILLEGAL' END AS computed,
 CASE WHEN n_vertices = 5 THEN 'LEGACY' WHEN confidence_score >= 85 THEN 'VERIFIED_CLEAR' WHEN confidence_score >= 60 THEN 'OCCLUDED' ELSE 'GOVT_ILLEGAL' END AS merged FROM plots""", "plots"))
def s8b(spark, d):
    p = view(spark, d, "plots").withColumns({
        "plot_id": F.col("plot_no").cast("string"), "confidence_band": S.band(F.col("confidence_score")), "situation": F.lit(""), "reason": F.lit(""), "iou_score": F.lit(0.5),
        "rings": R.rect_rings(F.col("x"), F.col("y"), F.col("x") + F.col("bw"), F.col("y") + F.col("bh")),
        "legacy_props": F.when(F.col("n_vertices") == 5, F.create_map(F.lit("alignment_status"), F.lit("LEGACY")))})

    def status(last_wins, name):
        return WR.aligned_features(p, last_wins).select("sheet_id", F.col("plot_id").cast("bigint").alias("plot_no"), F.get_json_object("value", "$.properties.alignment_status").alias(name))

    return status(False, "computed").join(status(True, "merged"), ["sheet_id", "plot_no"])


@query("s9_write_summary", with_views("""WITH s AS (SELECT sheet_id, count(*) AS total_plots, count(*) FILTER (confidence_score >= 85) AS plots_high_confidence, count(*) FILTER (confidence_score >= 60 AND confidence_score < 85) AS plots_medium_confidence,
 count(*) FILTER (confidence_score < 60) AS plots_flagged_red, round(sum(area_sqm), 2) AS total_area_sqm FROM plots GROUP BY sheet_id)
SELECT s_suppkey AS sheet_id, coalesce(total_plots, 0) AS total_plots, coalesce(plots_high_confidence, 0) AS plots_high_confidence, coalesce(plots_medium_confidence, 0) AS plots_medium_confidence, coalesce(plots_flagged_red, 0) AS plots_flagged_red, total_area_sqm,
 round(CAST(s_suppkey % 50 AS DOUBLE) / greatest(1, s_suppkey % 60), 4) AS inlier_ratio FROM supplier LEFT JOIN s ON s_suppkey = sheet_id""", "plots"))
def s9(spark, d):
    k = F.col("s_suppkey")
    sheets = load(spark, d, "supplier")["supplier"].select(k.alias("sheet_id"), (k % 50).alias("inliers"), (k % 60).alias("matches"), F.lit(2.0).alias("rmse_px"))
    p = view(spark, d, "plots").withColumn("confidence_band", S.band(F.col("confidence_score")))
    summary, folder = WR.sheet_summary(p, sheets), run_dir(spark, "summary")
    WR.write_summary(summary, folder)
    return spark.read.schema(summary.schema).json(folder).select("sheet_id", "total_plots", "plots_high_confidence", "plots_medium_confidence", "plots_flagged_red",
                                             F.round("total_area_sqm", 2).alias("total_area_sqm"), "inlier_ratio")


@query("s10_pair_layers_with_gcps", """WITH k AS (SELECT c_custkey AS k FROM customer)
SELECT concat('/in/layer_', CAST(k AS VARCHAR), '.geojson') AS path, CASE WHEN k % 3 = 0 THEN concat('/gcp/layer_', CAST(k AS VARCHAR), '_gcps.json') WHEN k % 3 = 1 THEN concat('/gcp/layer_', CAST(k AS VARCHAR), '_gcp.json')
 WHEN contains(CAST(k AS VARCHAR), '77') THEN '/gcp/special.json' END AS gcp_path FROM k""")
def s10(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer")["customer"]
    name = F.concat(F.lit("layer_"), k.cast("string"))
    layers = c.select(F.concat(F.lit("/in/"), name, F.lit(".geojson")).alias("path"))
    one = c.filter(k % 3 == 0).select(F.concat(F.lit("/gcp/"), name, F.lit("_gcps.json")).alias("path"))
    two = c.filter(k % 3 != 2).select(F.concat(F.lit("/gcp/"), name, F.lit("_gcp.json")).alias("path"))
    sets = one.union(two).union(RL.limit_n(c, 1, "c_custkey").select(F.lit("/gcp/special.json").alias("path")))
    return RD.pair_layers_with_gcps(layers, sets, [("77", "special.json")])
