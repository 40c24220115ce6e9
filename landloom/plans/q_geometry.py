"""Scalar geometry, codes, scores, projections, spatial joins and topology."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import projection as P
from ..functions import rings as R
from ..functions import scores as S
from ..functions import status as ST
from ..operators import aggregates as A
from ..operators import arrangement as AR
from ..operators import spatial as SP
from ..operators import topology as T
from ..operators import validation as VA
from .registry import query
from .views import load, parcels, view, with_views


def base14_sql(value: str, name: str) -> str:
    """Seven-digit base-14 expansion as reusable DuckDB column aliases; the code is ``<name>``."""
    cols, v = [], value
    for k in range(1, 8):
        cols += [f"({v}) * 14e0 AS {name}s{k}", f"least(floor({name}s{k}), 13e0) AS {name}d{k}", f"{name}s{k} - {name}d{k} AS {name}v{k}"]
        v = f"{name}v{k}"
    digits = " || ".join(f"substr('0123456789ABCD', CAST({name}d{k} AS INT) + 1, 1)" for k in range(1, 8))
    return ", ".join(cols) + f", {digits} AS {name}"


def ulpin_sql(lat: str, lon: str) -> str:
    return (f"greatest(0e0, least(({lat} + 9e1) / 18e1, 0.999999999e0)) AS ulat, greatest(0e0, least(({lon} + 18e1) / 36e1, 0.999999999e0)) AS ulon, "
            + base14_sql("ulat", "ca") + ", " + base14_sql("ulon", "co") + ", translate(ca || co, '10', 'YZ') AS ulpin")


@query("f1_encode_base14", with_views("WITH c AS (SELECT parcel_id, alignment_confidence, " + base14_sql("alignment_confidence", "code") + " FROM parcels) SELECT parcel_id, code FROM c", "parcels"))
def f1(spark, d):
    return view(spark, d, "parcels").select("parcel_id", C.encode_base14(F.col("alignment_confidence")).alias("code"))


@query("f2_ulpin", with_views("WITH c AS (SELECT parcel_id, " + ulpin_sql("y0", "x0") + " FROM parcels) SELECT parcel_id, ulpin FROM c", "parcels"))
def f2(spark, d):
    return view(spark, d, "parcels").select("parcel_id", C.ulpin(F.col("y0"), F.col("x0")).alias("ulpin"))


DEG_AREA = "(x1 - x0) * (y1 - y0)"


def area_sql(deg=DEG_AREA, lat="(y0 + y1) / 2"):
    return f"round({deg} * 111320e0 * (111320e0 * cos(radians({lat}))), 2)"


@query("f3_area_sqm", with_views(f"""SELECT parcel_id, {area_sql()} AS area_centroid, round({DEG_AREA} * 111320e0 * (111320e0 * 0.89e0), 2) AS area_registration,
 round({DEG_AREA} * 111319.5e0 * (111319.5e0 * cos(radians((y0 + y1) / 2))), 2) AS area_screen FROM parcels""", "parcels"))
def f3(spark, d):
    return parcels(spark, d).select("parcel_id", R.area_sqm(F.col("rings")).alias("area_centroid"), R.area_sqm(F.col("rings"), "registration").alias("area_registration"),
                                    R.area_sqm(F.col("rings"), "screen").alias("area_screen"))


def boxes(spark, d):
    return view(spark, d, "plots").withColumn("rings", R.rect_rings(F.col("x"), F.col("y"), F.col("x") + F.col("bw"), F.col("y") + F.col("bh")))


@query("f4_area_px", with_views("SELECT sheet_id, plot_no, round(bw * bh, 4) AS px, round(bw * bh * 0.24e0, 4) AS sqm FROM plots", "plots"))
def f4(spark, d):
    a = R.area_px(F.col("rings")[0])
    return boxes(spark, d).select("sheet_id", "plot_no", F.round(a, 4).alias("px"), F.round(R.area_px(F.col("rings")[0], R.CANVAS_SQM_PER_PX), 4).alias("sqm"))


@query("f5_centroid", with_views("""SELECT parcel_id, round((y0 + y1) / 2, 6) AS lat, round((x0 + x1) / 2, 6) AS lon,
 round((3 * y0 + 2 * y1) / 5, 9) AS mean_lat, round((3 * x0 + 2 * x1) / 5, 9) AS mean_lon FROM parcels""", "parcels"))
def f5(spark, d):
    c, m = R.centroid(F.col("rings")), R.vertex_mean(F.col("rings")[0])
    return parcels(spark, d).select("parcel_id", F.round(c["y"], 6).alias("lat"), F.round(c["x"], 6).alias("lon"),
                                    F.round(m["y"], 9).alias("mean_lat"), F.round(m["x"], 9).alias("mean_lon"))


@query("f10_to_web_mercator", with_views("""SELECT parcel_id, round(x0 * 20037508.342789244e0 / 18e1, 4) AS mx, round(ln(tan(pi() / 4 + radians(y0) / 2)) * 20037508.342789244e0 / pi(), 4) AS my,
 round(x1, 6) AS lon, round(y1, 6) AS lat FROM parcels""", "parcels"))
def f10(spark, d):
    p = parcels(spark, d).select("parcel_id", P.to_web_mercator(F.col("rings")).alias("m"))
    p = p.select("parcel_id", "m", P.to_wgs84(F.col("m")).alias("back"))
    return p.select("parcel_id", F.col("m")[0][0]["x"].alias("mx"), F.col("m")[0][0]["y"].alias("my"),
                    F.round(F.col("back")[0][2]["x"], 6).alias("lon"), F.round(F.col("back")[0][2]["y"], 6).alias("lat"))


@query("f11_geo_pixel", with_views("""SELECT parcel_id, round((x0 - 809e-1) * 1e4, 5) AS px, round(2047 - (y0 - 267e-1) * 1e4, 5) AS py,
 round((x0 - 809e-1) / 1e0 * 2047, 5) AS bx, round((1 - (y0 - 267e-1) / 1e0) * 2047, 5) AS by_,
 round(x0, 9) AS lon, round(y0, 9) AS lat FROM parcels""", "parcels"))
def f11(spark, d):
    x, y = F.col("x0"), F.col("y0")
    o = (F.lit(80.9), F.lit(26.7), F.lit(1.0e4), F.lit(1.0e4), F.lit(2048))
    px, py = P.geo_to_pixel(x, y, *o)
    lon, lat = P.pixel_to_geo(F.col("px"), F.col("py"), *o)
    bx, by = P.bounds_to_pixel(x, y, F.lit(80.9), F.lit(81.9), F.lit(26.7), F.lit(27.7), F.lit(2048), F.lit(2048))
    q = view(spark, d, "parcels").select("parcel_id", px.alias("px"), py.alias("py"), bx.alias("bx"), by.alias("by_"))
    return q.select("parcel_id", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), F.round("bx", 5).alias("bx"), F.round("by_", 5).alias("by_"),
                    F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("f11_centre_pixel", with_views("""SELECT sheet_id, plot_no, round(26.7605e0 - (y - 500) * 5e-2 / 111320e0, 6) AS lat, round(80.901e0 + (x - 500) * 5e-2 / (111320e0 * cos(radians(26.7605e0))), 6) AS lon FROM plots""", "plots"))
def f11b(spark, d):
    lat, lon = P.centre_pixel_to_geo(F.col("x"), F.col("y"), F.lit(26.7605), F.lit(80.901), F.lit(5e-2))
    return view(spark, d, "plots").select("sheet_id", "plot_no", lat.alias("lat"), lon.alias("lon"))


@query("f12_apply_homography", with_views("""WITH h AS (SELECT s_suppkey AS sheet_id, 1e0 + s_suppkey * 1e-4 AS h0, 2e-2 AS h1, 5e0 AS h2, -1e-2 AS h3, 99e-2 AS h4, -3e0 AS h5, 1e-5 AS h6, 2e-5 AS h7, 1e0 AS h8 FROM supplier)
SELECT p.sheet_id, plot_no, round((h0 * x + h1 * y + h2) / (h6 * x + h7 * y + h8), 6) AS ux, round((h3 * x + h4 * y + h5) / (h6 * x + h7 * y + h8), 6) AS uy,
 round((h0 * (x + bw) + h1 * (y + bh) + h2) / (h6 * (x + bw) + h7 * (y + bh) + h8), 6) AS vx FROM plots p JOIN h ON p.sheet_id = h.sheet_id""", "plots"))
def f12(spark, d):
    k = F.col("s_suppkey")
    h = load(spark, d, "supplier")["supplier"].select(k.alias("sheet_id"), F.array(*[c.cast("double") for c in (
        1.0 + k * 1e-4, F.lit(2e-2), F.lit(5.0), F.lit(-1e-2), F.lit(99e-2), F.lit(-3.0), F.lit(1e-5), F.lit(2e-5), F.lit(1.0))]).alias("h"))
    p = boxes(spark, d).join(h, "sheet_id").select("sheet_id", "plot_no", P.apply_homography(F.col("rings"), F.col("h"), 6).alias("r"))
    return p.select("sheet_id", "plot_no", F.col("r")[0][0]["x"].alias("ux"), F.col("r")[0][0]["y"].alias("uy"), F.col("r")[0][2]["x"].alias("vx"))


@query("f12_homography_via_pixels", with_views("""WITH q AS (SELECT parcel_id, (x0 - 809e-1) * 1e4 AS px, 2047 - (y0 - 267e-1) * 1e4 AS py FROM parcels),
u AS (SELECT parcel_id, (1.01e0 * px + 2e-2 * py + 5e0) / (1e-6 * px + 1e-6 * py + 1e0) AS a, (-1e-2 * px + 99e-2 * py - 3e0) / (1e-6 * px + 1e-6 * py + 1e0) AS b FROM q)
SELECT parcel_id, round(a / 1e4 + 809e-1, 8) AS lon, round((2047 - b) / 1e4 + 267e-1, 8) AS lat FROM u""", "parcels"))
def f12b(spark, d):
    h = F.array(*[F.lit(v) for v in (1.01, 2e-2, 5.0, -1e-2, 99e-2, -3.0, 1e-6, 1e-6, 1.0)])
    t = F.struct(F.lit(80.9).alias("min_x"), F.lit(26.7).alias("min_y"), F.lit(1.0e4).alias("scale_x"), F.lit(1.0e4).alias("scale_y"), F.lit(2048).alias("height"))
    p = parcels(spark, d).withColumn("t", t).select("parcel_id", P.apply_homography_geo(F.col("rings"), h, F.col("t"), F.col("t")).alias("r"))
    return p.select("parcel_id", F.col("r")[0][0]["x"].alias("lon"), F.col("r")[0][0]["y"].alias("lat"))


@query("f16_alignment_confidence", with_views("""WITH m AS (SELECT sheet_id, plot_no, CAST(floor(bw) AS INT) AS matches, CAST(least(floor(bh), floor(bw)) AS INT) AS inliers, round(area_px / 2e1, 3) AS rmse, n_vertices - 3 AS gcps FROM plots),
c AS (SELECT *, CASE WHEN matches = 0 OR inliers = 0 THEN 0e0 ELSE round(greatest(0e0, least(1e2, (0.4e0 * (CAST(inliers AS DOUBLE) / matches) + 0.4e0 * greatest(0e0, 1e0 - rmse / (0.02e0 * 2896e0)) + 0.2e0 * least(1e0, inliers / 2e2)) * 1e2)), 2) END AS score FROM m)
SELECT sheet_id, plot_no, CASE WHEN gcps >= 2 THEN greatest(score, least(98.5e0, 88e0 + gcps * 2e0)) ELSE score END AS confidence FROM c""", "plots"))
def f16(spark, d):
    p = view(spark, d, "plots").select("sheet_id", "plot_no", F.floor("bw").cast("int").alias("m"), F.least(F.floor("bh"), F.floor("bw")).cast("int").alias("i"),
                                       F.round(F.col("area_px") / 20.0, 3).alias("e"), (F.col("n_vertices") - 3).alias("g"))
    return p.select("sheet_id", "plot_no", S.alignment_confidence(F.col("i"), F.col("m"), F.col("e"), F.col("g")).alias("confidence"))


PLOT_SCORE = """least(99.4e0, greatest(15e0, 1e2 * (0.4e0 * (bh / 60) + 0.3e0 * (1e0 - CASE WHEN area_sqm / 1e4 < 0.25e0 THEN greatest(nr, 0.75e0) ELSE nr END) + 0.3e0 * (area_sqm / 1e4))))"""


@query("f17_plot_confidence", with_views(f"""WITH p AS (SELECT *, greatest(0e0, least(1e0, area_px / 1e2 / 25e0)) AS nr FROM plots), s AS (SELECT sheet_id, plot_no, round({PLOT_SCORE} , 1) AS score FROM p)
SELECT *, CASE WHEN score >= 85 THEN 'GREEN' WHEN score >= 60 THEN 'AMBER' ELSE 'RED' END AS score_band FROM s""", "plots"))
def f17(spark, d):
    p = view(spark, d, "plots")
    s = p.select("sheet_id", "plot_no", S.plot_confidence(F.col("bh") / 60, S.normalized_rmse(F.col("area_px") / 100.0), F.col("area_sqm") / 1.0e4).alias("score"))
    return s.withColumn("score_band", S.band(F.col("score")))


@query("f18_boundary_score", with_views("SELECT sheet_id, plot_no, round((bh / 6e1) * 1e2 * CASE WHEN status_color = 'red' THEN 0.82e0 ELSE 1e0 END, 2) AS score FROM plots", "plots"))
def f18(spark, d):
    return view(spark, d, "plots").select("sheet_id", "plot_no", S.boundary_score(F.col("bh") / 60.0, F.col("status_color") == "red").alias("score"))


@query("f19_unit_conversions", with_views("""SELECT sheet_id, plot_no, CASE WHEN area_sqm - 500 <= 0 THEN '0.00' ELSE printf('%.2f', round((area_sqm - 500) / 2529.28e0, 2)) END AS bigha,
 area_sqm / 126.464e0 AS biswa, area_sqm * 10.7639e0 AS sqft FROM plots""", "plots"))
def f19(spark, d):
    a = F.col("area_sqm")
    return view(spark, d, "plots").select("sheet_id", "plot_no", S.to_bigha(a - 500).alias("bigha"), S.to_biswa(a).alias("biswa"), S.to_sqft(a).alias("sqft"))


@query("f20_fix_axis_order", with_views("SELECT parcel_id, round(x0, 9) AS lon, round(y0, 9) AS lat, CAST(5 AS INT) AS n_points, TRUE AS closed FROM parcels", "parcels"))
def f20(spark, d):
    open_ring = F.slice(F.col("rings")[0], 1, 4)
    turned = F.transform(open_ring, lambda p: R.point(p["y"], p["x"]))
    r = P.fix_axis_order(F.when(F.col("parcel_id") % 2 == 0, turned).otherwise(open_ring))
    q = parcels(spark, d).select("parcel_id", r.alias("r"))
    return q.select("parcel_id", F.round(F.col("r")[0]["x"], 9).alias("lon"), F.round(F.col("r")[0]["y"], 9).alias("lat"), F.size("r").alias("n_points"), R.is_closed(F.col("r")).alias("closed"))


@query("f21_translate_scale", with_views("""SELECT sheet_id, plot_no, round(x + n_vertices, 6) AS tx, round(y - n_vertices, 6) AS ty,
 round((3 * x + 2 * (x + bw)) / 5 + (x - (3 * x + 2 * (x + bw)) / 5) * greatest(15e-2, least(6e0, bh / 9)), 6) AS sx FROM plots""", "plots"))
def f21(spark, d):
    n = F.col("n_vertices").cast("double")
    p = boxes(spark, d).select("sheet_id", "plot_no", P.translate_ring(F.col("rings")[0], n, -n).alias("t"), P.scale_ring(F.col("rings")[0], F.col("bh") / 9).alias("s"))
    return p.select("sheet_id", "plot_no", F.round(F.col("t")[4]["x"], 6).alias("tx"), F.round(F.col("t")[4]["y"], 6).alias("ty"), F.round(F.col("s")[0]["x"], 6).alias("sx"))


@query("f22_displacement_m", with_views("""SELECT sheet_id, gcp_id, round(sqrt(((ty - sy) * 1e-5 * 111320e0) ^ 2 + ((tx - sx) * 1e-5 * 111320e0 * cos(radians(26e0 + sy * 1e-5))) ^ 2), 4) AS metres FROM gcps""", "gcps"))
def f22(spark, d):
    def deg(c, o):
        return o + F.col(c) * 1e-5
    m = P.displacement_m(deg("sy", 26.0), deg("sx", 80.0), deg("ty", 26.0), deg("tx", 80.0))
    return view(spark, d, "gcps").select("sheet_id", "gcp_id", F.round(m, 4).alias("metres"))


@query("f23_area_change", with_views("""SELECT sheet_id, plot_no, area_px - area_sqm AS delta, round(CASE WHEN area_sqm > 0 THEN (area_px - area_sqm) / area_sqm * 1e2 ELSE 0e0 END, 3) AS percent,
 round(area_sqm * ((bw + 0.3719e0) * bh / (bw * bh)), 1) AS edited FROM plots""", "plots"))
def f23(spark, d):
    c = S.area_change(F.col("area_sqm"), F.col("area_px"))
    bw, bh = F.col("bw"), F.col("bh")
    return view(spark, d, "plots").select("sheet_id", "plot_no", c["delta"].alias("delta"), F.round(c["percent"], 3).alias("percent"),
                                          S.edited_area(F.col("area_sqm"), bw * bh, (bw + 0.3719) * bh).alias("edited"))


@query("f24_sheet_bounds", with_views("""WITH p AS (SELECT parcel_id, x0, y0, x1, y1, parcel_id % 3 AS k, CASE parcel_id % 3 WHEN 0 THEN (y0 + y1) / 2 WHEN 1 THEN y0 ELSE 26.7605e0 END AS lat, CASE parcel_id % 3 WHEN 0 THEN (x0 + x1) / 2 WHEN 1 THEN x0 ELSE 80.901e0 END AS lon FROM parcels),
q AS (SELECT *, (9e2 * 5e-2 / 2) / 111320e0 AS dlat, (12e2 * 5e-2 / 2) / (111320e0 * greatest(1e-3, cos(radians(lat)))) AS dlon FROM p)
SELECT parcel_id, round(CASE WHEN k = 0 THEN y1 ELSE lat + dlat END, 6) AS north, round(CASE WHEN k = 0 THEN x0 ELSE lon - dlon END, 6) AS west,
 CASE k WHEN 0 THEN 'user_bbox' WHEN 1 THEN 'user_center' ELSE 'default_provisional' END AS source FROM q""", "parcels"))
def f24(spark, d):
    k = F.col("parcel_id") % 3

    def box(c):
        return F.when(k == 0, F.col(c))

    b = P.sheet_bounds(box("y1"), box("x0"), box("y0"), box("x1"), F.when(k == 1, F.col("y0")), F.when(k == 1, F.col("x0")), F.lit(1200.0), F.lit(900.0), F.lit(5e-2))
    return view(spark, d, "parcels").select("parcel_id", b.alias("b")).select("parcel_id", "b.north", "b.west", "b.source")


@query("f26_state_signature", with_views("""SELECT approval_id, sha256(concat_ws(':', CAST(parcel_id AS VARCHAR), '', requested_by, CAST(approval_id * 60 AS VARCHAR), concat('{"status":"', status, '","remarks":"', remarks, '"}'))) AS signature FROM approvals""", "approvals"))
def f26(spark, d):
    state = F.to_json(F.struct("status", "remarks"))
    return view(spark, d, "approvals").select("approval_id", C.state_signature(
        F.col("parcel_id"), F.lit(None).cast("string"), F.col("requested_by"), F.col("approval_id") * 60, state).alias("signature"))


@query("f27_parse_ids", """WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN upper(md5(c_name)) WHEN 1 THEN concat('par-', CAST(c_custkey AS VARCHAR), '-v2') ELSE concat('preview-', CAST(c_custkey AS VARCHAR)) END AS raw FROM customer),
h AS (SELECT id, raw, lower(raw) AS x FROM r)
SELECT id, CASE WHEN id % 3 = 0 THEN concat(substr(x, 1, 8), '-', substr(x, 9, 4), '-', substr(x, 13, 4), '-', substr(x, 17, 4), '-', substr(x, 21, 12)) END AS uuid,
 CASE WHEN id % 3 = 0 THEN raw ELSE CAST(id AS VARCHAR) END AS khasra FROM h""")
def f27(spark, d):
    i = F.col("c_custkey")
    raw = F.when(i % 3 == 0, F.upper(F.md5("c_name"))).when(i % 3 == 1, F.concat(F.lit("par-"), i.cast("string"), F.lit("-v2"))).otherwise(F.concat(F.lit("preview-"), i.cast("string")))
    r = load(spark, d, "customer")["customer"].select(i.alias("id"), raw.alias("raw"))
    return r.select("id", C.parse_uuid(F.col("raw")).alias("uuid"), C.khasra_from_id(F.col("raw")).alias("khasra"))


PAGE_RULES = [("Navigation", ["nav", "menu"], True), ("Tracking", ["track"], True), ("Journal", ["blog"], False), ("Legal", ["licen"], False)]


@query("f28_classify_infrastructure", """WITH l AS (SELECT page_id, lower(html) AS t FROM pages), f AS (SELECT page_id, contains(t, 'nav') OR contains(t, 'menu') AS a, contains(t, 'track') AS b, contains(t, 'blog') AS c, contains(t, 'licen') AS e FROM l)
SELECT page_id, array_to_string(list_filter([CASE WHEN a THEN 'Navigation' END, CASE WHEN b THEN 'Tracking' END, CASE WHEN c THEN 'Journal' END, CASE WHEN e THEN 'Legal' END], lambda v : v IS NOT NULL), ',') AS detected,
 CASE WHEN a OR b THEN 'HIGH' WHEN c OR e THEN 'LOW' ELSE 'NONE' END AS risk FROM f""")
def f28(spark, d):
    from ..functions.text import classify_infrastructure
    p = load(spark, d, "pages")["pages"].select("page_id", classify_infrastructure(F.col("html"), PAGE_RULES).alias("c"))
    return p.select("page_id", F.array_join("c.detected", ",").alias("detected"), "c.risk")


@query("f29_safe_name", """WITH b AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS base FROM pages)
SELECT page_id, CASE WHEN base = '' THEN 'cadastre_alignment' ELSE regexp_replace(base, '[^A-Za-z0-9_\\-]', '_', 'g') END AS name FROM b""")
def f29(spark, d):
    return load(spark, d, "pages")["pages"].select("page_id", C.safe_name(F.col("url")).alias("name"))


@query("f30_plot_area_from_pixels", with_views("SELECT sheet_id, plot_no, round(bw * bh * 0.07e0 * 0.07e0, 1) AS sqm, round(bw * bh * 0.12e0 * 12e0, 1) AS skeleton_sqm FROM plots", "plots"))
def f30(spark, d):
    px = F.col("bw") * F.col("bh")
    return view(spark, d, "plots").select("sheet_id", "plot_no", S.plot_area_from_pixels(px, 0.07).alias("sqm"), S.skeleton_area_from_pixels(px).alias("skeleton_sqm"))


@query("f31_aligned_status", with_views("""SELECT sheet_id, plot_no, CASE WHEN confidence_score >= 85 THEN 'VERIFIED_CLEAR' WHEN confidence_score >= 60 THEN 'OCCLUDED' ELSE 'GOVT_ILLEGAL' END AS status,
 CASE WHEN confidence_score >= 85 THEN '#10B981' WHEN confidence_score >= 60 THEN '#F59E0B' ELSE '#EF4444' END AS colour FROM plots""", "plots"))
def f31(spark, d):
    b = S.band(F.col("confidence_score"))
    return view(spark, d, "plots").select("sheet_id", "plot_no", ST.aligned_status(b).alias("status"), ST.band_colour(b).alias("colour"))


@query("t6_ring_extremities", with_views("""SELECT sheet_id, plot_no, array_to_string([CAST((0 + 4 - plot_no % 4) % 4 AS VARCHAR), CAST((1 + 4 - plot_no % 4) % 4 AS VARCHAR), CAST((2 + 4 - plot_no % 4) % 4 AS VARCHAR), CAST((3 + 4 - plot_no % 4) % 4 AS VARCHAR)], ',') AS idx FROM plots""", "plots"))
def t6(spark, d):
    x, y, w, h = (F.col(c) for c in ("x", "y", "bw", "bh"))
    diamond = F.array(R.point(x + w / 2, y), R.point(x + w, y + h / 2), R.point(x + w / 2, y + h), R.point(x, y + h / 2))
    k = (F.col("plot_no") % 4).cast("int")
    p = view(spark, d, "plots").withColumn("dm", diamond).withColumn("r", F.concat(F.slice("dm", k + 1, 4 - k), F.slice("dm", F.lit(1), k)))
    return p.select("sheet_id", "plot_no", F.array_join(R.ring_extremities(F.col("r")).cast("array<string>"), ",").alias("idx"))


@query("p11_validate_rings", with_views("SELECT sheet_id, plot_no, n_vertices >= 4 AS valid, CAST(CASE WHEN n_vertices >= 4 THEN n_vertices + 1 ELSE n_vertices END AS INT) AS n_points FROM plots", "plots"))
def p11(spark, d):
    ring = F.transform(F.sequence(F.lit(0), F.col("n_vertices") - 1), lambda i: R.point(F.col("x") + i * 10, F.col("y") + (i % 2) * 5))
    p = view(spark, d, "plots").select("sheet_id", "plot_no", F.array(ring).alias("rings"))
    return VA.validate_rings(p).select("sheet_id", "plot_no", (F.size("reasons") == 0).alias("valid"), F.size(F.col("rings")[0]).alias("n_points"))


# ---- spatial joins -------------------------------------------------------------------------------

@query("j2_overlap_pairs", with_views("""SELECT a.parcel_id AS a_id, b.parcel_id AS b_id FROM parcels a JOIN parcels b ON a.parcel_id <> b.parcel_id
 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""", "parcels"))
def j2(spark, d):
    return SP.overlap_pairs(parcels(spark, d))


GAP = "sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ^ 2 + greatest(0, a.y0 - b.y1, b.y0 - a.y1) ^ 2)"


@query("j3_neighbors_within", with_views(f"""SELECT a.parcel_id AS a_id, b.parcel_id AS b_id, round({GAP}, 12) AS distance FROM parcels a JOIN parcels b
 ON a.parcel_id <> b.parcel_id AND a.x0 - 5e-7 <= b.x1 AND b.x0 <= a.x1 + 5e-7 AND a.y0 - 5e-7 <= b.y1 AND b.y0 <= a.y1 + 5e-7 WHERE {GAP} <= 5e-7""", "parcels"))
def j3(spark, d):
    return SP.neighbors_within(parcels(spark, d), T.TOLERANCE_DEG).withColumn("distance", F.round("distance", 12))


@query("j4_nearest_neighbor", with_views(f"""WITH n AS (SELECT a.parcel_id AS a_id, b.parcel_id AS b_id, {GAP} AS distance FROM parcels a JOIN parcels b
 ON a.parcel_id <> b.parcel_id AND a.x0 - 5e-7 <= b.x1 AND b.x0 <= a.x1 + 5e-7 AND a.y0 - 5e-7 <= b.y1 AND b.y0 <= a.y1 + 5e-7)
SELECT a_id, b_id, round(distance, 12) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS rn FROM n WHERE distance <= 5e-7) WHERE rn = 1""", "parcels"))
def j4(spark, d):
    return SP.nearest_neighbor(parcels(spark, d), T.TOLERANCE_DEG).withColumn("distance", F.round("distance", 12))


CENTRED = "centred AS (SELECT *, floor(x + bw / 2) AS cx, floor(y + bh / 2) AS cy FROM plots)"


def centred(spark, d):
    return view(spark, d, "plots").withColumn("cx", F.floor(F.col("x") + F.col("bw") / 2).cast("double")).withColumn("cy", F.floor(F.col("y") + F.col("bh") / 2).cast("double"))


@query("j5_nearest_label", with_views("WITH " + CENTRED + """, labels AS (SELECT sheet_id, cx AS lx, cy AS ly, plot_no AS ord, concat('K', CAST(plot_no AS VARCHAR)) AS label FROM centred WHERE n_vertices = 6),
n AS (SELECT p.sheet_id, p.plot_no, l.label, row_number() OVER (PARTITION BY p.sheet_id, p.plot_no ORDER BY (cx - lx) ^ 2 + (cy - ly) ^ 2, ord) AS rn FROM centred p JOIN labels l ON p.sheet_id = l.sheet_id AND (cx - lx) ^ 2 + (cy - ly) ^ 2 <= 65 * 65)
SELECT p.sheet_id, p.plot_no, coalesce(n.label, CAST(p.plot_no AS VARCHAR)) AS label FROM centred p LEFT JOIN n ON p.sheet_id = n.sheet_id AND p.plot_no = n.plot_no AND n.rn = 1""", "plots"))
def j5(spark, d):
    c = centred(spark, d)
    labels = c.filter("n_vertices = 6").select("sheet_id", F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.col("plot_no").alias("ord"),
                                               F.concat(F.lit("K"), F.col("plot_no").cast("string")).alias("label"))
    return SP.nearest_label(c.select("sheet_id", "plot_no", "cx", "cy", F.col("plot_no").alias("fallback_id")), labels).select("sheet_id", "plot_no", "label")


@query("j7_snap_vertices", with_views("""WITH v AS (SELECT sheet_id, plot_no, pos, CASE WHEN pos IN (1, 2) THEN x + bw ELSE x END AS x, CASE WHEN pos IN (2, 3) THEN y + bh ELSE y END AS y FROM plots, (SELECT unnest([0, 1, 2, 3, 4]) AS pos)),
refs AS (SELECT DISTINCT sheet_id, sx, sy FROM gcps),
n AS (SELECT v.sheet_id, plot_no, pos, sx, sy, row_number() OVER (PARTITION BY v.sheet_id, plot_no, pos ORDER BY (x - sx) ^ 2 + (y - sy) ^ 2, sx, sy) AS rn FROM v JOIN refs r ON v.sheet_id = r.sheet_id AND abs(x - sx) < 12 AND abs(y - sy) < 12 AND (x - sx) ^ 2 + (y - sy) ^ 2 < 144)
SELECT v.sheet_id, v.plot_no, v.pos, coalesce(n.sx, v.x) AS sx, coalesce(n.sy, v.y) AS sy FROM v LEFT JOIN n ON v.sheet_id = n.sheet_id AND v.plot_no = n.plot_no AND v.pos = n.pos AND n.rn = 1""", "plots", "gcps"))
def j7(spark, d):
    pts = boxes(spark, d).select("sheet_id", F.col("plot_no").alias("shape_id"), F.size(F.col("rings")[0]).alias("n"), F.posexplode(F.col("rings")[0]).alias("pos", "p")).select(
        "sheet_id", "shape_id", "pos", "n", "p.x", "p.y")
    refs = view(spark, d, "gcps").select("sheet_id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    return SP.snap_vertices(pts, refs).select("sheet_id", F.col("shape_id").alias("plot_no"), "pos", "sx", "sy")


# ---- topology ------------------------------------------------------------------------------------

def bow_ties(spark, d):
    """Every fourth parcel with two corners swapped, which makes it cross itself."""
    r = F.col("rings")[0]
    crossed = F.array(F.array(r[0], r[2], r[1], r[3], r[0]))
    return parcels(spark, d).withColumn("rings", F.when(F.col("parcel_id") % 4 == 0, crossed).otherwise(F.col("rings")))


@query("f6_make_valid", with_views(f"""SELECT parcel_id, CAST(CASE WHEN parcel_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_parts, parcel_id % 4 = 0 AS repaired,
 round({DEG_AREA} * CASE WHEN parcel_id % 4 = 0 THEN 0.5e0 ELSE 1e0 END * 1e9, 2) AS area FROM parcels""", "parcels"))
def f6(spark, d):
    v = T.make_valid(bow_ties(spark, d))
    return v.groupBy("parcel_id").agg(F.count("*").alias("n_parts"), F.max("repaired").alias("repaired"), F.round(F.sum(R.planar_area(F.col("rings"))) * 1e9, 2).alias("area"))


SIDES = """sides AS (SELECT p.*, (SELECT l.x1 FROM parcels l WHERE l.parcel_id = p.parcel_id - 1 AND p.parcel_id % 40 <> 0) AS lx,
 (SELECT r.x0 FROM parcels r WHERE r.parcel_id = p.parcel_id + 1 AND p.parcel_id % 40 <> 39) AS rx FROM parcels p)"""


@query("f7_difference", with_views("WITH " + SIDES + f""" SELECT parcel_id, {area_sql("(least(x1, coalesce(rx, x1)) - greatest(x0, coalesce(lx, x0))) * (y1 - y0)")} AS area_sqm FROM sides""", "parcels"))
def f7(spark, d):
    return T.difference(parcels(spark, d)).select("parcel_id", "area_sqm")


@query("f8_snap", with_views("WITH " + SIDES + """ SELECT parcel_id, round(coalesce(lx, x0), 9) AS minx, round(coalesce(rx, x1), 9) AS maxx FROM sides""", "parcels"))
def f8(spark, d):
    s = T.snap_parcels(parcels(spark, d)).select("parcel_id", R.bbox(F.col("rings")).alias("b"))
    return s.select("parcel_id", F.round("b.minx", 9).alias("minx"), F.round("b.maxx", 9).alias("maxx"))


@query("f9_clean_topology", with_views("WITH " + SIDES + f""" SELECT parcel_id, CAST(0 AS INT) AS part_no, {area_sql("(coalesce(rx, x1) - coalesce(lx, x0)) * (y1 - y0)")} AS area_sqm FROM sides""", "parcels"))
def f9(spark, d):
    return T.clean_topology(parcels(spark, d)).select("parcel_id", "part_no", "area_sqm")


@query("f9_clean_topology_by_priority", with_views("WITH " + SIDES + f""" SELECT parcel_id, {area_sql("(x1 - coalesce(lx, x0)) * (y1 - y0)")} AS area_sqm FROM sides""", "parcels"))
def f9b(spark, d):
    return T.clean_topology(parcels(spark, d), priority="parcel_id").select("parcel_id", "area_sqm")


@query("a11_neighbor_union", with_views("""SELECT a.parcel_id AS a_id, count(*) AS n_parts, round(sum((b.x1 - b.x0) * (b.y1 - b.y0)) * 1e9, 2) AS area FROM parcels a JOIN parcels b ON a.parcel_id <> b.parcel_id
 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY a.parcel_id""", "parcels"))
def a11(spark, d):
    p = parcels(spark, d)
    u = A.neighbor_union(SP.overlap_pairs(p).withColumnRenamed("b_id", "shape_id"), p.select(F.col("parcel_id").alias("shape_id"), "rings"))
    return u.groupBy("a_id").agg(F.count("*").alias("n_parts"), F.round(F.sum("area") * 1e9, 2).alias("area"))


# The covered area of a sheet, column of pixels by column: what a box adds above all boxes that start below it.
@query("a11_union_of_sheet", with_views("""WITH c AS (SELECT sheet_id, unnest(range(CAST(x AS BIGINT), CAST(x + bw AS BIGINT))) AS px, y AS lo, y + bh AS hi FROM plots),
g AS (SELECT *, max(hi) OVER (PARTITION BY sheet_id, px ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c)
SELECT sheet_id, sum(greatest(0, hi - greatest(lo, coalesce(seen, lo)))) AS area FROM g GROUP BY sheet_id""", "plots"))
def a11_sheet(spark, d):
    u = AR.union_parts(boxes(spark, d).select("sheet_id", F.col("plot_no").alias("shape_id"), "rings"), "sheet_id", grid=1.0)
    return u.groupBy("sheet_id").agg(F.sum("area").alias("area"))


# All parcels as the neighbours of one target: rows of 40 that overlap, touch or leave gaps of less than a millionth of a degree.
@query("a11_union_of_crowd", with_views("""WITH i AS (SELECT CAST(round(x0 * 1e9) AS BIGINT) AS a, CAST(round(x1 * 1e9) AS BIGINT) AS b, CAST(round(y0 * 1e9) AS BIGINT) AS c, CAST(round(y1 * 1e9) AS BIGINT) AS d FROM parcels),
g AS (SELECT *, max(b) OVER (PARTITION BY c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT 1 AS target, CAST(sum(CASE WHEN seen >= a THEN 0 ELSE 1 END) AS BIGINT) AS n_parts, round(sum((greatest(b, coalesce(seen, b)) - greatest(a, coalesce(seen, a))) * (d - c)) * 1e-9, 3) AS area FROM g""", "parcels"))
def a11_crowd(spark, d):
    u = AR.union_parts(parcels(spark, d).select(F.lit(1).alias("target"), F.col("parcel_id").alias("shape_id"), "rings"), "target")
    return u.groupBy("target").agg(F.count("*").alias("n_parts"), F.round(F.sum("area") * 1e9, 3).alias("area"))


@query("a16_largest_part", with_views("SELECT concat(CAST(sheet_id AS VARCHAR), '/', CAST(plot_no AS VARCHAR)) AS parcel_id, CAST(CASE WHEN bw > bh THEN 1 ELSE 0 END AS INT) AS part_no FROM plots", "plots"))
def a16(spark, d):
    x, y, w, h = (F.col(c) for c in ("x", "y", "bw", "bh"))
    parts = F.array(R.rect_rings(x, y, x + h, y + h), R.rect_rings(x, y, x + w, y + w))
    p = view(spark, d, "plots").select(F.concat_ws("/", F.col("sheet_id").cast("string"), F.col("plot_no").cast("string")).alias("parcel_id"), F.posexplode(parts).alias("part_no", "rings"))
    return A.largest_part(p).select("parcel_id", "part_no")
