"""Control-point fits, matching, structural search, plots and pixels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions import rings as R
from ..operators import alignment as AL
from ..operators import plots as PL
from ..operators import splines as SP
from ..session import cut_lineage, spread
from .q_geometry import CENTRED, boxes, centred
from .q_relational import sheets
from .registry import query
from .views import bent, load, view, with_views

# Affine through a sheet's points from centred moments; the same sums as the Spark side.
FIT = """mom AS (SELECT sheet_id, avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv, var_pop(sx) AS vxx, var_pop(sy) AS vyy, covar_pop(sx, sy) AS vxy,
  covar_pop(sx, tx) AS xu, covar_pop(sy, tx) AS yu, covar_pop(sx, ty) AS xv, covar_pop(sy, ty) AS yv FROM gcps GROUP BY sheet_id),
fit0 AS (SELECT *, (xu * vyy - yu * vxy) / (vxx * vyy - vxy * vxy) AS a, (yu * vxx - xu * vxy) / (vxx * vyy - vxy * vxy) AS b,
  (xv * vyy - yv * vxy) / (vxx * vyy - vxy * vxy) AS c, (yv * vxx - xv * vxy) / (vxx * vyy - vxy * vxy) AS d FROM mom),
fit AS (SELECT sheet_id, a, b, mu - a * mx - b * my AS tx, c, d, mv - c * mx - d * my AS ty FROM fit0)"""


@query("a10_fit_affine", with_views("WITH " + FIT + " SELECT sheet_id, round(a, 7) AS a, round(b, 7) AS b, round(tx, 5) AS tx, round(c, 7) AS c, round(d, 7) AS d, round(ty, 5) AS ty FROM fit", "gcps"))
def a10(spark, d):
    f = AL.fit_affine(view(spark, d, "gcps"))
    return f.select("sheet_id", *[F.round(f"m.{c}", n).alias(c) for c, n in (("a", 7), ("b", 7), ("tx", 5), ("c", 7), ("d", 7), ("ty", 5))])


@query("f13_apply_affine", with_views("WITH " + FIT + """ SELECT p.sheet_id, plot_no, round(a * x + b * y + tx, 4) AS ux, round(c * x + d * y + ty, 4) AS uy,
 round(a * (x + bw) + b * (y + bh) + tx, 4) AS vx FROM plots p JOIN fit f ON p.sheet_id = f.sheet_id""", "gcps", "plots"))
def f13(spark, d):
    w = AL.warp_affine(boxes(spark, d).select("sheet_id", "plot_no", "rings"), AL.fit_affine(view(spark, d, "gcps")))
    r = F.col("rings")
    return w.select("sheet_id", "plot_no", F.round(r[0][0]["x"], 4).alias("ux"), F.round(r[0][0]["y"], 4).alias("uy"), F.round(r[0][2]["x"], 4).alias("vx"))


@query("f14_tps_warp")
def f14(spark, d):
    g = view(spark, d, "gcps")
    w = SP.apply_tps(g.select("sheet_id", "gcp_id", F.col("sx").alias("x"), F.col("sy").alias("y"), "tx", "ty"), SP.fit_tps(g))
    ex, ey = F.col("wx") - F.col("tx"), F.col("wy") - F.col("ty")
    return w.groupBy("sheet_id").agg(F.count("*").alias("n_points"), F.round(F.sqrt(F.avg(ex * ex + ey * ey)), 4).alias("rmse"))


@query("f14_tps_known", with_views(f"""SELECT sheet_id, plot_no, round({bent("x", "y")[0]}, 4) AS wx, round({bent("x", "y")[1]}, 4) AS wy FROM plots""", "plots"))
def f14_known(spark, d):
    w = SP.apply_tps(view(spark, d, "plots").select("sheet_id", "plot_no", "x", "y"), SP.fit_tps(view(spark, d, "spline_gcps")))
    return w.select("sheet_id", "plot_no", F.round("wx", 4).alias("wx"), F.round("wy", 4).alias("wy"))


def matches(spark, d):
    """Control points as matches, every seventh one spoiled."""
    g = view(spark, d, "gcps")
    bad = F.pmod(F.crc32("gcp_id"), F.lit(7)) == 0
    return g.select("sheet_id", F.concat("gcp_id", F.lit("/"), F.col("sy").cast("string")).alias("match_id"), "sx", "sy",
                    F.when(bad, F.col("tx") + 40 + F.col("sy") % 31).otherwise(F.col("tx")).alias("tx"),
                    F.when(bad, F.col("ty") - 60 - F.col("sx") % 17).otherwise(F.col("ty")).alias("ty"))


@query("f15_fit_robust")
def f15(spark, d):
    f = AL.fit_robust(matches(spark, d))
    return f.select("sheet_id", "matches", "inliers", F.round("rmse_px", 3).alias("rmse_px"),
                    *[F.round(F.col("h")[i], 3).alias(f"h{i}") for i in range(6)])


# Exact matches under a known homography, those of every seventh plot column moved far off.
KNOWN = [1.02, -0.03, 12.0, 0.03, 0.98, -7.0, 1e-5, 2e-5]


@query("f15_fit_robust_known", with_views(f"""SELECT sheet_id, count(*) AS matches, CASE WHEN count(*) >= {AL.SHEET_LIMITS["min_matches"]} THEN count(*) FILTER (sy % 7 <> 0) ELSE 0 END AS inliers,
 """ + ", ".join(f"CASE WHEN count(*) >= {AL.SHEET_LIMITS['min_matches']} THEN {round(v * 1e5)} END AS h{i}" for i, v in enumerate(KNOWN)) + """ FROM gcps GROUP BY sheet_id""", "gcps"))
def f15_known(spark, d):
    g = view(spark, d, "gcps")
    x, y, h = F.col("sx"), F.col("sy"), [F.lit(v) for v in KNOWN]
    w = h[6] * x + h[7] * y + 1
    off = F.when(y % 7 == 0, 40 + (x + y) % 31).otherwise(0)
    m = g.select("sheet_id", F.concat("gcp_id", F.lit("/"), y.cast("string")).alias("match_id"), "sx", "sy",
                 ((h[0] * x + h[1] * y + h[2]) / w + off).alias("tx"), ((h[3] * x + h[4] * y + h[5]) / w - off).alias("ty"))
    # The fitted numbers in units of 1e-5, to which they are exact.
    return AL.fit_robust(m).select("sheet_id", "matches", "inliers", *[F.round(F.col("h")[i] * 1e5).cast("int").alias(f"h{i}") for i in range(8)])


@query("p17_transform_sanity", with_views("WITH " + FIT + """, s AS (SELECT s_suppkey AS sheet_id, 12e2 AS width, 88e1 + s_suppkey % 40 AS height FROM supplier)
SELECT f.sheet_id, abs(a * d - b * c) > 0.01e0 AND abs(a * d - b * c) < 50 AS manual_ok,
 a * d - b * c > 0 AND abs(a * d - b * c) BETWEEN 0.02e0 AND 50 AND (a * width) * (d * height) - (c * width) * (b * height) > 0 AS automatic_ok
FROM fit f JOIN s ON f.sheet_id = s.sheet_id""", "gcps"))
def p17(spark, d):
    m = F.col("m")
    f = AL.fit_affine(view(spark, d, "gcps")).select("sheet_id", F.col("n").alias("inliers"), F.array(
        m["a"], m["b"], m["tx"], m["c"], m["d"], m["ty"], F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"))
    s = sheets(spark, d)
    one = AL.accept_transforms(f, s, manual=True).select("sheet_id", F.col("accepted").alias("manual_ok"))
    two = AL.accept_transforms(f, s).select("sheet_id", F.col("accepted").alias("automatic_ok"))
    return one.join(two, "sheet_id")


@query("j8_match_descriptors", with_views("""WITH d AS (SELECT a.sheet_id, a.vec_id AS src_id, b.vec_id AS tgt_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
  FROM descriptors a JOIN descriptors b ON a.sheet_id = b.sheet_id AND a.side = 'src' AND b.side = 'tgt'),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, src_id ORDER BY dist, tgt_id) AS rn FROM d),
p AS (SELECT sheet_id, src_id, max(CASE WHEN rn = 1 THEN tgt_id END) AS tgt_id, max(CASE WHEN rn = 1 THEN dist END) AS d1, max(CASE WHEN rn = 2 THEN dist END) AS d2 FROM r WHERE rn <= 2 GROUP BY sheet_id, src_id)
SELECT sheet_id, src_id, tgt_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM p WHERE d2 IS NOT NULL AND d1 < 0.95e0 * d2""", "descriptors"))
def j8(spark, d):
    m = AL.match_descriptors(view(spark, d, "descriptors"), ratio=0.95)
    return m.select("sheet_id", "src_id", "tgt_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


# Binary codes of the vectors, all on one sheet: signs, and comparisons of neighbouring components; targets are seen a little displaced.
CODES = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT vec_id, s, list_transform(range(1, 65), lambda i: s[i] + 0.04e0 * s[i % 64 + 1]) AS t FROM e),
b AS (SELECT vec_id, list_concat(list_transform(s, lambda x: CAST(x > 0 AS INT)), list_transform(range(1, 65), lambda i: CAST(s[i] > s[i % 64 + 1] AS INT))) AS sb,
  list_concat(list_transform(t, lambda x: CAST(x > 0 AS INT)), list_transform(range(1, 65), lambda i: CAST(t[i] > t[i % 64 + 1] AS INT))) AS tb FROM g),
k AS (SELECT vec_id, list_transform(range(0, 8), lambda c: list_sum(list_transform(range(0, 16), lambda i: sb[16 * c + i + 1] << i))) AS s, list_transform(range(0, 8), lambda c: list_sum(list_transform(range(0, 16), lambda i: tb[16 * c + i + 1] << i))) AS t FROM b),
d AS (SELECT x.vec_id AS src_id, y.vec_id AS tgt_id, list_sum(list_transform(list_zip(x.s, y.t), lambda z: bit_count(xor(CAST(z[1] AS BIGINT), CAST(z[2] AS BIGINT)))))::INTEGER AS d FROM k x, k y),
r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY d, tgt_id) AS rn, lead(d) OVER (PARTITION BY src_id ORDER BY d, tgt_id) AS d2 FROM d)"""


def codes(spark, d):
    e = load(spark, d, "embeddings")["embeddings"].filter(F.size("embedding") == 64).select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    after = lambda v, i: F.element_at(v, i % 64 + 1)
    moved = lambda s: F.transform(s, lambda x, i: x + 0.04 * after(s, i + 1))

    def packed(v):
        bits = lambda s: F.concat(F.transform(s, lambda x: (x > 0).cast("int")), F.transform(s, lambda x, i: (x > after(s, i + 1)).cast("int")))
        byte = lambda b, c: F.aggregate(F.slice(b, c * 8 + 1, 8), F.struct(F.lit(0).alias("s"), F.lit(1).alias("w")),
                                        lambda a, x: F.struct((a["s"] + x * a["w"]).alias("s"), (a["w"] * 2).alias("w")), lambda a: a["s"])
        return R.let(R.let(R.let(v, bits), lambda b: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: byte(b, c))), AL.code_chunks)

    one = lambda side, v: e.select(F.lit(1).alias("sheet_id"), "vec_id", F.lit(side).alias("side"), packed(v).alias("code"))
    return spread(one("src", F.col("s")).union(one("tgt", R.let(F.col("s"), moved))), "side", "vec_id")


@query("j8_match_codes", "WITH " + CODES + " SELECT 1 AS sheet_id, src_id, tgt_id, d AS d1, least(d2, 16)::INTEGER AS d2 FROM r WHERE rn = 1 AND d < 0.8e0 * least(d2, 16)")
def j8_codes(spark, d):
    return AL.match_codes(codes(spark, d))


# How many of all matches the candidates hold, however far apart, and the share of all pairs that are compared.
@query("j8_match_codes_recall", "WITH " + CODES + " SELECT count(*) AS matches, true AS recall_is_95, true AS compares_under_5_percent FROM r WHERE rn = 1 AND d < 0.8e0 * d2")
def j8_recall(spark, d):
    c = cut_lineage(codes(spark, d))
    exact = c.select("sheet_id", "vec_id", "side", F.flatten(F.transform("code", lambda x: F.array(x % 256, F.shiftright(x, 8)))).alias("embedding"))
    exact = AL.match_descriptors(exact, metric="hamming").select("sheet_id", "src_id", "tgt_id", F.lit(1).alias("m"))
    pairs = AL.code_candidates(c).select("sheet_id", "src_id", "tgt_id", F.lit(1).alias("p"))
    n = c.groupBy("sheet_id").agg(F.count(F.when(F.col("side") == "src", 1)).alias("s"), F.count(F.when(F.col("side") == "tgt", 1)).alias("t"))
    both = pairs.join(exact, ["sheet_id", "src_id", "tgt_id"], "full").groupBy("sheet_id").agg(F.count("m").alias("matches"), F.count("p").alias("compared"), F.count(F.col("m") + F.col("p")).alias("held"))
    return both.join(n, "sheet_id").select("matches", (F.col("held") >= 0.95 * F.col("matches")).alias("recall_is_95"), (F.col("compared") < 0.05 * F.col("s") * F.col("t")).alias("compares_under_5_percent"))


@query("j13_boundary_support", with_views("""WITH fp AS (SELECT DISTINCT sheet_id, CAST(sx AS BIGINT) AS px, CAST(sy AS BIGINT) AS py FROM gcps),
n AS (SELECT p.sheet_id, plot_no, count(fp.px) AS hit_px, CAST(any_value((bw + 5) * (bh + 5) - (bw - 5) * (bh - 5)) AS BIGINT) AS strip_px FROM plots p LEFT JOIN fp ON p.sheet_id = fp.sheet_id
  AND px BETWEEN x - 2 AND x + bw + 2 AND py BETWEEN y - 2 AND y + bh + 2 AND NOT (px BETWEEN x + 3 AND x + bw - 3 AND py BETWEEN y + 3 AND y + bh - 3) GROUP BY p.sheet_id, plot_no)
SELECT sheet_id, plot_no, strip_px, hit_px, round(least(0.96e0, greatest(0.48e0, 0.58e0 + CAST(hit_px AS DOUBLE) / strip_px * 0.38e0)), 6) AS iou FROM n""", "plots", "gcps"))
def j13(spark, d):
    fp = view(spark, d, "gcps").select("sheet_id", F.col("sx").alias("px"), F.col("sy").alias("py"))
    b = AL.boundary_support(boxes(spark, d).select("sheet_id", "plot_no", "rings"), fp)
    return b.select("sheet_id", "plot_no", "strip_px", "hit_px", F.round("iou", 6).alias("iou"))


@query("j14_score_transforms")
def j14(spark, d):
    g = view(spark, d, "gcps")
    pts = g.select("sheet_id", F.round("sx").alias("x"), F.round("sy").alias("y"))
    ref = g.select("sheet_id", F.greatest(F.lit(0.0), F.round("tx")).alias("x"), F.greatest(F.lit(0.0), F.round("ty")).alias("y"))
    s = load(spark, d, "supplier")["supplier"].select(F.col("s_suppkey").alias("sheet_id"), F.lit(1024.0).alias("width"), F.lit(1024.0).alias("height"),
                                                     F.lit(1100.0).alias("ref_width"), F.lit(1100.0).alias("ref_height"))
    out = AL.score_transforms(pts, ref, s)
    return out.select("sheet_id", F.round("score", 4).alias("score"), "confidence", "rmse_m", "needs_assisted", "method",
                      *[F.round(f"m.{c}", 4).alias(c) for c in ("a", "b", "tx", "c", "d", "ty")])


@query("f32_anchor_points", with_views("WITH " + FIT + """, s AS (SELECT f.*, 12e2 AS width, 88e1 + f.sheet_id % 40 AS height FROM fit f), k AS (SELECT unnest([1, 2, 3, 4]) AS id, unnest([0.15e0, 0.85e0, 0.85e0, 0.15e0]) AS fx, unnest([0.15e0, 0.15e0, 0.85e0, 0.85e0]) AS fy)
SELECT sheet_id, id, round(a * (width * fx) + b * (height * fy) + tx, 1) AS x, round(c * (width * fx) + d * (height * fy) + ty, 1) AS y FROM s, k""", "gcps"))
def f32(spark, d):
    f = AL.fit_affine(view(spark, d, "gcps")).join(sheets(spark, d), "sheet_id")
    a = f.select("sheet_id", F.explode(P.anchor_points(F.col("m"), F.col("width"), F.col("height"))).alias("p"))
    return a.select("sheet_id", "p.id", "p.x", "p.y")


# ---- plots and pixels ----------------------------------------------------------------------------

@query("w1_number_plots", with_views("WITH " + CENTRED + """, s AS (SELECT c.*, greatest(1, floor((88e1 + sheet_id % 40) / 6)) AS rh FROM centred c)
SELECT sheet_id, plot_no, row_number() OVER (PARTITION BY sheet_id ORDER BY floor(cy / rh), cx, plot_no) AS plot_index FROM s""", "plots"))
def w1(spark, d):
    return PL.number_plots(centred(spark, d), sheets(spark, d)).select("sheet_id", "plot_no", "plot_index")


@query("w1_number_plots_skeleton", with_views("""SELECT sheet_id, plot_no, row_number() OVER (PARTITION BY sheet_id ORDER BY floor(y / 80), x, plot_no) AS plot_index FROM plots""", "plots"))
def w1b(spark, d):
    return PL.number_plots(centred(spark, d), sheets(spark, d), "skeleton").select("sheet_id", "plot_no", "plot_index")


# The rule one plot after the other: a step takes the next plot of every sheet and the list of those that stay.
@query("w4_suppress_duplicate_plots", with_views("WITH " + CENTRED + """, r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY area_px DESC, plot_no) AS i FROM centred),
k AS (SELECT * FROM (WITH RECURSIVE s(sheet_id, i, kept) AS (SELECT DISTINCT sheet_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE)[]) FROM r UNION ALL
 SELECT s.sheet_id, r.i, CASE WHEN len(list_filter(s.kept, lambda k: abs(r.cx - k.x) < greatest(14e0, 0.18e0 * r.bw) AND abs(r.cy - k.y) < greatest(14e0, 0.18e0 * r.bh))) > 0 THEN s.kept ELSE list_append(s.kept, {'i': r.i, 'x': CAST(r.cx AS DOUBLE), 'y': CAST(r.cy AS DOUBLE)}) END
 FROM s JOIN r ON r.sheet_id = s.sheet_id AND r.i = s.i + 1) SELECT sheet_id, unnest(arg_max(kept, i)) AS k FROM s GROUP BY sheet_id))
SELECT r.sheet_id, r.plot_no, r.area_px FROM r JOIN k ON r.sheet_id = k.sheet_id AND r.i = k.k.i""", "plots"))
def w4(spark, d):
    return PL.suppress_duplicate_plots(centred(spark, d)).select("sheet_id", "plot_no", "area_px")


HSV = """h AS (SELECT tile_id, in_mask, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS df, r, g, b FROM pixels),
k AS (SELECT tile_id, in_mask, v, CASE WHEN v > 0 THEN floor(1044480e0 / v + 0.5e0) ELSE 0 END AS sd, CASE WHEN df > 0 THEN floor(737280e0 / (6e0 * df) + 0.5e0) ELSE 0 END AS hd, df,
  CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * df ELSE r - g + 4 * df END AS turn FROM h),
z AS (SELECT tile_id, in_mask, v, floor((df * sd + 2048) / 4096) AS s, floor((turn * hd + 2048) / 4096) AS h0 FROM k),
hsv AS (SELECT tile_id, in_mask, v, s, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS hue FROM z)"""


@query("a14_occlusion_ratios", with_views("WITH " + HSV + """, c AS (SELECT tile_id, count(*) FILTER (in_mask) AS n, count(*) FILTER (in_mask AND v < 55) AS sh, count(*) FILTER (in_mask AND hue BETWEEN 35 AND 85 AND s > 45) AS ca FROM hsv GROUP BY tile_id),
q AS (SELECT *, coalesce(CAST(sh AS DOUBLE) / nullif(n, 0), 0e0) AS sr, coalesce(CAST(ca AS DOUBLE) / nullif(n, 0), 0e0) AS cr FROM c)
SELECT tile_id, n AS masked_px, round(sr, 4) AS shadow_ratio, round(cr, 4) AS canopy_ratio, sr > 0.18e0 OR cr > 0.22e0 AS is_occluded FROM q""", "pixels"))
def a14(spark, d):
    return PL.occlusion_ratios(view(spark, d, "pixels")).drop("reason")


@query("a15_otsu_threshold", with_views("""WITH g AS (SELECT tile_id, CAST(floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384) AS INT) AS gray, count(*) AS n FROM pixels GROUP BY 1, 2),
c AS (SELECT tile_id, gray, CAST(sum(n) OVER w AS DOUBLE) AS w1, CAST(sum(n * gray) OVER w AS DOUBLE) AS s1, CAST(sum(n) OVER (PARTITION BY tile_id) AS DOUBLE) AS w, CAST(sum(n * gray) OVER (PARTITION BY tile_id) AS DOUBLE) AS s FROM g WINDOW w AS (PARTITION BY tile_id ORDER BY gray)),
v AS (SELECT tile_id, gray, w, coalesce(round(w1 / w * (1 - w1 / w) * ((s1 / w1 - (s - s1) / nullif(w - w1, 0)) * (s1 / w1 - (s - s1) / nullif(w - w1, 0))), 9), 0) AS sigma FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY sigma DESC, gray) AS rn FROM v)
SELECT tile_id, CAST(CASE WHEN sigma > 0 THEN gray ELSE 0 END AS INT) AS threshold, round(sigma, 4) AS sigma, CAST(w AS BIGINT) AS n_pixels FROM r WHERE rn = 1""", "pixels"))
def a15(spark, d):
    return PL.otsu_threshold(view(spark, d, "pixels"))
