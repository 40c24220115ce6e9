"""Operators without an SQL twin, against brute force on small inputs; skewed inputs; tiled cutting."""
from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import rings as R
from landloom.operators import alignment as AL
from landloom.operators import splines
from landloom.operators import plots as PL
from landloom.operators import spatial as SP
from landloom.operators import topology as T
from landloom.session import cut_lineage, settings


def polygons(spark, shapes):
    rows = [(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in shapes.items()]
    return R.with_bbox(spark.createDataFrame(rows, f"parcel_id long, rings {R.RINGS_TYPE}"))


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def area(rings):
    def one(r):
        p = np.asarray(r, float).reshape(-1, 2)
        p = p - p[0]
        return abs(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1])) / 2
    return one(rings[0]) - sum(one(r) for r in rings[1:])


def flat(ring):
    return np.array(ring, float).ravel()


def test_subtract_shapes():
    sq = [flat(box(0, 0, 4, 4)[0])]
    assert area(T.subtract(sq, [[flat(box(3, -1, 5, 5)[0])]])[0]) == pytest.approx(12)
    hole = T.subtract(sq, [[flat(box(1, 1, 2, 2)[0])]])[0]
    assert len(hole) == 2 and area(hole) == pytest.approx(15)
    parts = T.subtract(sq, [[flat(box(1, -1, 2, 5)[0])]], keep_all=True)
    assert [area(p) for p in parts] == pytest.approx([8, 4])
    assert T.subtract(sq, [[flat(box(-1, -1, 9, 9)[0])]]) == [sq]
    assert T.subtract(sq, [[flat(box(4, 0, 5, 4)[0])]]) == [sq]


def test_subtract_matches_grid_count():
    rng = np.random.default_rng(3)
    for _ in range(20):
        def star(cx, cy, n):
            a = np.sort(rng.random(n)) * 2 * np.pi
            r = 1 + rng.random(n) * 2
            p = np.column_stack([cx + r * np.cos(a), cy + r * np.sin(a)])
            return np.vstack([p, p[:1]]).ravel()
        t, bs = [star(0, 0, 9)], [[star(*rng.uniform(-2, 2, 2), 7)] for _ in range(3)]
        parts = T.stitch(T.boundary(t, bs))
        xs = np.linspace(-4, 4, 400)
        gx, gy = (v.ravel() for v in np.meshgrid(xs, xs))
        inside = T._inside(gx, gy, [T._edges(t)] + [T._edges(b) for b in bs])
        want = np.count_nonzero(inside[0] & ~inside[1:].any(axis=0)) * (8 / 399) ** 2
        assert sum(area(p) for p in parts) == pytest.approx(want, abs=0.12)


def test_repair_bow_tie():
    parts = T.repair([np.array([0, 0, 2, 2, 2, 0, 0, 2, 0, 0], float)])
    assert sorted(area(p) for p in parts) == pytest.approx([1, 1])


def test_overlap_pairs_general(spark):
    rnd = random.Random(5)
    shapes = {}
    for i in range(60):
        x, y, s = rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.choice([0.2, 1, 3, 9])
        shapes[i] = [[(x, y), (x + s, y + 0.2 * s), (x + 0.6 * s, y + s), (x, y)]]
    got = {(r[0], r[1]) for r in SP.overlap_pairs(polygons(spark, shapes)).collect()}

    def meet(a, b):
        def orient(p, q, r):
            return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        for i in range(3):
            for j in range(3):
                p, q, r, s = a[i], a[i + 1], b[j], b[j + 1]
                if orient(p, q, r) * orient(p, q, s) <= 0 and orient(r, s, p) * orient(r, s, q) <= 0:
                    return True
        ins = T._inside(np.array([a[0][0], b[0][0]]), np.array([a[0][1], b[0][1]]), [T._edges([flat(a)]), T._edges([flat(b)])])
        return bool(ins[1][0] or ins[0][1])

    want = {(i, j) for i in shapes for j in shapes if i != j and meet(shapes[i][0], shapes[j][0])}
    assert got == want


def test_copies_and_crowded_target(spark, monkeypatch):
    """One wide parcel under many small ones, and a pile of exact copies."""
    shapes = {0: box(0, 0, 40, 10)}
    n = 1
    for i in range(20):
        for j in range(5):
            shapes[n] = box(2 * i, 2 * j, 2 * i + 1, 2 * j + 1)
            n += 1
    for k in range(30):
        shapes[n + k] = box(100, 100, 101, 101)
    p = polygons(spark, shapes)
    near = {r["a_id"]: r["b_id"] for r in SP.nearest_neighbor(p, 0.0).collect()}
    assert near[n] == n + 1 and near[n + 5] == n

    def run():
        return {r["parcel_id"]: (r["a"], r["holes"]) for r in T.clean_topology(p, tol=0.0).select(
            "parcel_id", F.round(R.planar_area(F.col("rings")), 6).alias("a"), F.size("rings").alias("holes")).collect()}

    whole = run()
    assert whole[0][0] == 300.0 and whole[n][0] == 1.0
    monkeypatch.setattr(T, "TILE_NEIGHBOURS", 6)
    assert run() == whole


def test_priority_leaves_no_overlap(spark):
    rnd = random.Random(8)
    shapes = {}
    for i in range(40):
        x, y = rnd.uniform(0, 8), rnd.uniform(0, 8)
        shapes[i] = [[(x, y), (x + 2, y + 0.3), (x + 1.7, y + 2), (x + 0.2, y + 1.6), (x, y)]]
    out = T.clean_topology(polygons(spark, shapes), tol=0.0, priority="parcel_id", keep="all").collect()
    parts = [(r["parcel_id"], [flat([(p["x"], p["y"]) for p in ring]) for ring in r["rings"]]) for r in out]
    xs = np.linspace(0, 11, 300) + 1e-4
    gx, gy = (v.ravel() for v in np.meshgrid(xs, xs))
    before = T._inside(gx, gy, [T._edges([flat(s[0])]) for s in shapes.values()])
    after = T._inside(gx, gy, [T._edges(r) for _, r in parts])
    covered = {i for i, r in parts if len(r) == 1 and np.array_equal(np.sort(r[0]), np.sort(flat(shapes[i][0])))}
    cut = np.array([i not in covered for i, _ in parts])
    assert after[cut].sum(axis=0).max() <= 1 or cut.sum() == 0
    assert np.array_equal(before.any(axis=0), after.any(axis=0))


def test_affine_offset_and_tps(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for sheet, n in ((1, 12), (2, 2), (3, 1)):
        for k in range(n):
            x, y = rnd.uniform(0, 100, 2)
            rows.append((sheet, f"g{k:02d}", float(x), float(y), float(2 * x - y + 3), float(x + y - 1)))
    g = spark.createDataFrame(rows, "sheet_id long, gcp_id string, sx double, sy double, tx double, ty double")
    fit = {r["sheet_id"]: r for r in AL.fit_affine(g).collect()}
    assert fit[1]["method"] == "affine" and fit[1]["m"]["a"] == pytest.approx(2) and fit[1]["m"]["ty"] == pytest.approx(-1)
    assert fit[2]["method"] == "offset" and fit[3]["method"] == "identity"
    warped = splines.apply_tps(g.select("sheet_id", "gcp_id", F.col("sx").alias("x"), F.col("sy").alias("y"), "tx", "ty"), splines.fit_tps(g), chunk=5)
    for r in warped.filter("sheet_id = 1").collect():
        assert r["wx"] == pytest.approx(r["tx"], abs=1e-4) and r["wy"] == pytest.approx(r["ty"], abs=1e-4)


def test_robust_homography(spark):
    h = np.array([[1.05, 0.02, 5], [-0.03, 0.97, -4], [1e-5, 2e-5, 1]])
    rnd = np.random.default_rng(2)
    rows = []
    for k in range(300):
        x, y = rnd.uniform(0, 1000, 2)
        u, v, w = h @ [x, y, 1]
        bad = k % 3 == 0
        rows.append((1, f"m{k}", float(x), float(y), float(u / w + (rnd.uniform(50, 200) if bad else 0)), float(v / w)))
    rows += [(2, f"m{k}", 1.0, 1.0, 1.0, 1.0) for k in range(3)]
    m = spark.createDataFrame(rows, "sheet_id long, match_id string, sx double, sy double, tx double, ty double")
    got = {r["sheet_id"]: r for r in AL.fit_robust(m).collect()}
    assert got[1]["inliers"] == 200 and got[1]["rmse_px"] < 1e-6
    assert np.allclose(np.array(got[1]["h"]).reshape(3, 3), h, atol=1e-6)
    assert got[2]["h"] is None and got[2]["rmse_px"] == 999.0


def test_hamming_match(spark):
    rnd = np.random.default_rng(4)
    rows = [(1, i, "src" if i % 2 else "tgt", [int(v) for v in rnd.integers(0, 256, 8)]) for i in range(120)]
    d = spark.createDataFrame(rows, "sheet_id long, vec_id long, side string, embedding array<int>")
    got = {r["src_id"]: (r["tgt_id"], r["d1"], r["d2"]) for r in AL.match_descriptors(d, 0.8, "hamming", block=16).collect()}
    src, tgt = [r for r in rows if r[2] == "src"], [r for r in rows if r[2] == "tgt"]
    want = {}
    for s in src:
        ds = sorted((sum(bin(a ^ b).count("1") for a, b in zip(s[3], t[3])), t[1]) for t in tgt)
        if ds[0][0] < 0.8 * ds[1][0]:
            want[s[1]] = (ds[0][1], float(ds[0][0]), float(ds[1][0]))
    assert got == want


def test_structural_search(spark):
    """Score of the winner equals the brute-force mean capped distance; few points take the centred fit."""
    rnd = np.random.default_rng(6)
    pts = np.unique(rnd.integers(50, 450, (120, 2)), axis=0)
    s, t, dx, dy = 1.0, math.radians(2.0), 20.0, -10.0
    ref = np.column_stack([s * math.cos(t) * pts[:, 0] - s * math.sin(t) * pts[:, 1] + dx, s * math.sin(t) * pts[:, 0] + s * math.cos(t) * pts[:, 1] + dy])
    ref = np.unique(np.clip(np.rint(ref), 0, 499).astype(int), axis=0)
    p = spark.createDataFrame([(1, int(x), int(y)) for x, y in pts] + [(2, 5, 5)], "sheet_id long, x int, y int")
    e = spark.createDataFrame([(1, int(x), int(y)) for x, y in ref], "sheet_id long, x int, y int")
    sh = spark.createDataFrame([(1, 500.0, 500.0, 500.0, 500.0), (2, 500.0, 250.0, 500.0, 500.0)], "sheet_id long, width double, height double, ref_width double, ref_height double")
    got = {r["sheet_id"]: r for r in AL.score_transforms(p, e, sh, tile=128).collect()}
    m = got[1]["m"]
    u = np.clip(np.rint(m["a"] * pts[:, 0] + m["b"] * pts[:, 1] + m["tx"]), 0, 499)
    v = np.clip(np.rint(m["c"] * pts[:, 0] + m["d"] * pts[:, 1] + m["ty"]), 0, 499)
    d = np.minimum(np.hypot(u[:, None] - ref[None, :, 0], v[:, None] - ref[None, :, 1]).min(axis=1), 35.0).mean()
    assert got[1]["score"] == pytest.approx(d, abs=1e-6) and got[1]["score"] < 3
    assert got[2]["method"] == "centred_fit" and got[2]["m"]["ty"] == 125.0 and got[2]["confidence"] == 65.0


@pytest.mark.parametrize("part", [20_000, 700])
def test_structural_search_takes_all_points(spark, part):
    """The score is the mean over all points of a sheet, not over some 2 000 of them, however they are dealt to parts."""
    rnd = np.random.default_rng(8)
    pts = np.unique(rnd.integers(0, 500, (3000, 2)), axis=0)
    ref = np.unique(np.clip(pts[pts[:, 0] < 150] + [11, -7], 0, 499), axis=0)
    p = spark.createDataFrame([(1, int(x), int(y)) for x, y in pts], "sheet_id long, x int, y int")
    e = spark.createDataFrame([(1, int(x), int(y)) for x, y in ref], "sheet_id long, x int, y int")
    sh = spark.createDataFrame([(1, 500.0, 500.0, 500.0, 500.0)], "sheet_id long, width double, height double, ref_width double, ref_height double")
    got = AL.score_transforms(p, e, sh, tile=256, part=part).first()
    m = got["m"]
    u = np.clip(np.rint(m["a"] * pts[:, 0] + m["b"] * pts[:, 1] + m["tx"]), 0, 499)
    v = np.clip(np.rint(m["c"] * pts[:, 0] + m["d"] * pts[:, 1] + m["ty"]), 0, 499)
    d = [np.minimum(np.hypot(a - ref[:, 0], b - ref[:, 1]).min(), 35.0) for a, b in zip(u, v, strict=True)]
    assert got["score"] == pytest.approx(np.mean(d), abs=1e-6)


def test_suppression_is_the_greedy_rule(spark):
    rnd = random.Random(9)
    rows = [(1, i, float(rnd.randint(0, 200)), float(rnd.randint(0, 200)), float(rnd.randint(10, 200)), float(rnd.randint(10, 200)), float(rnd.randint(1, 400))) for i in range(200)]
    rows += [(1, 1000 + k, 50.0, 50.0, 30.0, 30.0, 5.0) for k in range(20)]
    p = spark.createDataFrame(rows, "sheet_id long, plot_no long, cx double, cy double, bw double, bh double, area_px double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if not any(abs(r[2] - k[2]) < max(14, r[4] * 0.18) and abs(r[3] - k[3]) < max(14, r[5] * 0.18) for k in kept):
            kept.append(r)
    assert {r["plot_no"] for r in PL.suppress_duplicate_plots(p).collect()} == {k[1] for k in kept}


def test_suppression_shuffles_few_bytes_a_plot(spark):
    """A plot looks into few cells and travels without a second copy of its number."""
    n = 20_000
    p = spark.range(n).select((F.col("id") % 20).alias("sheet_id"), (F.col("id") * 7919).alias("plot_no"), (F.rand(1) * 1200).alias("cx"), (F.rand(2) * 900).alias("cy"),
                              (12 + F.col("id") % 60).cast("double").alias("bw"), (10 + F.col("id") % 50).cast("double").alias("bh"), (F.rand(3) * 4000).alias("area_px"))
    p = cut_lineage(p)

    def shuffled():
        e = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))

    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        before = shuffled()
        PL.suppress_duplicate_plots(p).count()
        moved = shuffled() - before
    assert moved < 400 * n


def test_numbering_in_spans(spark, monkeypatch):
    monkeypatch.setattr(PL, "RANK_ROWS", 7)
    df = spark.range(200).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 37 % 101).cast("double").alias("v"))
    got = {(r["g"], r["id"]): r["row_no"] for r in PL.row_numbers(df, ["g"], [F.col("v"), F.col("id")], F.col("v")).collect()}
    for g in (0, 1):
        order = sorted((i for i in range(200) if i % 2 == g), key=lambda i: (i * 37 % 101, i))
        assert [got[(g, i)] for i in order] == list(range(1, 101))


def test_plot_numbers_in_spans(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(1, i, float(rnd.randint(0, 1300)), float(rnd.randint(0, 900))) for i in range(300)]
    p = spark.createDataFrame(rows, "sheet_id long, plot_no long, cx double, cy double")
    sh = spark.createDataFrame([(1, 1200.0, 900.0)], "sheet_id long, width double, height double")
    monkeypatch.setattr(PL, "RANK_ROWS", 9)
    got = [r["plot_no"] for r in PL.number_plots(p, sh).orderBy("plot_index").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (r[3] // 150, r[2], r[1]))]


def test_strip_drawing_modes_agree(monkeypatch):
    ring = [np.array([3.2, 4.7, 40.1, 9.9, 33.3, 51.0, 3.2, 4.7])]
    dense = AL._strip_blocks(ring, 2)
    monkeypatch.setattr(AL, "_BOARD_CELLS", 0)
    sparse = AL._strip_blocks(ring, 2)
    assert dense[3] == sparse[3]
    assert set(zip(*(a.tolist() for a in dense[:3]))) == set(zip(*(a.tolist() for a in sparse[:3])))


def greedy(plots):
    """Plots that stay, one after the other by area."""
    kept = []
    for p in sorted(plots, key=lambda p: (-p[6], p[1])):
        rx, ry = max(14.0, 0.18 * p[4]), max(14.0, 0.18 * p[5])
        if not any(k[0] == p[0] and abs(p[2] - k[2]) < rx and abs(p[3] - k[3]) < ry for k in kept):
            kept.append(p)
    return {(k[0], k[1]) for k in kept}


PLOTS = "sheet_id int, plot_no long, cx double, cy double, bw double, bh double, area_px double"


@pytest.mark.parametrize("at_once", [50_000, 40, 7])
def test_suppression_in_strips(spark, at_once):
    rng = random.Random(at_once)
    rows = [(rng.choice([1, 1, 1, 2]), i, float(rng.randint(0, 300)), float(rng.randint(0, 200)), float(rng.randint(5, 200)), float(rng.randint(5, 90)), float(rng.randint(1, 40))) for i in range(400)]
    got = PL.suppress_duplicate_plots(spark.createDataFrame(rows, PLOTS), at_once).collect()
    assert {(r["sheet_id"], r["plot_no"]) for r in got} == greedy(rows)
    assert PL.suppress_duplicate_plots(spark.createDataFrame([], PLOTS)).collect() == []


def test_suppression_of_a_long_chain_ends_in_few_jobs(spark):
    """100 000 plots in a row, each in reach of the next larger one: every second one stays."""
    i = F.col("id")
    chain = spark.range(100_000).select(F.lit(1).alias("sheet_id"), i.alias("plot_no"), (i * 13.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(1.0).alias("bw"), F.lit(1.0).alias("bh"), (200_000.0 - i).alias("area_px"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = PL.suppress_duplicate_plots(chain).agg(F.count("*").alias("n"), F.sum(F.col("plot_no") % 2).alias("odd")).first()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (got["n"], got["odd"]) == (50_000, 0)
    assert len(jobs) < 60


def test_codes_match_as_far_as_all_pairs_do(spark):
    rng = random.Random(8)
    tgt = [[rng.randrange(65536) for _ in range(8)] for _ in range(300)]
    src = []
    for t in tgt[:200]:
        s = list(t)
        for _ in range(rng.randint(0, 30)):
            s[rng.randrange(8)] ^= 1 << rng.randrange(16)
        src.append(s)
    src += [[0] * 8] * 3 + [tgt[5]]
    tgt += [[0] * 8] * 40  # a crowded list, and a source with many equal targets
    rows = [(1, i, "src", c) for i, c in enumerate(src)] + [(1, 1000 + i, "tgt", c) for i, c in enumerate(tgt)] + [(2, 1, "src", tgt[0]), (2, 2, "tgt", tgt[0]), (3, 1, "src", tgt[0])]
    df = spark.createDataFrame(rows, "sheet_id int, vec_id int, side string, code array<int>")
    d = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    want = set()
    for i, s in enumerate(src):
        near = sorted((d(s, t), 1000 + j) for j, t in enumerate(tgt))
        (d1, j), d2 = near[0], min(near[1][0], 16)
        if d1 < 0.8 * d2:
            want.add((1, i, j, d1, d2))
    for crowd in (1024, 4):
        assert {tuple(r) for r in AL.match_codes(df, crowd=crowd).collect()} == want
        pairs = [tuple(r) for r in AL.code_candidates(df, crowd).collect()]
        assert len(pairs) == len(set(pairs))
    assert len(want) > 50


def test_bytes_to_chunks(spark):
    r = spark.sql("select array(1, 2, 255, 255, 7) e, array() none").select(AL.code_chunks(F.col("e")).alias("c"), AL.code_distance(F.array(F.lit(5)), F.array(F.lit(6))).alias("d")).first()
    assert (r["c"], r["d"]) == ([513, 65535, 7], 2)


@pytest.mark.parametrize("few", [9, 0])
def test_boundary_support_by_tiles_and_by_blocks(spark, monkeypatch, few):
    """Plots in one tile, across tiles, left of the origin and without rings; outlines go to tiles or strips to blocks."""
    monkeypatch.setattr(AL, "_FEW_TILES", few)
    rnd = random.Random(4)
    boxes = [(1, 1, 10.0, 10.0, 30.0, 20.0), (1, 2, 240.0, 250.0, 40.0, 30.0), (1, 3, -20.0, -9.0, 35.0, 25.0), (1, 4, 100.0, 40.0, 700.0, 300.0), (2, 5, 5.0, 5.0, 20.0, 20.0)]
    ring = lambda x, y, w, h: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]
    rows = [(s, n, ring(x, y, w, h)) for s, n, x, y, w, h in boxes] + [(1, 6, None)]
    spots = {(rnd.randint(-30, 820), rnd.randint(-20, 360)) for _ in range(20_000)}
    plots = spark.createDataFrame(rows, f"sheet_id int, plot_no long, rings {R.RINGS_TYPE}")
    foot = spark.createDataFrame([(1, float(x), float(y)) for x, y in spots] * 2, "sheet_id int, px double, py double")
    got = {r["plot_no"]: (r["strip_px"], r["hit_px"], r["iou"]) for r in AL.boundary_support(plots, foot).collect()}
    assert got[6] == (0, 0, 0.82) and got[5][1:] == (0, 0.58)
    for s, n, x, y, w, h in boxes[:4]:
        hit = sum(x - 2 <= a <= x + w + 2 and y - 2 <= b <= y + h + 2 and not (x + 3 <= a <= x + w - 3 and y + 3 <= b <= y + h - 3) for a, b in spots)
        assert got[n][:2] == ((w + 5) * (h + 5) - (w - 5) * (h - 5), hit)


def test_strips_are_drawn_many_at_a_time(monkeypatch):
    """Slanted rings with holes, plots without rings and empty ones: counts equal those of each plot drawn alone, in a few microseconds a plot."""
    import time

    import pyarrow as pa
    rnd = np.random.default_rng(5)

    def ring(n, size):
        a = np.sort(rnd.random(n)) * 2 * np.pi
        q = np.column_stack([np.cos(a), np.sin(a)]) * size + rnd.random(2) * 300 - 20
        return np.concatenate([q, q[:1]]).ravel().tolist()

    flat = [[ring(rnd.integers(3, 9), rnd.integers(1, 60)) for _ in range(rnd.integers(1, 3))] for _ in range(300)] + [None, [], [[]]]
    tiles = [(int(x), int(y)) for x, y in rnd.integers(-1, 2, (len(flat), 2))]
    lit = [{int(k): int(v) for k, v in zip(rnd.choice(1024, 90, False), rnd.integers(-2**62, 2**62, 90))} if rnd.random() < 0.9 else None for _ in flat]
    columns = lambda f, t, b: (pa.array(f, pa.list_(pa.list_(pa.float64()))), pa.array([x for x, _ in t], pa.int64()), pa.array([y for _, y in t], pa.int64()),
                               pa.array([None if v is None else list(v) for v in b], pa.list_(pa.int32())), pa.array([None if v is None else list(v.values()) for v in b], pa.list_(pa.int64())))
    want = []
    for f, (tx, ty), b in zip(flat, tiles, lit, strict=True):
        n = m = 0
        for bx, by, mask in zip(*AL._strip_blocks(f or [], 2)[:3], strict=True):
            if (bx // AL._SIDE, by // AL._SIDE) == (tx, ty):
                n += (int(mask) % 2**64).bit_count()
                m += ((int(mask) & (b or {}).get((bx % AL._SIDE) * AL._SIDE + by % AL._SIDE, 0)) % 2**64).bit_count()
        want.append((n, m))
    got = AL._strip_tiles(*columns(flat, tiles, lit), 2)
    assert list(zip(*(v.tolist() for v in got), strict=True)) == want and sum(n > 0 for n, _ in want) > 50 and sum(m > 0 for _, m in want) > 20
    monkeypatch.setattr(AL, "_DRAWN_PLOTS", 7)
    monkeypatch.setattr(AL, "_DRAWN_PIXELS", 100)
    assert [v.tolist() for v in AL._strip_tiles(*columns(flat, tiles, lit), 2)] == [v.tolist() for v in got]
    monkeypatch.undo()
    # Strips of neighbouring boards do not run into each other, whatever their sizes.
    boxes = [[[5.0, 5.0, 5.0 + w, 5.0, 5.0 + w, 5.0 + h, 5.0, 5.0 + h, 5.0, 5.0]] for w in range(10, 40) for h in range(10, 40)]
    got = AL._strip_tiles(*columns(boxes, [(0, 0)] * 900, [None] * 900), 2)[0]
    assert got.tolist() == [(w + 5) * (h + 5) - (w - 5) * (h - 5) for w in range(10, 40) for h in range(10, 40)]
    box = [[10.0, 10.0, 50.0, 10.0, 50.0, 40.0, 10.0, 40.0, 10.0, 10.0]]
    many = columns([box] * 4000, [(0, 0)] * 4000, [{5: 1}] * 4000)
    t = time.perf_counter()
    AL._strip_tiles(*many, 2)
    assert time.perf_counter() - t < 4000 * 100e-6


@pytest.mark.parametrize("n", [3, 900, 6000])
def test_distance_field_is_exact(n):
    """Few pixels are stamped, many swept; the field holds nothing but capped squared distances."""
    import zlib
    rnd = np.random.default_rng(n)
    side = 128 + 2 * AL._REACH
    y, x = rnd.integers(0, side, n), rnd.integers(0, side, n)
    grid = np.zeros((side, side), bool)
    grid[y, x] = True
    got = AL._distance_field(zlib.compress(np.packbits(grid).tobytes()), 128)
    at = np.arange(128) + AL._REACH
    for r in range(0, 128, 9):
        want = np.minimum(((at[:, None] - x) ** 2 + (r + AL._REACH - y) ** 2).min(axis=1), AL._CAP2)
        assert (got[r] == want).all()


def test_edge_tiles_are_small(spark):
    """What is stored of a reference grows with its edge pixels, not with its area."""
    rnd = np.random.default_rng(1)
    e = spark.createDataFrame([(1, int(x), int(y)) for x, y in rnd.integers(0, 1000, (600, 2))], "sheet_id long, x int, y int")
    rows = AL.edge_tiles(e).collect()
    assert [(r["ty"], r["tx"]) for r in rows] == [(0, 0)] and len(rows[0]["lit"]) < 6000


def test_settling_takes_a_few_microseconds_a_conflict():
    """A sheet's chain of 20 000 plots, each beaten by the one before: every second one goes."""
    import time

    import pandas as pd
    n = 20_000
    pdf = pd.DataFrame({"sheet_id": 1, "strip": 0, "plot_no": np.arange(1, n), "area": np.arange(n - 1, 0, -1.0), "big": np.arange(n - 1), "state": np.where(np.arange(n - 1) == 0, 1, -1)})
    begun = time.process_time()
    got = PL._settle(pdf.sample(frac=1.0, random_state=3))
    spent = time.process_time() - begun
    assert got["stays"].tolist() == [i % 2 for i in range(n - 1)] and got["plot_no"].tolist() == list(range(1, n))
    assert spent < 0.5


def test_largest_part_shuffles_rings_only_for_readers(spark):
    from landloom.operators.aggregates import largest_part
    part = lambda x, y: R.rect_rings(*(F.lit(float(v)) for v in (0, 0, x, y)))
    p = spark.range(3).select(F.col("id").alias("parcel_id"), F.posexplode(F.array(part(1, 2), part(2, 2), part(4, 1))).alias("part_no", "rings"))
    got = largest_part(p)
    assert {(r["parcel_id"], r["part_no"], r["rings"][0][2]["x"]) for r in got.collect()} == {(i, 1, 2.0) for i in range(3)}
    plan = got.select("parcel_id", "part_no")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan


@pytest.mark.parametrize("crowd", [256, 2])
def test_nearest_point_looks_into_one_cell(spark, crowd):
    """Brute force, negative places and references exactly ``r`` away included; a reference stands in at most four cells."""
    rnd = random.Random(crowd)
    spots = lambda n: [(1, float(rnd.randint(-40, 40)), float(rnd.randint(-40, 40))) for _ in range(n)]
    pts, refs = spots(300) + [(1, 100.0, 100.0)], spots(60) + [(1, 105.0, 100.0)]
    p, q = spark.createDataFrame(pts, "k int, px double, py double"), spark.createDataFrame(refs, "k int, rx double, ry double")
    near = lambda x, y: min(((math.hypot(x - a, y - b), a, b) for _, a, b in refs if math.hypot(x - a, y - b) <= 5), default=None)
    want = {(x, y): near(x, y) for _, x, y in pts if near(x, y)}
    found = SP.nearest_point(p, q, 5.0, ["k"], crowd=crowd, refine=8 if crowd > 2 else 2)
    got = {(r["px"], r["py"]): (r["distance"], r["value"]["x"], r["value"]["y"]) for r in found.collect()}
    assert got == want and got[100.0, 100.0] == (5.0, 105.0, 100.0)


def test_small_shapes_are_cut_alike_by_plain_and_array_forms(monkeypatch):
    rnd = np.random.default_rng(17)

    def shape(crossed):
        a = np.sort(rnd.uniform(0, 2 * np.pi, rnd.integers(3, 9)))
        p = rnd.integers(0, 6, 2) + np.round(rnd.uniform(1, 3) * np.column_stack([np.cos(a), np.sin(a)]), rnd.integers(0, 3))
        p = rnd.permutation(p) if crossed else p
        return [np.vstack([p, p[:1]]).ravel()]

    cases = [(shape(i % 5 == 0), [shape(False) for _ in range(rnd.integers(0, 4))]) for i in range(400)]
    run = lambda: [[[np.asarray(r) for r in p] for p in T._clean_one(t, near, 0.05, True)] for t, near in cases] + [
        [[np.asarray(r) for r in p] for p in T.repair(t)] for t, _ in cases]
    few = run()
    monkeypatch.setattr(T.S, "FEW", 0)
    many = run()
    assert [[[len(r) for r in p] for p in c] for c in few] == [[[len(r) for r in p] for p in c] for c in many]
    assert all(np.allclose(a, b, atol=1e-9) for c, d in zip(few, many) for p, q in zip(c, d) for a, b in zip(p, q))


def test_repairs_are_spread_over_tasks(spark):
    tie = "array(array(named_struct('x', id * 3D, 'y', 0D), named_struct('x', id * 3D + 1, 'y', 1D), named_struct('x', id * 3D + 1, 'y', 0D), named_struct('x', id * 3D, 'y', 1D), named_struct('x', id * 3D, 'y', 0D)))"
    one = spark.range(0, 64, 1, 1).selectExpr("id AS parcel_id", f"{tie} AS rings")
    fixed = T.make_valid(one)
    assert fixed.rdd.getNumPartitions() > 2 and fixed.filter("repaired").count() == 128


def test_robust_fits_are_dealt_to_tasks_by_their_matches(spark, monkeypatch):
    m = spark.range(0, 4000).selectExpr("id % 40 AS sheet_id", "CAST(id AS STRING) AS match_id", "CAST(id * 7 % 997 AS DOUBLE) AS sx", "CAST(id * 13 % 991 AS DOUBLE) AS sy").selectExpr(
        "*", "sx + 3D + IF(sheet_id = 0, sy, 0D) AS tx", "sy - 2D AS ty")
    plain = {r.sheet_id: r for r in AL.fit_robust(m).collect()}
    held, cut = [], AL.cut_lineage
    monkeypatch.setattr(AL, "TASK_MATCHES", 100)
    monkeypatch.setattr(AL, "cut_lineage", lambda df: (held.append(df.rdd.getNumPartitions()), cut(df))[1])
    dealt = {r.sheet_id: r for r in AL.fit_robust(m).collect()}
    assert max(held) >= 40 and plain.keys() == dealt.keys()
    assert all(plain[k].inliers == dealt[k].inliers == 100 and np.allclose(plain[k].h, dealt[k].h, atol=1e-6) for k in plain)
    monkeypatch.setattr(AL, "TASK_MATCHES", 50)  # every sheet alone has more
    assert {r.sheet_id: r.inliers for r in AL.fit_robust(m).collect()} == {k: 100 for k in plain}
