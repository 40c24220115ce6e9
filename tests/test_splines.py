"""Thin-plate splines against a dense least-squares solve of the textbook system."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import rings as R
from landloom.operators import alignment as AL
from landloom.operators import splines as SP

GCPS = "sheet_id long, gcp_id string, sx double, sy double, tx double, ty double"


def textbook(src, dst, at):
    """Every point with a ridge of its own, places that repeat included, in extended precision."""
    src, dst, at = (np.asarray(v, dtype=np.longdouble) for v in (src, dst, at))
    n = len(src)
    p = np.column_stack([np.ones(n, np.longdouble), src])
    left = np.block([[SP.kernel(src, src) + np.longdouble(SP.RIDGE) * np.eye(n, dtype=np.longdouble), p], [p.T, np.zeros((3, 3), np.longdouble)]])
    m = np.hstack([left, np.vstack([dst, np.zeros((3, 2), np.longdouble)])])
    for c in range(n + 3):
        r = c + np.abs(m[c:, c]).argmax()
        m[[c, r]] = m[[r, c]]
        m[c] /= m[c, c]
        others = np.arange(n + 3) != c
        m[others] -= np.outer(m[others, c], m[c])
    sol = m[:, -2:]
    return (SP.kernel(at, src) @ sol[:n] + np.column_stack([np.ones(len(at), np.longdouble), at]) @ sol[n:]).astype(float)


def table(spark, sheets):
    rows = [(s, f"{s}-{i}", *map(float, (*a, *b))) for s, (src, dst) in sheets.items() for i, (a, b) in enumerate(zip(src, dst))]
    return spark.createDataFrame(rows, GCPS)


def bent(rnd, n, spot=None):
    src = rnd.uniform(0, 1000, (n, 2)) if spot is None else np.vstack([rnd.uniform(0, 1000, (n // 2, 2)), rnd.normal(spot, 40, (n - n // 2, 2))])
    dst = src + np.column_stack([4 * np.sin(src[:, 1] / 90), 3 * np.cos(src[:, 0] / 70)]) + rnd.normal(0, 0.05, src.shape)
    return src, dst


def warped(spark, fits, points):
    rows = [(s, i, float(x), float(y)) for s, at in points.items() for i, (x, y) in enumerate(at)]
    out = SP.apply_tps(spark.createDataFrame(rows, "sheet_id long, i long, x double, y double"), fits, chunk=30).orderBy("sheet_id", "i").collect()
    return {s: np.array([[r["wx"], r["wy"]] for r in out if r["sheet_id"] == s]) for s in points}


def test_one_solve_and_iteration_agree_with_the_textbook(spark):
    """Sheets beyond one system, one crowded in a corner, give the same surface as a dense solve."""
    rnd = np.random.default_rng(5)
    sheets = {1: bent(rnd, 240), 2: bent(rnd, 160, spot=150.0), 3: bent(rnd, 25)}
    # Repeated places. Those with other targets are on a small sheet, where the textbook system is sound enough to tell.
    src, dst = sheets[1]
    sheets[1] = (np.vstack([src, src[:9]]), np.vstack([dst, dst[:9]]))
    src = rnd.uniform(0, 1, (12, 2))
    sheets[4] = (np.vstack([src, src[:5], src[:2]]), np.vstack([src, src[:5] + 0.2, src[:2] - 0.3]))
    g = table(spark, sheets).withColumn("plane", F.lit("clashing name"))
    at = {s: rnd.uniform(50, 950, (60, 2)) / (1000 if s == 4 else 1) for s in sheets}
    want = {s: textbook(*sheets[s], at[s]) for s in sheets}
    for direct, block in ((1024, 4096), (128, 130)):
        fits = spark.createDataFrame(SP.fit_tps(g, direct=direct, block=block).collect(), SP.fit_tps(g).schema)
        rows = fits.collect()
        assert {r["method"] for r in rows} == {"thin_plate_spline"} and max(r["residual"] for r in rows) < 1e-8
        assert {r["sheet_id"]: r["n"] for r in rows} == {s: len(v[0]) for s, v in sheets.items()}
        assert (len(rows) > len(sheets)) == (block < 240)
        got = warped(spark, fits, at)
        for s in sheets:
            assert np.abs(got[s] - want[s]).max() < 1e-6, s


def test_few_line_and_bad_points(spark):
    """One place, a line, two points, one point, unknown sheets, null and non-finite coordinates."""
    line = np.array([[float(i), 2.0 * i] for i in range(12)])
    sheets = {1: (np.array([[5.0, 5.0]] * 4), np.array([[1.0, 2.0], [3.0, 2.0], [1.0, 2.0], [3.0, 2.0]])), 2: (line, line * 3 + 1),
              3: (line[:2], line[:2] + [2.0, -1.0]), 4: (line[:1], line[:1] + 7)}
    bad = spark.createDataFrame([(2, "n", None, 1.0, 1.0, 1.0), (2, "i", float("inf"), 1.0, 1.0, 1.0), (2, "a", 1.0, 1.0, float("nan"), 1.0),
                                 (None, "k", 1.0, 1.0, 1.0, 1.0), (5, "o", None, 1.0, 1.0, 1.0)], GCPS)
    fits = SP.fit_tps(table(spark, sheets).union(bad))
    by = {r["sheet_id"]: r for r in fits.collect()}
    assert {s: (r["method"], r["n"]) for s, r in by.items()} == {1: ("thin_plate_spline", 4), 2: ("thin_plate_spline", 12), 3: ("offset", 2), 4: ("identity", 1)}
    assert by[1]["rmse"] == pytest.approx(1.0) and by[2]["rmse"] < 1e-6 and by[3]["rmse"] < 1e-9
    got = warped(spark, fits, {1: [[5, 5]], 2: [[3.5, 7]], 3: [[1, 1]], 4: [[1, 1]], 6: [[8, 9]]})
    assert np.allclose(got[1], [[2, 2]], atol=1e-6) and np.allclose(got[2], [[11.5, 22]], atol=1e-5)
    assert np.allclose(got[3], [[3, 0]]) and np.allclose(got[4], [[1, 1]]) and np.allclose(got[6], [[8, 9]])
    assert SP.fit_tps(bad.filter("sheet_id = 5")).count() == 0 and SP.apply_tps(bad.limit(0), fits, x="sx", y="sy").count() == 0


def test_rings_keep_shape_and_other_columns(spark):
    rnd = np.random.default_rng(3)
    g = table(spark, {1: bent(rnd, 30)})
    p = spark.range(6).select(F.col("id").alias("parcel_id"), F.when(F.col("id") < 4, 1).otherwise(None).cast("long").alias("sheet_id"),
                              F.lit(2**60 + 1).alias("big"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("legacy_props"),
                              R.rect_rings(F.col("id") * 9.0, F.lit(3.0), F.col("id") * 9.0 + 5, F.lit(8.0)).alias("rings"))
    p = p.withColumn("rings", F.when(F.col("parcel_id") == 2, F.concat("rings", "rings")).when(F.col("parcel_id") != 3, F.col("rings")))
    fits = SP.fit_tps(g)
    out = {r["parcel_id"]: r for r in SP.warp_rings(p, fits).collect()}
    assert len(out) == 6 and out[3]["rings"] is None and out[0]["big"] == 2**60 + 1 and out[1]["legacy_props"] == {"a": "1"}
    assert [len(r) for r in out[2]["rings"]] == [5, 5] and out[2]["rings"][0] == out[2]["rings"][1]
    assert out[5]["rings"][0][0]["x"] == 45.0
    flat = warped(spark, fits, {1: [[9.0, 3.0], [14.0, 8.0]]})[1]
    assert [(q["x"], q["y"]) for q in (out[1]["rings"][0][0], out[1]["rings"][0][2])] == [pytest.approx(tuple(v)) for v in flat]


def test_align_repairs_what_the_warp_folds(spark):
    """Control points that swap two corners make a square cross itself; its larger half stays."""
    src = [(0, 0), (10, 0), (10, 10), (0, 10), (40, 40), (-40, 40), (40, -40), (-40, -40)]
    dst = [(0, 0), (10, 0), (2, 10), (8, 10), (40, 40), (-40, 40), (40, -40), (-40, -40)]
    p = spark.range(2).select(F.col("id").alias("parcel_id"), F.lit(1).cast("long").alias("sheet_id"), R.rect_rings(F.col("id") * 20.0, F.col("id") * 20.0, F.col("id") * 20.0 + 10, F.col("id") * 20.0 + 10).alias("rings"))
    done, failed = AL.align_parcels(p, table(spark, {1: (src, dst)}))
    rows = {r["parcel_id"]: r for r in done.withColumn("ok", F.forall("rings", R.is_simple)).withColumn("area", R.planar_area(F.col("rings"))).collect()}
    # The edges (10, 0)-(2, 10) and (8, 10)-(0, 0) cross at y = 25 / 4: the half below has base 10.
    assert rows[0]["ok"] and rows[0]["area"] == pytest.approx(125 / 4, rel=1e-4) and rows[1]["ok"] and failed.count() == 0
    assert rows[0]["method"] == "thin_plate_spline" and rows[0]["alignment_status"] == "ALIGNED_DRAFT"


def test_sheets_of_a_thousand_places_and_more_are_one_system(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    g = table(spark, {1: bent(rnd, 1300), 2: bent(rnd, 600)})
    monkeypatch.setattr(SP, "_iterate", None)
    fits = SP.fit_tps(g).select("sheet_id", "n", "rmse").collect()
    assert sorted((r.sheet_id, r.n) for r in fits) == [(1, 1300), (2, 600)] and all(r.rmse < 1e-3 for r in fits)


def test_kernel_is_zero_at_distance_zero():
    a = np.array([[0.0, 0.0], [3.0, 4.0], [1e-200, 0.0]])
    k = SP.kernel(a, a)
    assert np.allclose(k[0], [0.0, 12.5 * np.log(25.0), 0.0]) and (k == k.T).all()
