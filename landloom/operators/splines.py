"""Thin-plate splines through the control points of a sheet, whatever their number.

Points at one place count as one knot: with m of them the ridge there is ``RIDGE / m`` and the value their
mean, which gives the same surface. Sheets of up to ``direct`` places are one linear system in one task.
Larger ones are solved by iteration over all tasks, to the same surface: residuals are corrected by local
splines on overlapping cells and by a coarse spline over points of every cell, products with the kernel are
partial sums over pairs of blocks, and the step lengths are a small least-squares problem over the latest
directions. The work of a product is quadratic in the places of a sheet; no task holds more than two blocks.

Points with a null or non-finite coordinate or without a sheet do not count; a sheet without any other has no row. Places on
one line take the flattest plane through them. Extra columns of ``gcps`` are not read."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import rings as R
from ..session import cut_lineage, spread

# Fixed value: the ridge of a knot.
RIDGE = 1e-6
# Places of the largest system one task solves (about 100 MB of memory), and of local and coarse systems of the iteration.
DIRECT, LOCAL = 2048, 1024
# Places in a block of a kernel product, and knots in a row of the result.
BLOCK = 4096
# Directions kept for the step lengths, and the share of the first residual at which a sheet is done.
MEMORY, TOLERANCE = 40, 1e-10
AXES = ("0", "1")


# ---- small systems -------------------------------------------------------------------------------

def kernel(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """r² log r between all places, a few rows at a time, so that what lies between stays in the cache."""
    kind = np.result_type(a, b)
    out = np.empty((len(a), len(b)), kind) if out is None else out
    bx, by = np.ascontiguousarray(b[:, 0]), np.ascontiguousarray(b[:, 1])
    rows = max(1, min(len(a), 8192 // max(1, len(b))))
    one, two = np.empty((rows, len(b)), kind), np.empty((rows, len(b)), kind)
    for lo in range(0, len(a), rows):
        p = a[lo:lo + rows]
        r2, t = one[:len(p)], two[:len(p)]
        np.subtract(p[:, :1], bx, out=r2)
        np.multiply(r2, r2, out=r2)
        np.subtract(p[:, 1:2], by, out=t)
        np.multiply(t, t, out=t)
        np.add(r2, t, out=r2)
        np.maximum(r2, 1e-300, out=t)
        np.log(t, out=t)
        np.multiply(r2, 0.5, out=r2)
        np.multiply(r2, t, out=out[lo:lo + rows])
    return out


def solve_knots(xy: np.ndarray, ridge: np.ndarray, values: np.ndarray, moments: np.ndarray | None = None):
    """Weights and plane of the spline with ``values`` at ``xy``; the weights' moments against (1, x, y)
    are ``moments`` (default none). Also the directions that planes over these places leave open."""
    n = len(xy)
    plane = np.column_stack([np.ones(n), xy])
    u, s, vt = np.linalg.svd(plane, full_matrices=False)
    held = s > 1e-10 * s[0]
    back = vt[held].T / s[held]
    system = np.zeros((n + held.sum(), n + held.sum()))
    k = kernel(xy, xy, system[:n, :n])
    unit = max(k.max(), -k.min(), 1e-300)
    system[np.arange(n), np.arange(n)] += ridge
    system[:n, n:] = u[:, held] * unit
    system[n:, :n] = u[:, held].T
    right = np.zeros((len(system), values.shape[1]))
    right[:n] = values
    if moments is not None:
        right[n:] = back.T @ moments
    sol = np.linalg.solve(system, right)
    everything = np.linalg.svd(plane.T @ plane)[2] if held.sum() < 3 else np.eye(3)
    return sol[:n], back @ (sol[n:] * unit), everything[held.sum():]


def plane_of(coef: np.ndarray, spread_of: np.ndarray, cx: float, cy: float, s: float, open_: np.ndarray) -> np.ndarray:
    """The plane over centred and scaled places as one over raw places, (3, 2); ``spread_of`` is the sum of
    weight times squared distance from the centre, which scaling moves from the kernel to the plane."""
    to_raw = np.array([[1.0, -s * cx, -s * cy], [0.0, s, 0.0], [0.0, 0.0, s]])
    coef = coef.copy()
    coef[0] += np.log(s) * spread_of
    out = to_raw @ coef
    if len(open_):
        q = np.linalg.qr(to_raw @ open_.T)[0]
        out -= q @ (q.T @ out)
    return out


# ---- places --------------------------------------------------------------------------------------

def knot_places(gcps: DataFrame, key: str) -> DataFrame:
    """Distinct places of each sheet, centred and scaled to a unit box, with mean targets."""
    names = ("sx", "sy", "tx", "ty")
    g = gcps.select(key, *[F.col(c).cast("double").alias(c) for c in names]).filter(F.col(key).isNotNull())
    for c in names:
        g = g.filter(F.abs(c) < float("inf"))
    # Written once, so that the points are not read and grouped again for the frames.
    at = cut_lineage(g.groupBy(key, "sx", "sy").agg(F.count("*").alias("m"), *[F.avg(t).alias(f"v{i}") for i, t in zip(AXES, ("tx", "ty"))],
                                                    (F.var_pop("tx") + F.var_pop("ty")).alias("_var")))
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    width = F.greatest(F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy"))
    frame = at.groupBy(key).agg(
        F.sum("m").alias("n"), F.count("*").alias("k"), mid("sx").alias("cx"), mid("sy").alias("cy"),
        F.when(width > 0, 1 / width).otherwise(1.0).alias("s"), F.sum(F.col("m") * F.col("_var")).alias("within"))
    placed = at.drop("_var").join(frame, key)
    return placed.withColumns({"x": (F.col("sx") - F.col("cx")) * F.col("s"), "y": (F.col("sy") - F.col("cy")) * F.col("s"),
                               "ridge": RIDGE * F.col("s") * F.col("s") / F.col("m")})


def fit_tps(gcps: DataFrame, key: str = "sheet_id", direct: int = DIRECT, block: int = BLOCK, rounds: int = 60) -> DataFrame:
    """Spline of every sheet: one row for each ``block`` of its knots, with n (points), method, plane
    (6 doubles), knots (sx, sy, wx, wy …), rmse (what the fit leaves on its points) and residual (what is
    left of the equations, as a share of the values' distance from a plane).

    From three points up the method is thin_plate_spline. Two points give their mean offset, one the
    identity; these have no knots."""
    places = cut_lineage(knot_places(gcps, key))
    key_type = dict(gcps.dtypes)[key]
    schema = f"`{key}` {key_type}, n bigint, method string, plane array<double>, knots array<double>, rmse double, residual double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sx", "sy"])
        f = pdf.iloc[0]
        xy, ridge, values = pdf[["x", "y"]].to_numpy(), pdf["ridge"].to_numpy(), pdf[["v0", "v1"]].to_numpy()
        w, plane, open_ = solve_knots(xy, ridge, values)
        raw = plane_of(plane, (w * (xy ** 2).sum(axis=1, keepdims=True)).sum(axis=0), f["cx"], f["cy"], f["s"], open_)
        left = f["within"] + (pdf["m"].to_numpy()[:, None] * (ridge[:, None] * w) ** 2).sum()
        knots = np.column_stack([pdf["sx"], pdf["sy"], w * f["s"] ** 2])
        parts = [knots[lo:lo + block].ravel() for lo in range(0, len(knots), block)]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(parts), "n": int(f["n"]), "method": "thin_plate_spline", "plane": [raw.T.ravel()] * len(parts),
                             "knots": parts, "rmse": float(np.sqrt(max(left, 0.0) / f["n"])), "residual": 0.0})

    small = spread(places.filter((F.col("n") >= 3) & (F.col("k") <= direct)), key).groupBy(key).applyInPandas(solve, schema)
    out = small.unionByName(_few(places, key))
    large = places.filter((F.col("n") >= 3) & (F.col("k") > direct))
    if large.isEmpty():
        return out
    return out.unionByName(_iterate(large, key, key_type, schema, min(direct, LOCAL), block, rounds))


def _few(places: DataFrame, key: str) -> DataFrame:
    mean = lambda t, s: F.sum(F.col("m") * (F.col(t) - F.col(s))) / F.sum("m")
    two = places.filter("n < 3").groupBy(key).agg(F.max("n").alias("n"), mean("v0", "sx").alias("dx"), mean("v1", "sy").alias("dy"),
                                                  (F.sum(F.col("m") * ((F.col("v0") - F.col("sx")) ** 2 + (F.col("v1") - F.col("sy")) ** 2)) + F.max("within")).alias("square"))
    off = lambda c: F.when(F.col("n") == 2, F.col(c)).otherwise(0.0)
    left = F.col("square") / F.col("n") - off("dx") ** 2 - off("dy") ** 2
    return two.select(key, "n", F.when(F.col("n") == 2, "offset").otherwise("identity").alias("method"),
                      F.array(off("dx"), F.lit(1.0), F.lit(0.0), off("dy"), F.lit(0.0), F.lit(1.0)).alias("plane"),
                      F.array().cast("array<double>").alias("knots"), F.sqrt(F.greatest(F.lit(0.0), left)).alias("rmse"), F.lit(0.0).alias("residual"))


# ---- iteration -----------------------------------------------------------------------------------

def _middle(c: str):
    return F.percentile_approx(c, 0.5, 10_000)


def cells(points: DataFrame, key: str, size: int) -> DataFrame:
    """``cell`` of each point: sheets are halved at the median of the wider side until no cell has more
    than ``size`` places. One grouped pass a level."""
    at = points.withColumn("cell", F.lit(0).cast("bigint"))
    while True:
        at = cut_lineage(at)
        box = at.groupBy(key, "cell").agg(F.count("*").alias("_c"), *[f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max), ("mid", _middle))])
        box = cut_lineage(box.filter(F.col("_c") > size))
        if box.isEmpty():
            return at
        wide = F.col("_hix") - F.col("_lox") >= F.col("_hiy") - F.col("_loy")
        p, mid, hi = (F.when(wide, F.col(a)).otherwise(F.col(b)) for a, b in (("x", "y"), ("_midx", "_midy"), ("_hix", "_hiy")))
        right = F.when(mid == hi, p >= mid).otherwise(p > mid).cast("bigint")
        at = at.join(box, [key, "cell"], "left").withColumn("cell", F.when(F.col("_c").isNull(), F.col("cell")).otherwise(
            2 * F.col("cell") + 1 + right)).select(at.columns)


def domains(points: DataFrame, key: str, size: int) -> DataFrame:
    """Points of each cell (``own``) and those nearest its box, ``2 * size`` together. Boxes grown by half
    their wider side meet points on squares of about that side; points look up the sides in use."""
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9))
    box = points.groupBy(key, "cell").agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))], side.alias("side"))
    box = box.withColumn("level", F.ceil(F.log2("side")).cast("int"))
    unit = F.pow(F.lit(2.0), F.col("level"))
    at = lambda v: F.floor(v / unit).cast("bigint")
    steps = lambda c: F.explode(F.sequence(at(F.col(f"lo{c}") - F.col("side") / 2), at(F.col(f"hi{c}") + F.col("side") / 2)))
    seen = box.withColumn("gx", steps("x")).withColumn("gy", steps("y")).withColumnRenamed("cell", "home")
    levels = box.groupBy(key).agg(F.collect_set("level").alias("_levels"))
    asked = points.join(levels, key).withColumn("level", F.explode("_levels")).drop("_levels").withColumn("gx", at(F.col("x"))).withColumn("gy", at(F.col("y")))
    out = lambda c: F.greatest(F.lit(0.0), F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}"))
    met = asked.join(seen, [key, "level", "gx", "gy"]).withColumn("own", F.col("cell") == F.col("home")).withColumn(
        "far", F.when(F.col("own"), -1.0).otherwise(F.hypot(out("x"), out("y"))))
    rank = F.row_number().over(Window.partitionBy(key, "home").orderBy("far", "pid"))
    return met.filter(F.col("far") <= F.col("side") / 2).withColumn("_r", rank).filter(F.col("_r") <= 2 * size).select(key, "home", "pid", "own", "x", "y", "ridge")


def product(targets: DataFrame, sources: DataFrame, columns: list[str], key: str, block: int) -> DataFrame:
    """Kernel times ``columns`` at every target: pairs of blocks in tasks of their own, summed by ``pid``.
    Both sides carry ``k``, the places of their sheet, which says how many blocks there are."""
    blocks = F.ceil(F.col("k") / block).cast("int")
    own = lambda d: d.withColumn("_own", F.pmod(F.xxhash64("pid"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    t = own(targets.select(key, "k", "pid", "x", "y")).select(key, F.col("_own").alias("_t"), F.col("_other").alias("_s"), "pid", "x", "y")
    s = own(sources.select(key, "k", "pid", "x", "y", *columns)).select(key, F.col("_other").alias("_t"), F.col("_own").alias("_s"), "x", "y", *columns)

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(a), len(columns)))
        if len(a) and len(b):
            p, q, w = a[["x", "y"]].to_numpy(), b[["x", "y"]].to_numpy(), b[columns].to_numpy()
            for lo in range(0, len(a), 512):
                out[lo:lo + 512] = kernel(p[lo:lo + 512], q) @ w
        return pd.DataFrame(out, columns=columns).assign(pid=a["pid"].to_numpy())

    keys = [key, "_t", "_s"]
    parts = spread(t, *keys).groupBy(*keys).cogroup(spread(s, *keys).groupBy(*keys)).applyInPandas(
        multiply, ", ".join(f"{c} double" for c in columns) + ", pid bigint")
    return parts.groupBy("pid").agg(*[F.sum(c).alias(f"a_{c}") for c in columns])


def _grams(key: str, axis: str):
    """Partial Gram matrices of 1, x, y, the kept products and the residual, one a sheet in each chunk."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, g in pdf.groupby(key, sort=False, dropna=False):
                kept = np.stack(g[f"q{axis}"].to_numpy()) if len(g) else np.zeros((0, 0))
                u = np.column_stack([np.ones(len(g)), g["x"], g["y"], kept, g[f"r{axis}"]])
                yield pd.DataFrame({key: [k], "axis": int(axis), "gram": [(u.T @ u).ravel()], "top": [float(np.abs(g[f"r{axis}"]).max())]})
    return run


def _steps(state: DataFrame, key: str, key_type: str) -> DataFrame:
    """Least-squares lengths per sheet and axis: of 1, x, y and each kept product."""
    partial = f"`{key}` {key_type}, axis int, gram array<double>, top double"
    both = None
    for axis in AXES:
        one = state.select(key, "x", "y", f"q{axis}", f"r{axis}").mapInPandas(_grams(key, axis), partial)
        both = one if both is None else both.unionByName(one)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)
        d = int(round(len(flat) ** 0.5))
        gram = flat.reshape(d, d)
        size = np.sqrt(np.diag(gram)[:-1])
        size = np.where(size > 0, size, 1.0)
        c = np.linalg.lstsq(gram[:-1, :-1] / np.outer(size, size), gram[:-1, -1] / size, rcond=1e-14)[0] / size
        return pd.DataFrame({key: [pdf[key].iloc[0]], "axis": [int(pdf["axis"].iloc[0])], "c": [c], "top": [pdf["top"].max()], "moments": [gram[:3, :3].ravel()]})

    done = both.groupBy(key, "axis").applyInPandas(solve, f"`{key}` {key_type}, axis int, c array<double>, top double, moments array<double>")
    return done.groupBy(key).agg(*[F.max(F.when(F.col("axis") == int(a), F.col(v))).alias(f"{v}{a}") for a in AXES for v in ("c", "top")],
                                 F.max("moments").alias("moments"))


def _advance(state: DataFrame, key: str, key_type: str) -> DataFrame:
    """Residuals and weights after the best step over the kept directions and planes."""
    steps = _steps(state, key, key_type)
    out = state.join(steps.select(key, "c0", "c1"), key)

    def total(a: str, v: str):
        lengths = F.slice(f"c{a}", F.lit(4), F.size(f"{v}{a}"))
        return F.aggregate(F.zip_with(lengths, f"{v}{a}", lambda c, x: c * x), F.lit(0.0), lambda t, x: t + x)

    c = {a: F.col(f"c{a}") for a in AXES}
    return out.withColumns({**{f"r{a}": F.col(f"r{a}") - c[a][0] - c[a][1] * F.col("x") - c[a][2] * F.col("y") - total(a, "q") for a in AXES},
                            **{f"w{a}": F.col(f"w{a}") + total(a, "z") for a in AXES}}).drop("c0", "c1")


def _directions(state: DataFrame, local: DataFrame, key: str, key_type: str, block: int) -> DataFrame:
    """Two new directions per point and axis (z) with their products (q): local splines' weights at their
    own points, and at all their points, both corrected by the coarse spline."""
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        w = solve_knots(pdf[["x", "y"]].to_numpy(), pdf["ridge"].to_numpy(), pdf[["r0", "r1"]].to_numpy())[0]
        own = pdf["own"].to_numpy()[:, None]
        return pd.DataFrame(np.hstack([np.where(own, w, 0.0), w]), columns=names).assign(pid=pdf["pid"].to_numpy())

    names = ["o0", "o1", "t0", "t1"]
    parts = spread(local.join(state.select("pid", "r0", "r1"), "pid"), key, "home").groupBy(key, "home").applyInPandas(
        settle, ", ".join(f"{c} double" for c in names) + ", pid bigint").groupBy("pid").agg(*[F.sum(c).alias(c) for c in names])
    at = cut_lineage(state.select(key, "k", "pid", "x", "y", "ridge", "coarse", "r0", "r1").join(parts, "pid"))
    at = cut_lineage(at.join(product(at, at, names, key, block), "pid").withColumns(
        {f"a_{c}": F.col(f"a_{c}") + F.col("ridge") * F.col(c) for c in names}))
    moments = at.groupBy(key).agg(*[F.sum(f * F.col(c)).alias(f"m{i}_{c}") for c in ("o0", "o1") for i, f in enumerate((F.lit(1.0), F.col("x"), F.col("y")))])

    def correct(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, r = pdf[["x", "y"]].to_numpy(), pdf[["r0", "r1", "r0", "r1"]].to_numpy() - pdf[[f"a_{c}" for c in names]].to_numpy()
        left = np.zeros((3, 4))
        left[:, :2] = -pdf[[f"m{i}_{c}" for i in range(3) for c in ("o0", "o1")]].iloc[0].to_numpy(float).reshape(3, 2)
        w, _, open_ = solve_knots(xy, pdf["ridge"].to_numpy(), r, left)
        return pd.DataFrame(w, columns=names).assign(pid=pdf["pid"].to_numpy(), x=xy[:, 0], y=xy[:, 1], k=pdf["k"].to_numpy(), flat=bool(len(open_)), **{key: pdf[key].to_numpy()})

    fix = cut_lineage(spread(at.filter("coarse").join(moments, key), key).groupBy(key).applyInPandas(
        correct, f"`{key}` {key_type}, k bigint, pid bigint, x double, y double, flat boolean, " + ", ".join(f"{c} double" for c in names)))
    more = product(at, fix, names, key, block)
    again = fix.select("pid", *[F.col(c).alias(f"f_{c}") for c in names])
    # Moments of the first direction cannot be mended by places on one line; it is left out there.
    flat = fix.groupBy(key).agg(F.max("flat").alias("flat"))
    out = at.join(more.select("pid", *[F.col(f"a_{c}").alias(f"b_{c}") for c in names]), "pid").join(again, "pid", "left").join(flat, key)
    f = lambda c: F.coalesce(F.col(f"f_{c}"), F.lit(0.0))
    z = {c: F.col(c) + f(c) for c in names}
    q = {c: F.col(f"a_{c}") + F.col(f"b_{c}") + F.col("ridge") * f(c) for c in names}
    pair = lambda v, a: F.array(F.when(F.col("flat"), 0.0).otherwise(v[f"o{a}"]), v[f"t{a}"])
    return out.select("pid", *[pair(v, a).alias(f"new_{n}{a}") for n, v in (("q", q), ("z", z)) for a in AXES])


def _iterate(places: DataFrame, key: str, key_type: str, schema: str, direct: int, block: int, rounds: int) -> DataFrame:
    size = max(8, direct // 2)
    points = cells(cut_lineage(places.withColumn("pid", F.monotonically_increasing_id())), key, size)
    sheets = points.groupBy(key).agg(F.countDistinct("cell").alias("_cells"))
    rank = F.row_number().over(Window.partitionBy(key, "cell").orderBy(F.xxhash64("pid"), "pid"))
    share = F.greatest(F.lit(1), F.floor(F.lit(direct) / F.col("_cells")))
    kept = F.pmod(F.xxhash64("cell"), F.ceil(F.col("_cells") / direct)) == 0
    points = cut_lineage(points.join(sheets, key).withColumn("coarse", (rank <= share) & kept).drop("_cells"))
    local = cut_lineage(domains(points, key, size))
    none = F.array().cast("array<double>")
    state = points.select(key, "pid", "k", "x", "y", "ridge", "coarse", *[F.col(f"v{a}").alias(f"r{a}") for a in AXES], *[F.lit(0.0).alias(f"w{a}") for a in AXES],
                          *[none.alias(f"{v}{a}") for v in "qz" for a in AXES])
    state = cut_lineage(_advance(state, key, key_type))
    worst = F.max(F.greatest(F.abs("r0"), F.abs("r1")))
    first = cut_lineage(state.groupBy(key).agg(worst.alias("first")))
    weights = []
    for turn in range(rounds + 1):
        busy = state.groupBy(key).agg(worst.alias("_top")).join(first, key).filter(F.col("_top") > TOLERANCE * F.col("first")).select(key)
        busy = cut_lineage(busy if turn < rounds else busy.limit(0))
        weights.append(state.join(busy, key, "left_anti").select("pid", "w0", "w1"))
        if busy.isEmpty():
            break
        state = cut_lineage(state.join(busy, key, "left_semi"))
        new = _directions(state, local, key, key_type, block)
        latest = lambda v: F.slice(v, F.greatest(F.lit(1), F.size(v) - MEMORY + 1), F.lit(MEMORY))
        longer = state.join(new, "pid").withColumns({f"{v}{a}": latest(F.concat(f"{v}{a}", f"new_{v}{a}")) for v in "qz" for a in AXES})
        state = cut_lineage(_advance(cut_lineage(longer.select(state.columns)), key, key_type))
    found = weights[0]
    for w in weights[1:]:
        found = found.unionByName(w)
    return _finish(cut_lineage(points.join(found, "pid")), first, key, key_type, schema, block)


def _finish(points: DataFrame, first: DataFrame, key: str, key_type: str, schema: str, block: int) -> DataFrame:
    """Planes from what the weights leave of the values, worked out anew, and rows of knots."""
    left = points.join(product(points, points, ["w0", "w1"], key, block), "pid").withColumns(
        {f"r{a}": F.col(f"v{a}") - F.col(f"a_w{a}") - F.col("ridge") * F.col(f"w{a}") for a in AXES} | {f"{v}{a}": F.array().cast("array<double>") for v in "qz" for a in AXES})
    left = cut_lineage(left)
    plane = cut_lineage(_steps(left, key, key_type))
    off = [F.abs(F.col(f"r{a}") - F.col(f"c{a}")[0] - F.col(f"c{a}")[1] * F.col("x") - F.col(f"c{a}")[2] * F.col("y")) for a in AXES]
    w2 = F.col("m") * F.col("ridge") ** 2 * (F.col("w0") ** 2 + F.col("w1") ** 2)
    far = F.col("x") ** 2 + F.col("y") ** 2
    sheet = left.join(plane, key).groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("n", "k", "cx", "cy", "s", "c0", "c1", "moments")], (F.first("within") + F.sum(w2)).alias("left"),
        F.max(F.greatest(*off)).alias("worst"), *[F.sum(F.col(f"w{a}") * far).alias(f"d{a}") for a in AXES]).join(first, key)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            planes = []
            for r in pdf.itertuples():
                value, vector = np.linalg.eigh(np.asarray(r.moments).reshape(3, 3))
                open_ = vector.T[value < 1e-14 * value[-1]]
                planes.append(plane_of(np.column_stack([r.c0, r.c1]), np.array([r.d0, r.d1]), r.cx, r.cy, r.s, open_).T.ravel())
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "plane": planes, "rmse": np.sqrt(pdf["left"].clip(lower=0) / pdf["n"]),
                                "residual": pdf["worst"] / pdf["first"].where(pdf["first"] > 0, 1.0)})

    one = sheet.mapInPandas(rows, f"`{key}` {key_type}, n bigint, plane array<double>, rmse double, residual double")
    part = F.pmod(F.xxhash64("pid"), F.ceil(F.col("k") / block)).alias("_part")
    square = F.col("s") * F.col("s")
    knots = points.groupBy(key, part).agg(F.flatten(F.collect_list(F.array("sx", "sy", F.col("w0") * square, F.col("w1") * square))).alias("knots"))
    return knots.join(one, key).select(key, "n", F.lit("thin_plate_spline").alias("method"), "plane", "knots", "rmse", "residual")


# ---- use -----------------------------------------------------------------------------------------

def apply_tps(points: DataFrame, fits: DataFrame, key: str = "sheet_id", x: str = "x", y: str = "y", chunk: int = 50_000) -> DataFrame:
    """Points of a sheet pushed through its spline, as ``wx`` and ``wy``; unfitted sheets stay put. ``x`` and
    ``y`` are numbers or equally long arrays of numbers; null stays null.

    A sheet's rows are dealt out in chunks and each chunk meets one copy of the sheet's coefficients (32
    bytes a knot), so coefficients do not travel with every point and a sheet that holds a third of all
    points is spread over as many tasks as it has chunks. Other columns pass through as they are."""
    many = dict(points.dtypes)[x].startswith("array")
    size = F.coalesce(F.size(x), F.lit(0)) if many else F.lit(1)
    sizes = points.groupBy(F.col(key).alias("_key")).agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / chunk)).cast("int").alias("_nb"))
    dealt = points.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_blk", F.pmod(F.xxhash64(x, y), F.col("_nb")).cast("int")).drop("_nb", "_key")
    coef = fits.select(key, "plane", "knots").join(sizes, F.col(key) == F.col("_key")).withColumn(
        "_blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb", "_key")
    kind = ArrayType(DoubleType()) if many else DoubleType()
    columns = points.columns
    schema = StructType([dealt.schema[c] for c in columns] + [StructField("wx", kind), StructField("wy", kind)])

    def numbers(col) -> np.ndarray:
        return (col.flatten() if many else col).cast("float64").to_numpy(zero_copy_only=False)

    def warp(pts: pa.Table, fit: pa.Table) -> pa.Table:
        a, b = (pts[c].combine_chunks() for c in (x, y))
        a, b = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (a, b))
        u, v = numbers(a), numbers(b)
        wx, wy = u, v
        if len(fit) and len(u):
            p = np.asarray(fit["plane"][0].as_py())
            wx, wy = p[0] + p[1] * u + p[2] * v, p[3] + p[4] * u + p[5] * v
            for part in fit["knots"]:
                q = part.values.to_numpy().reshape(-1, 4)
                step = max(1, 65_536 // max(1, len(q)))
                for lo in range(0, len(u) if len(q) else 0, step):
                    k = kernel(np.column_stack([u[lo:lo + step], v[lo:lo + step]]), q[:, :2]) @ q[:, 2:]
                    wx[lo:lo + step] += k[:, 0]
                    wy[lo:lo + step] += k[:, 1]

        def shaped(w: np.ndarray, like: pa.Array) -> pa.Array:
            flat = pa.array(w, from_pandas=True)
            if not many:
                return flat
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(pc.is_null(like).to_numpy(zero_copy_only=False), False)), flat)

        return pts.select(columns).append_column("wx", shaped(wx, a)).append_column("wy", shaped(wy, b))

    return spread(dealt, key, "_blk").groupBy(key, "_blk").cogroup(spread(coef, key, "_blk").groupBy(key, "_blk")).applyInArrow(warp, schema)


def warp_rings(parcels: DataFrame, fits: DataFrame, key: str = "sheet_id") -> DataFrame:
    """``rings`` pushed through the spline of their sheet; without one, or null, they stay as they are."""
    flat = lambda f: F.flatten(F.transform("rings", lambda r: F.transform(r, f)))
    laid = parcels.withColumns({"_x": flat(lambda p: p["x"]), "_y": flat(lambda p: p["y"])})
    moved = apply_tps(laid, fits, key, "_x", "_y")

    def rebuilt(rings):
        before = lambda i: F.aggregate(F.slice(rings, F.lit(1), i), F.lit(0), lambda t, r: t + F.size(r))
        return F.transform(rings, lambda r, i: R.let(before(i), lambda o: F.transform(r, lambda p, j: R.point(
            F.col("wx")[o + j], F.col("wy")[o + j]))))

    return moved.withColumn("rings", rebuilt(F.col("rings"))).select(parcels.columns)
