"""Sheet alignment from control points, matches and edge points: fits as grouped sums or as one small
solve per sheet, scoring as joins and aggregates."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.projection import apply_affine, project_point
from ..functions.scores import alignment_confidence, transform_ok_automatic, transform_ok_manual
from ..session import cut_lineage, spread
from .aggregates import largest_part
from .splines import fit_tps, warp_rings
from .topology import make_valid

# Match minima, inlier limits and the structural search grid.
ENGINE_LIMITS = {"min_matches": 10, "threshold": 5.0}
SHEET_LIMITS = {"min_matches": 4, "threshold": 8.0}
SEARCH_SCALES, SEARCH_SPAN, SEARCH_SHIFT = 7, 0.10, 0.08
SEARCH_ROTATIONS = [-4.0, -2.0, 0.0, 2.0, 4.0]
REFINE_SPAN, REFINE_DEGREES, REFINE_SHIFT, REFINE_STEPS = 0.03, 1.5, 12.0, 5
DISTANCE_CAP, SCORE_SCALE, SCORE_LOW, SCORE_HIGH = 35.0, 25.0, 48.0, 98.8
MIN_EDGE_POINTS, SOFT_FIT = 50, 65.0
# Most minimal samples drawn per sheet, and the confidence at which drawing stops earlier (fixed values).
HYPOTHESES, CONFIDENCE = 4000, 0.995
# Matches that a task sorts at once, unless a sheet alone has more.
TASK_MATCHES = 500_000
# Samples drawn between two looks at the confidence.
DRAWS = 64
# Samples that reach the vote over all matches, picked by their votes within the drawn matches.
FINALISTS = 8


# ---- affine and offset fits ----------------------------------------------------------------------

def fit_affine(gcps: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Least-squares affine per sheet from means and centred second moments, which Spark merges
    stably from per-task partials: one pass, no gathering, whatever the size of a sheet.

    Two points give their mean offset, fewer the identity; ``method`` says which. Points on one line
    also fall back to the offset, since no plane fits them."""
    agg = gcps.groupBy(key).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("sx", "sy", "tx", "ty")],
        F.var_pop("sx").alias("sxx"), F.var_pop("sy").alias("syy"), F.covar_pop("sx", "sy").alias("sxy"),
        *[F.covar_pop(s, t).alias(f"{s}_{t}") for s in ("sx", "sy") for t in ("tx", "ty")])
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    solvable = (F.col("n") >= 3) & (det > 1e-14 * F.col("sxx") * F.col("syy"))

    def slope(t, first):
        num = (F.col(f"sx_{t}") * F.col("syy") - F.col(f"sy_{t}") * F.col("sxy")) if first else (
            F.col(f"sy_{t}") * F.col("sxx") - F.col(f"sx_{t}") * F.col("sxy"))
        return F.when(solvable, num / F.when(solvable, det))

    fitted = agg.withColumn("_a", slope("tx", True)).withColumn("_b", slope("tx", False)).withColumn(
        "_c", slope("ty", True)).withColumn("_d", slope("ty", False))
    usable = F.col("n") >= 2
    a, b = F.coalesce("_a", F.lit(1.0)), F.coalesce("_b", F.lit(0.0))
    c, d = F.coalesce("_c", F.lit(0.0)), F.coalesce("_d", F.lit(1.0))
    tx = F.when(usable, F.col("m_tx") - a * F.col("m_sx") - b * F.col("m_sy")).otherwise(0.0)
    ty = F.when(usable, F.col("m_ty") - c * F.col("m_sx") - d * F.col("m_sy")).otherwise(0.0)
    method = F.when(solvable, "affine").when(usable, "offset").otherwise("identity")
    return fitted.select(key, "n", method.alias("method"), F.struct(
        a.alias("a"), b.alias("b"), tx.alias("tx"), c.alias("c"), d.alias("d"), ty.alias("ty")).alias("m"))


def warp_affine(parcels: DataFrame, fits: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Rings moved by their sheet's affine; sheets without a fit stay as they are. AQE broadcasts the
    fit table only when its measured size allows."""
    out = parcels.join(fits.select(key, "m"), key, "left")
    return out.withColumn("rings", F.when(F.col("m").isNull(), F.col("rings")).otherwise(apply_affine(F.col("rings"), F.col("m")))).drop("m")


# ---- descriptor matching -------------------------------------------------------------------------

def _two_best(d: np.ndarray, ids: np.ndarray):
    """Distances and ids of the two lowest columns per row; targets come in id order."""
    k1 = d.argmin(axis=1)
    rows = np.arange(len(d))
    d1 = d[rows, k1]
    if d.shape[1] == 1:
        return d1, ids[k1], np.full(len(d), np.nan), np.full(len(d), -1)
    d[rows, k1] = np.inf
    k2 = d.argmin(axis=1)
    return d1, ids[k1], d[rows, k2], ids[k2]


def match_descriptors(desc: DataFrame, ratio: float = 0.80, metric: str = "l2", block: int = 1024) -> DataFrame:
    """Nearest target of each source descriptor of a sheet, kept when ``d1 < ratio · d2`` and two
    targets exist: sheet_id, src_id, tgt_id, d1, d2.

    ``desc``: sheet_id, vec_id, side ('src' | 'tgt'), embedding (doubles for l2, byte values for
    hamming). Exact. Both sides are cut into blocks of about ``block`` rows; a task compares one block
    pair as a matrix and sends on two candidates per source row, so a large sheet spreads over many tasks
    and neither a sheet nor its pairs is ever gathered or listed."""
    sizes = desc.groupBy("sheet_id", "side").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("nb"))
    tagged = desc.join(sizes, ["sheet_id", "side"]).withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
    pack = F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e"))))

    def blocks(side, name):
        return tagged.filter(F.col("side") == side).groupBy("sheet_id", "blk").agg(pack.alias(name)).select(
            "sheet_id", F.transform(name, lambda s: s["vec_id"]).alias(f"{name}_id"),
            F.flatten(F.transform(name, lambda s: s["e"])).alias(f"{name}_e"))

    pairs = blocks("src", "s").join(blocks("tgt", "t"), "sheet_id")
    t_sheet, t_id = dict(desc.dtypes)["sheet_id"], dict(desc.dtypes)["vec_id"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s_id, t_id_ = np.asarray(row.s_id), np.asarray(row.t_id)
                s = np.asarray(row.s_e, dtype=float).reshape(len(s_id), -1)
                t = np.asarray(row.t_e, dtype=float).reshape(len(t_id_), -1)
                if metric == "hamming":
                    bits = [np.unpackbits(m.astype(np.uint8), axis=1).astype(np.float32) for m in (s, t)]
                    d = bits[0].sum(1)[:, None] + bits[1].sum(1)[None, :] - 2 * bits[0] @ bits[1].T
                    d = d.astype(float)
                else:
                    d = np.sqrt(np.maximum((s ** 2).sum(1)[:, None] + (t ** 2).sum(1)[None, :] - 2 * s @ t.T, 0.0))
                d1, i1, d2, i2 = _two_best(np.round(d, 12), t_id_)
                yield pd.DataFrame({"sheet_id": row.sheet_id, "src_id": s_id, "d1": d1, "i1": i1, "d2": d2, "i2": i2})

    near = pairs.mapInPandas(compare, f"sheet_id {t_sheet}, src_id {t_id}, d1 double, i1 {t_id}, d2 double, i2 {t_id}")
    # Two lowest of the block winners: the best, and the better of its runner-up and the other bests.
    cand = near.select("sheet_id", "src_id", F.explode(F.array(
        F.struct(F.col("d1").alias("d"), F.col("i1").alias("i")),
        F.struct(F.col("d2").alias("d"), F.col("i2").alias("i")))).alias("c")).filter(~F.isnan("c.d") & F.col("c.d").isNotNull())
    w = Window.partitionBy("sheet_id", "src_id").orderBy("c.d", "c.i")
    ranked = cand.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    two = ranked.groupBy("sheet_id", "src_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("c.i"))).alias("tgt_id"), F.max(F.when(F.col("rn") == 1, F.col("c.d"))).alias("d1"),
        F.max(F.when(F.col("rn") == 2, F.col("c.d"))).alias("d2"))
    return two.filter(F.col("d2").isNotNull() & (F.col("d1") < ratio * F.col("d2")))


# Bits of a chunk of a code, and flipped bits that are looked up in it.
CHUNK_BITS, FLIPS = 16, 1


def code_chunks(embedding: Column) -> Column:
    """Byte values as 16-bit integers, the form in which binary codes are searched."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(embedding) - 1) / 2).cast("int")),
                       lambda i: F.element_at(embedding, 2 * i + 1).cast("int") + 256 * F.coalesce(F.try_element_at(embedding, 2 * i + 2), F.lit(0)).cast("int"))


def code_distance(a: Column, b: Column) -> Column:
    """Bits in which two lists of chunks differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def code_candidates(codes: DataFrame, crowd: int = 1024) -> DataFrame:
    """Pairs of a sheet that differ by at most ``FLIPS`` bits in some chunk, each once: sheet_id, src_id, tgt_id, d.

    Targets are listed under each of their chunks; a source looks up its own chunks and those one bit away. A pair
    that meets under several chunks is kept under the first of them, so no distinct is needed. A list of more than
    ``crowd`` targets is dealt to several tasks, all of which the sources visit."""
    where = F.posexplode("code").alias("c", "value")
    tgt = codes.filter("side = 'tgt'").select("sheet_id", F.col("vec_id").alias("tgt_id"), F.col("code").alias("t"), where)
    flips = [F.lit(0), *[F.lit(1 << i) for i in range(CHUNK_BITS)]]
    src = codes.filter("side = 'src'").select("sheet_id", F.col("vec_id").alias("src_id"), F.col("code").alias("s"), where)
    src = src.withColumn("value", F.explode(F.array(*[F.col("value").bitwiseXOR(f) for f in flips])))
    lists = tgt.groupBy("sheet_id", "c", "value").agg(F.ceil(F.count("*") / crowd).cast("int").alias("salts"))
    key = ["sheet_id", "c", "value"]
    dealt = tgt.join(lists, key).withColumn("salt", F.pmod(F.xxhash64("tgt_id"), F.col("salts")).cast("int")).drop("salts")
    asked = src.join(lists, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    near = F.zip_with("s", "t", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    met = asked.join(dealt, [*key, "salt"]).withColumn("apart", near)
    first = F.array_position(F.transform("apart", lambda n: n <= FLIPS), True) - 1
    return met.filter(first == F.col("c")).select("sheet_id", "src_id", "tgt_id", F.aggregate("apart", F.lit(0), lambda s, n: s + n).alias("d"))


def match_codes(codes: DataFrame, ratio: float = 0.80, crowd: int = 1024) -> DataFrame:
    """Matches of binary codes on large sheets without comparing all pairs: sheet_id, src_id, tgt_id, d1, d2.

    ``codes``: sheet_id, vec_id, side ('src' | 'tgt') and code (equally many 16-bit chunks each). Two codes of m chunks that differ by less
    than 2m bits differ by at most one in some chunk, so every pair nearer than that is a candidate. The result is
    therefore exactly that of ``match_descriptors`` for Hamming codes, as far as ``d1 < ratio * 2m``; ``d2`` is the
    runner-up's distance, or 2m if that is as far away or farther. Matches that lie farther apart are left to the exact search."""
    limit = F.lit((FLIPS + 1)) * F.col("m")
    w = Window.partitionBy("sheet_id", "src_id").orderBy("d", "tgt_id")
    two = code_candidates(codes, crowd).withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    best = two.groupBy("sheet_id", "src_id").agg(F.max(F.when(F.col("rn") == 1, F.col("tgt_id"))).alias("tgt_id"), F.max(F.when(F.col("rn") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("rn") == 2, F.col("d"))).alias("second"))
    # A sheet with one target has no runner-up and no matches, as in the exact search.
    sheets = codes.filter("side = 'tgt'").groupBy("sheet_id").agg(F.count("*").alias("n"), F.max(F.size("code")).alias("m")).filter("n > 1")
    out = best.join(sheets, "sheet_id").withColumn("d2", F.least(F.coalesce("second", limit), limit))
    return out.filter(F.col("d1") < ratio * F.col("d2")).select("sheet_id", "src_id", "tgt_id", "d1", "d2")


# ---- robust homography ---------------------------------------------------------------------------

def homography_from(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Direct linear transform over k ≥ 4 point pairs, batched: (..., k, 2) → (..., 9)."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    o, z = np.ones_like(x), np.zeros_like(x)
    a = np.stack([np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], -1),
                  np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], -1)], -2)
    a = a.reshape(*a.shape[:-3], -1, 9)
    h = np.linalg.svd(a, full_matrices=True)[2][..., -1, :]
    scale = np.where(np.abs(h[..., 8:9]) > 1e-12, h[..., 8:9], 1.0)
    return h / scale


def _normalised(n, mx, my, s):
    """Row-major similarity that moves points to mean 0 and unit spread."""
    k = 1.0 / s if s > 0 else 1.0
    return np.array([[k, 0, -k * mx], [0, k, -k * my], [0, 0, 1.0]])


def fit_robust(matches: DataFrame, min_matches: int = SHEET_LIMITS["min_matches"],
               threshold: float = SHEET_LIMITS["threshold"], hypotheses: int = HYPOTHESES,
               key: str = "sheet_id") -> DataFrame:
    """Homography per sheet that most matches agree with, refitted on those: sheet, h (9 doubles),
    matches, inliers, rmse_px. Sheets below ``min_matches`` come back with a null h and rmse 999.

    ``matches``: sheet, match_id, sx, sy, tx, ty. The minimal samples are the matches of lowest hash,
    so the result does not depend on partitioning; up to 4 · hypotheses matches those are all. Drawing goes on until the
    share of agreeing matches makes a clean sample likely enough. They vote among themselves first; the finalists are
    then voted on by all matches, as a join and a partial aggregate, and the winner is refitted from sums
    of normal-equation terms. Only the samples of a sheet (4 · hypotheses rows) and its 45 sums ever meet
    in one task."""
    m = matches.select(key, "match_id", *[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "tx", "ty")])
    counts = cut_lineage(m.groupBy(key).agg(F.count("*").alias("matches")))
    total, largest = counts.agg(F.sum("matches"), F.max("matches")).first()
    ready = counts.filter(F.col("matches") >= min_matches)
    want = 4 * hypotheses
    if (largest or 0) <= TASK_MATCHES:
        # Sheets are dealt to as many tasks as the matches need; joins and groups by sheet keep that partitioning.
        m = m.repartition(max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_MATCHES)), key)
    hashed = m.join(ready.select(key), key, "left_semi").withColumn("_h", F.xxhash64("match_id"))
    if (largest or 0) <= want:
        pool = hashed.select(key, "sx", "sy", "tx", "ty", "_h")
    else:
        # Two-step lowest-hash selection: per salt, then per sheet. A sheet with a third of all rows is
        # thinned by many tasks before its samples come together.
        salted = Window.partitionBy(key, F.pmod("_h", F.lit(64))).orderBy("_h", "match_id")
        whole = Window.partitionBy(key).orderBy("_h", "match_id")
        pool = hashed.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= want)
        pool = spread(pool.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= want).select(key, "sx", "sy", "tx", "ty", "_h"), key)
    key_type = dict(matches.dtypes)[key]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "sx", "sy", "tx", "ty"])
        src, dst = pdf[["sx", "sy"]].to_numpy(), pdf[["tx", "ty"]].to_numpy()
        rng = np.random.default_rng(len(pdf))
        least = 1e-9 * max(1.0, float(np.ptp(src, axis=0).max()) ** 2)
        found, counts, drawn, enough = [np.empty((0, 9))], [np.empty(0, int)], 0, hypotheses
        while drawn < min(enough, hypotheses):
            picks = np.array([rng.choice(len(pdf), 4, replace=False) for _ in range(DRAWS)])
            drawn += DRAWS
            picks = picks[_least_triangle(src[picks]) > least]
            if len(picks):
                h = homography_from(src[picks], dst[picks])
                h = h[np.isfinite(h).all(axis=1)]
                found.append(h)
                counts.append(np.array([_agreeing(k, src, dst, threshold) for k in h], dtype=int))
            clean = (max((c.max(initial=0) for c in counts), default=0) / len(pdf)) ** 4
            enough = hypotheses if clean <= 0 else 0 if clean >= 1 else np.log(1 - CONFIDENCE) / np.log(1 - clean)
        h, votes = np.concatenate(found), np.concatenate(counts)
        h = h[np.argsort(-votes, kind="stable")[:FINALISTS]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hs": [list(h)]})

    # One small row per sheet, read by several later steps: written once, as are the winner and the refit.
    drawn = cut_lineage(pool.groupBy(key).applyInPandas(draw, f"{key} {key_type}, hs array<array<double>>"))

    def miss2(h):
        u, v = project_point(h, F.col("sx"), F.col("sy"))
        return F.pow(u - F.col("tx"), F.lit(2.0)) + F.pow(v - F.col("ty"), F.lit(2.0))

    # Votes are plain counts, so the exploded rows fold into a hash aggregate in the task that makes them.
    votes = (m.join(drawn, key).select(key, "sx", "sy", "tx", "ty", F.posexplode("hs").alias("hyp", "h"))
             .select(key, "hyp", (miss2(F.col("h")) <= threshold * threshold).alias("ok"))
             .groupBy(key, "hyp").agg(F.count_if("ok").alias("votes")))
    top = votes.groupBy(key).agg(F.max(F.struct("votes", (-F.col("hyp")).alias("hyp"))).alias("t"))
    best = cut_lineage(top.filter("t.votes >= 4").join(drawn, key).select(key, F.element_at("hs", 1 - F.col("t.hyp")).alias("h0")))
    inl = m.join(best, key).filter(miss2(F.col("h0")) <= threshold * threshold).drop("h0")
    refit = cut_lineage(_refit_homography(inl, key, key_type))
    # Errors and inliers are read off the final transform.
    e2 = miss2(F.col("h"))
    good = F.when(e2 <= threshold * threshold, e2)
    final = m.join(refit, key).select(key, good.alias("e2")).groupBy(key).agg(F.count("e2").alias("inliers"), F.sqrt(F.avg("e2")).alias("rmse_px"))
    return counts.join(final, key, "left").join(refit, key, "left").select(
        key, "h", "matches", F.coalesce("inliers", F.lit(0)).alias("inliers"), F.coalesce("rmse_px", F.lit(999.0)).alias("rmse_px"))


def _agreeing(h: np.ndarray, src: np.ndarray, dst: np.ndarray, threshold: float) -> int:
    w = h[6] * src[:, 0] + h[7] * src[:, 1] + h[8]
    w = np.where(w == 0, 1.0, w)
    u = (h[0] * src[:, 0] + h[1] * src[:, 1] + h[2]) / w - dst[:, 0]
    v = (h[3] * src[:, 0] + h[4] * src[:, 1] + h[5]) / w - dst[:, 1]
    return int(np.count_nonzero(u * u + v * v <= threshold * threshold))


def _least_triangle(p: np.ndarray) -> np.ndarray:
    """Smallest doubled triangle area among the four points of each sample."""
    out = np.full(len(p), np.inf)
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        a, b = p[:, j] - p[:, i], p[:, k] - p[:, i]
        out = np.minimum(out, np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]))
    return out


def _refit_homography(inliers: DataFrame, key: str, key_type: str) -> DataFrame:
    """Least-squares homography over all inliers of a sheet from 45 sums of normalised terms."""
    stats = inliers.groupBy(key).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("sx", "sy", "tx", "ty")],
        F.sqrt(F.var_pop("sx") + F.var_pop("sy")).alias("s_s"), F.sqrt(F.var_pop("tx") + F.var_pop("ty")).alias("s_t"))
    n = inliers.join(stats, key)

    def unit(c, s):
        return (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(s) > 0, F.col(s)).otherwise(1.0)

    n = n.select(key, *[unit(c, "s_s").alias(c) for c in ("sx", "sy")], *[unit(c, "s_t").alias(c) for c in ("tx", "ty")])
    x, y, u, v = (F.col(c) for c in ("sx", "sy", "tx", "ty"))
    one, zero = F.lit(1.0), F.lit(0.0)
    row1 = [x, y, one, zero, zero, zero, -u * x, -u * y, -u]
    row2 = [zero, zero, zero, x, y, one, -v * x, -v * y, -v]
    terms = [(i, j) for i in range(9) for j in range(i, 9)]
    sums = n.groupBy(key).agg(*[F.sum(row1[i] * row1[j] + row2[i] * row2[j]).alias(f"q{i}{j}") for i, j in terms])
    packed = sums.select(key, F.array(*[f"q{i}{j}" for i, j in terms]).alias("q")).join(stats, key)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.zeros((9, 9))
                for (i, j), val in zip(terms, r.q):
                    a[i, j] = a[j, i] = val
                h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
                ts, tt = _normalised(1, r.m_sx, r.m_sy, r.s_s), _normalised(1, r.m_tx, r.m_ty, r.s_t)
                h = np.linalg.inv(tt) @ h @ ts
                out.append((h / (h[2, 2] if abs(h[2, 2]) > 1e-12 else 1.0)).ravel())
            yield pd.DataFrame({key: pdf[key], "h": out})

    return packed.mapInPandas(solve, f"{key} {key_type}, h array<double>")


def accept_transforms(fits: DataFrame, sheets: DataFrame, manual: bool = False, key: str = "sheet_id") -> DataFrame:
    """Adds ``accepted``: the sanity rule for manual or automatic transforms. ``sheets``: key, width, height."""
    out = fits.join(sheets.select(key, "width", "height"), key, "left")
    rule = transform_ok_manual(F.col("h")) if manual else transform_ok_automatic(F.col("h"), F.col("inliers"), F.col("width"), F.col("height"))
    return out.withColumn("accepted", F.coalesce(rule, F.lit(False)))


# ---- boundary support and structural search ------------------------------------------------------

# Cells of a dense drawing board; larger outlines are drawn cell by cell.
_BOARD_CELLS = 4_000_000
# Side of a footprint tile in blocks of 8 pixels, and the tiles up to which a plot's outline goes to each.
_SIDE, _FEW_TILES = 32, 9


def _outline_pixels(flat) -> np.ndarray:
    cells = []
    for r in flat:
        q = np.asarray(r, dtype=float).reshape(-1, 2)
        for (ax, ay), (bx, by) in zip(q[:-1].tolist(), q[1:].tolist()):
            n = max(1, math.ceil(max(abs(bx - ax), abs(by - ay))))
            t = np.arange(n + 1) / n
            cells.append(np.floor(np.array([[ax + 0.5], [ay + 0.5]]) + np.array([[bx - ax], [by - ay]]) * t))
    return np.concatenate(cells, axis=1).astype(np.int64) if cells else np.empty((2, 0), np.int64)


def _strip_blocks(flat, reach: int):
    """Pixels within ``reach`` of a ring's pixels as (block x, block y, 64-bit mask) of 8×8 blocks, and
    their number. Bit ``8·(x mod 8) + (y mod 8)`` of a mask is the pixel."""
    x, y = _outline_pixels(flat)
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    x0, y0 = (int(x.min()) - reach) >> 3, (int(y.min()) - reach) >> 3
    nx, ny = ((int(x.max()) + reach) >> 3) - x0 + 1, ((int(y.max()) + reach) >> 3) - y0 + 1
    if nx * ny * 64 > _BOARD_CELLS:
        return _strip_blocks_sparse(x, y, reach)
    board = np.zeros((nx * 8, ny * 8), dtype=bool)
    x, y = x - x0 * 8, y - y0 * 8
    for d in range(-reach, reach + 1):
        board[x + d, y] = True
    wide = board.copy()
    for d in range(1, reach + 1):
        wide[:, d:] |= board[:, :-d]
        wide[:, :-d] |= board[:, d:]
    bits = wide.reshape(nx, 8, ny, 8).transpose(0, 2, 1, 3).reshape(nx * ny, 64)
    mask = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    k = np.nonzero(mask)[0]
    return k // ny + x0, k % ny + y0, mask[k], int(wide.sum())


def _strip_blocks_sparse(x, y, reach: int):
    off = np.arange(-reach, reach + 1)
    px = np.repeat((x[:, None] + off).ravel(), len(off))
    py = np.repeat(y, len(off) ** 2) + np.tile(off, len(x) * len(off))
    code = np.unique((px + (1 << 30)) * (1 << 31) + (py + (1 << 30)))
    px, py = code // (1 << 31) - (1 << 30), code % (1 << 31) - (1 << 30)
    key = ((px >> 3) << 32) + ((py >> 3) + (1 << 31))
    order = np.argsort(key, kind="stable")
    key, px, py = key[order], px[order], py[order]
    bit = np.left_shift(np.uint64(1), ((px & 7) * 8 + (py & 7)).astype(np.uint64))
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    return px[first] >> 3, py[first] >> 3, np.bitwise_or.reduceat(bit, first).view(np.int64), len(code)


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which one each entry belongs to, and its place there."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner]


def _lists(column) -> tuple[np.ndarray, object]:
    """Where the lists of an Arrow column begin among their values (one entry more than lists), and the values."""
    return column.offsets.to_numpy(zero_copy_only=False).astype(np.int64), column.values


# Outline pixels and plots that are drawn together.
_DRAWN_PIXELS, _DRAWN_PLOTS = 500_000, 1024


def _strip_tiles(flat, tx, ty, at, lit, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of each plot's strip within its tile, and those of them that are lit. Arrow columns, a row a plot and tile: ``flat`` (rings
    as x, y …), tile, ``at``/``lit``: the tile's lit blocks. Plots are drawn many at a time, each on its part of one board."""
    strip, hit = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    row, rings = _lists(flat)
    ring, xy = _lists(rings)
    xy = xy.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    tile = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (tx, ty)], 1) * (8 * _SIDE)
    placed = ~np.isnan(np.stack([c.cast("float64").to_numpy(zero_copy_only=False) for c in (tx, ty)], 1)).any(axis=1)
    lit_at, at = _lists(at)
    at, lit = at.to_numpy(zero_copy_only=False), _lists(lit)[1].to_numpy(zero_copy_only=False)
    # Edges: from each point of a ring but its last to the next.
    n_edges = np.maximum(np.diff(ring) // 2 - 1, 0)
    of, nth = _each(n_edges)
    start = ring[of] // 2 + nth
    owner = np.searchsorted(row, of, side="right") - 1
    step = xy[start + 1] - xy[start]
    long = np.abs(step).max(axis=1, initial=0)
    use = np.isfinite(long) & np.isfinite(xy[start]).all(axis=1) & placed[owner] & (owner >= 0) & (owner < len(flat))
    start, owner, step = start[use], owner[use], step[use]
    n = np.maximum(1, np.ceil(long[use])).astype(np.int64)
    pixels = np.concatenate(([0], np.cumsum(np.bincount(owner, n + 1, len(flat)).astype(np.int64))))
    edge = np.searchsorted(owner, np.arange(len(flat) + 1))
    lo = 0
    while lo < len(flat):
        hi = min(len(flat), lo + _DRAWN_PLOTS, max(lo + 1, int(np.searchsorted(pixels, pixels[lo] + _DRAWN_PIXELS, side="right")) - 1))
        e = slice(edge[lo], edge[hi])
        if e.start < e.stop:
            i, k = _each(n[e] + 1)
            cell = np.floor((xy[start[e]] + 0.5)[i] + step[e][i] * (k / n[e][i])[:, None]).astype(np.int64)
            _draw(cell, owner[e][i] - lo, tile[lo:hi], lit_at[lo:hi + 1], at, lit, reach, strip[lo:hi], hit[lo:hi])
        lo = hi
    return strip, hit


def _draw(cell, plot, tile, lit_at, at, lit, reach: int, strip, hit) -> None:
    """Counts for some plots. ``cell``: their outline pixels (x, y) in order of ``plot``; ``tile``: the first pixel of each one's tile."""
    side, m = 8 * _SIDE, len(tile)
    first = np.flatnonzero(np.diff(plot, prepend=-1))
    low, high = np.full((m, 2), 1, np.int64), np.zeros((m, 2), np.int64)
    low[plot[first]], high[plot[first]] = np.minimum.reduceat(cell, first), np.maximum.reduceat(cell, first)
    seen = (low <= high).all(axis=1)
    # The part of the strip's box in the tile, on a board with a margin of the reach, into which what lies outside may run.
    low, high = np.maximum(low - reach, tile), np.minimum(high + reach, tile + side - 1)
    size = np.where((seen & (low <= high).all(axis=1))[:, None], high - low + 1 + 2 * reach, 0)
    low = low - reach
    area = (size.prod(axis=1) + 7) // 8 * 8
    base = np.cumsum(area) - area
    board = np.zeros(int(area.sum()) + 2 * reach, np.uint8)
    x, y = (cell - low[plot]).T
    w, h = size[plot].T
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    x, y, w, h, o = x[inside], y[inside], w[inside], h[inside], base[plot[inside]] + reach
    for d in range(-reach, reach + 1):
        board[o + np.clip(y + d, 0, h - 1) * w + x] = 1
    # Along the rows all boards at once; a row's ends run into margins only.
    wide = board[reach:len(board) - reach].copy()
    for d in range(1, reach + 1):
        wide |= board[reach + d:len(board) - reach + d]
        wide |= board[reach - d:len(board) - reach - d]
    own, line = _each(size[:, 1])
    at_row = base[own] + line * size[own, 0]
    for d in range(reach):
        wide[at_row + d] = 0
        wide[at_row + size[own, 0] - 1 - d] = 0
    edge = (line < reach) | (line >= size[own, 1] - reach)
    i, k = _each(np.where(edge, size[own, 0], 0))
    wide[at_row[i] + k] = 0
    # And between boards, which begin at multiples of 8.
    i, k = _each(area - size.prod(axis=1))
    wide[base[i] + size[i].prod(axis=1) + k] = 0
    some = np.flatnonzero(area)
    if not len(some):
        return
    strip[some] = np.add.reduceat(np.bitwise_count(wide.view(np.uint64)).astype(np.int64), base[some] // 8)
    # Lit blocks that meet the board, then their pixels.
    p, k = _each(np.where(area > 0, np.diff(lit_at), 0))
    k += lit_at[p]
    block = np.stack([at[k] // _SIDE, at[k] % _SIDE], 1).astype(np.int64) * 8 + tile[p] - low[p]
    near = ((block > -8) & (block < size[p])).all(axis=1)
    p, k, block = p[near], k[near], block[near]
    i, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(lit[k]).view(np.uint8), bitorder="little").reshape(-1, 64))
    x, y, p = block[i, 0] + bit // 8, block[i, 1] + bit % 8, p[i]
    w, h = size[p].T
    on = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    x, y, w, p = x[on], y[on], w[on], p[on]
    hit += np.bincount(p, wide[base[p] + y * w + x], len(hit)).astype(np.int64)


def boundary_support(plots: DataFrame, footprint: DataFrame, keys: list[str] | None = None, reach: int = 2) -> DataFrame:
    """Share of a plot's perimeter strip that lies on footprint cells, calibrated to 0.48–0.96
    (0.82 without a strip). ``plots``: sheet_id, plot_no, rings (pixels), a row a plot; ``footprint``: sheet_id, px, py.

    A plot travels as its outline to the few tiles under its box and meets there the lit 8×8 blocks of the
    footprint (at most 1 024 a tile, a 64-bit mask each); it is drawn behind the join, so no strip is shuffled.
    The strips of plots that lie on many tiles travel as such blocks, in proportion to their outlines."""
    keys = keys or ["sheet_id", "plot_no"]
    types = dict(plots.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    x, y = F.col("px").cast("bigint"), F.col("py").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(x, F.lit(8)) * 8 + F.pmod(y, F.lit(8))).cast("int"))
    seen = footprint.groupBy("sheet_id", F.floor(x / 8).alias("bx"), F.floor(y / 8).alias("by")).agg(F.bit_or(bit).alias("lit"))
    at = (F.pmod("bx", F.lit(_SIDE)) * _SIDE + F.pmod("by", F.lit(_SIDE))).cast("int")
    tiles = seen.groupBy("sheet_id", F.floor(F.col("bx") / _SIDE).alias("tx"), F.floor(F.col("by") / _SIDE).alias("ty")).agg(
        F.collect_list(F.struct(at.alias("at"), "lit")).alias("b")).select("sheet_id", "tx", "ty", F.col("b.at").alias("at"), F.col("b.lit").alias("lit"))

    def span(lo, hi):
        # A pixel more than the strip reaches: a tile without a strip counts nothing.
        return F.sequence(*(F.floor((F.floor(F.col(c) + 0.5) + d) / (8 * _SIDE)) for c, d in ((lo, -reach - 1), (hi, reach + 1))))

    boxed = R.with_bbox(plots.select(*dict.fromkeys(["sheet_id", *keys]), "rings")).withColumn("xs", span("minx", "maxx")).withColumn("ys", span("miny", "maxy"))
    flat = boxed.select(*dict.fromkeys(["sheet_id", *keys]), R.flat_rings(F.col("rings")).alias("flat"), "xs", "ys")
    wide = F.coalesce(F.size("xs").cast("bigint") * F.size("ys") > _FEW_TILES, F.lit(False))
    near = flat.filter(~wide).withColumn("tx", F.explode_outer("xs")).withColumn("ty", F.explode_outer("ys")).drop("xs", "ys")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _strip_tiles(*(b.column(c) for c in ("flat", "tx", "ty", "at", "lit")), reach)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *map(pa.array, counts)], names=[*keys, "strip_px", "hit_px"])

    # Merged, so that few large files are drawn by all tasks, and crowded tiles can be split at run time.
    met = near.join(tiles.hint("merge"), ["sheet_id", "tx", "ty"], "left").select(*keys, "flat", "tx", "ty", "at", "lit")
    out = met.mapInArrow(count, f"{head}, strip_px bigint, hit_px bigint")
    if flat.filter(wide).take(1):
        out = out.unionByName(_wide_support(flat.filter(wide), seen, keys, head, reach))
    out = out.groupBy(*keys).agg(F.sum("strip_px").alias("strip_px"), F.sum("hit_px").alias("hit_px"))
    iou = F.least(F.lit(0.96), F.greatest(F.lit(0.48), 0.58 + F.col("hit_px") / F.col("strip_px") * 0.38))
    return out.select(*keys, "strip_px", "hit_px", F.when(F.col("strip_px") > 0, iou).otherwise(0.82).alias("iou"))


def _wide_support(wide: DataFrame, seen: DataFrame, keys: list[str], head: str, reach: int) -> DataFrame:
    """keys, strip_px and hit_px of plots on many tiles, whose strips meet the footprint block by block."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_strip_blocks(f, reach) for f in pdf["flat"]]
            yield pdf[keys].assign(strip_px=[r[3] for r in rows], bx=[r[0] for r in rows], by=[r[1] for r in rows], mask=[r[2] for r in rows])

    strips = wide.mapInPandas(draw, f"{head}, strip_px bigint, bx array<bigint>, by array<bigint>, mask array<bigint>")
    cells = strips.select(*keys, "strip_px", F.explode(F.arrays_zip("bx", "by", "mask")).alias("c")).select(*keys, "strip_px", "c.bx", "c.by", "c.mask")
    hits = F.bit_count(F.col("mask").bitwiseAND(F.coalesce("lit", F.lit(0).cast("bigint")))).cast("bigint")
    return cells.join(seen, ["sheet_id", "bx", "by"], "left").groupBy(*keys).agg(F.max("strip_px").alias("strip_px"), F.sum(hits).alias("hit_px"))


# Side of a tile of the reference. What a point meets lies mostly in one tile; a field takes 4 bytes a pixel in its task.
TILE = 1280
# Points of a sheet that are scored together; each such part makes a tile's distances once a round.
PART = 20_000
_REACH, _CAP2 = int(math.ceil(DISTANCE_CAP)), int(DISTANCE_CAP ** 2)


def edge_tiles(edges: DataFrame, tile: int = TILE, key: str = "sheet_id") -> DataFrame:
    """The reference edge pixels that reach a tile, one row per tile that has any: sheet, ty, tx, lit (a bitmap of
    the tile and ``_REACH`` pixels around it, deflated). Distances are worked out from it where they are read,
    as they take a hundred times its bytes. Tiles left of or above the reference are not looked up and left out.

    Each edge pixel goes to its tile and to the neighbours its reach covers; a tile holds at most
    (tile + 2·cap)² distinct pixels."""
    e = edges.select(key, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()

    def span(c):
        return F.sequence(F.floor((F.col(c) - _REACH) / tile).cast("int"), F.floor((F.col(c) + _REACH) / tile).cast("int"))

    reached = e.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x"))).filter("ty >= 0 and tx >= 0")
    key_type = dict(edges.dtypes)[key]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        side = tile + 2 * _REACH
        grid = np.zeros((side, side), dtype=bool)
        grid[pdf["y"].to_numpy() - ty * tile + _REACH, pdf["x"].to_numpy() - tx * tile + _REACH] = True
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ty": [ty], "tx": [tx], "lit": [zlib.compress(np.packbits(grid).tobytes(), 1)]})

    return spread(reached, key, "ty", "tx").groupBy(key, "ty", "tx").applyInPandas(packed, f"{key} {key_type}, ty int, tx int, lit binary")


def _distance_field(lit: bytes, tile: int) -> np.ndarray:
    """Squared distance of each pixel of a tile to the nearest edge pixel, capped."""
    side = tile + 2 * _REACH
    grid = np.unpackbits(np.frombuffer(zlib.decompress(lit), dtype=np.uint8), count=side * side).reshape(side, side)
    rows = np.nonzero(grid.any(axis=1))[0]
    y, x = np.nonzero(grid)
    steps = (np.arange(-_REACH, _REACH + 1) ** 2).astype(np.uint16)
    if len(y) * len(steps) < len(rows) * tile:
        # Few pixels: the disc around each.
        disc = steps[:, None] + steps
        out = np.full((side + 2 * _REACH, side + 2 * _REACH), _CAP2, dtype=np.uint16)
        for r, c in zip(y.tolist(), x.tolist()):
            part = out[r:r + 2 * _REACH + 1, c:c + 2 * _REACH + 1]
            np.minimum(part, disc, out=part)
        return out[2 * _REACH:2 * _REACH + tile, 2 * _REACH:2 * _REACH + tile]
    # Many: along each row to the nearest on either side first, then the best row within reach.
    at = np.arange(side, dtype=np.int32)
    row = grid[rows] > 0
    left = at - np.maximum.accumulate(np.where(row, at, -side), axis=1)
    right = np.minimum.accumulate(np.where(row, at, 2 * side)[:, ::-1], axis=1)[:, ::-1] - at
    near = (np.minimum(np.minimum(left, right), _REACH) ** 2)[:, _REACH:_REACH + tile].astype(np.uint16)
    out = np.full((tile, tile), _CAP2, dtype=np.uint16)
    for r, line in zip(rows.tolist(), near):
        lo, hi = max(0, r - 2 * _REACH), min(tile, r + 1)
        np.minimum(out[lo:hi], line[None, :] + ((np.arange(lo, hi) + _REACH - r) ** 2)[:, None].astype(np.uint16), out=out[lo:hi])
    return out


# How far below the cap a pixel is, by its squared distance.
_BELOW = (DISTANCE_CAP - np.sqrt(np.arange(_CAP2 + 1))).astype(np.float32)
# The first grid's scales, rotations and shifts, and the steps of the second one about the winner; candidates are
# numbered in this order of the axes, the last one fastest.
_COARSE = [np.linspace(1 - SEARCH_SPAN, 1 + SEARCH_SPAN, SEARCH_SCALES).tolist(), SEARCH_ROTATIONS,
           np.linspace(-SEARCH_SHIFT, SEARCH_SHIFT, 5).tolist(), np.linspace(-SEARCH_SHIFT, SEARCH_SHIFT, 5).tolist()]
_FINE = np.linspace(-1, 1, REFINE_STEPS).tolist()
_CENTRE = (REFINE_STEPS ** 4) // 2


def _reachable(pts, axes, lo_u, hi_u, lo_v, hi_v, width, height):
    """Points that some candidate may put into the tile, by interval bounds of the similarity."""
    a, b = (np.outer(axes[0], f(np.radians(axes[1]))) for f in (np.cos, np.sin))

    def times(v, low, high):
        return np.minimum(v * low, v * high), np.maximum(v * low, v * high)

    ax, ay = times(pts[:, 0], a.min(), a.max()), times(pts[:, 1], a.min(), a.max())
    bx, by = times(pts[:, 0], b.min(), b.max()), times(pts[:, 1], b.min(), b.max())
    u0, u1 = ax[0] - by[1] + axes[2].min(), ax[1] - by[0] + axes[2].max()
    v0, v1 = bx[0] + ay[0] + axes[3].min(), bx[1] + ay[1] + axes[3].max()
    u0, u1 = np.clip(u0, 0, width - 1), np.clip(u1, 0, width - 1)
    v0, v1 = np.clip(v0, 0, height - 1), np.clip(v1, 0, height - 1)
    return (u1 >= lo_u - 1) & (u0 <= hi_u + 1) & (v1 >= lo_v - 1) & (v0 <= hi_v + 1)


def _gains(pts, lit: bytes, axes, tile: int, tx: int, ty: int, width: float, height: float) -> np.ndarray:
    """How far below the cap the points lie in total within a tile, per candidate."""
    x0, y0 = tx * tile, ty * tile
    pts = pts[_reachable(pts, axes, x0, x0 + tile, y0, y0 + tile, width, height)]
    gain = np.zeros([len(a) for a in axes])
    if not len(pts):
        return gain.ravel()
    # One spare row and column at the cap take whatever falls outside the tile.
    field = np.full((tile + 1, tile + 1), _CAP2, dtype=np.uint16)
    field[:tile, :tile] = _distance_field(lit, tile)
    field = field.ravel()
    px, py = pts[:, 0], pts[:, 1]
    cos, sin = (axes[0][:, None] * f(np.radians(axes[1])) for f in (np.cos, np.sin))
    cos, sin = cos[:, :, None, None], sin[:, :, None, None]

    def place(v, top, origin):
        v = np.clip(np.rint(v, out=v), 0, top - 1, out=v).astype(np.int64)
        v -= origin
        # Places before the origin are very large as unsigned numbers.
        return np.minimum(v.view(np.uint64), np.uint64(tile)).view(np.int64)

    # Candidates of one scale and rotation share their places across and down; some scales at a time, as all may be many.
    step = max(1, 1_000_000 // (len(px) * len(axes[1]) * max(len(axes[2]), len(axes[3]))))
    for i in range(0, len(cos), step):
        c, s = cos[i:i + step], sin[i:i + step]
        u = place(c * px - s * py + axes[2][:, None], width, x0)
        v = place(s * px + c * py + axes[3][:, None], height, y0) * (tile + 1)
        for a in range(len(c)):
            for b in range(len(axes[1])):
                if len(px) <= 4096:
                    gain[i + a, b] = _BELOW.take(field.take(u[a, b][:, None] + v[a, b], mode="clip")).sum(axis=2, dtype=np.float64)
                else:
                    for k in range(len(axes[2])):
                        gain[i + a, b, k] = _BELOW.take(field.take(u[a, b, k] + v[a, b], mode="clip")).sum(axis=1, dtype=np.float64)
    return gain.ravel()


def _tile_scores(samples: DataFrame, tiles: DataFrame, sheets: DataFrame, tile: int, key: str) -> DataFrame:
    """(sheet, cand, gain): the candidate under which a sheet's points lie furthest below the cap in total (the first of equals), and how
    far. ``samples``: sheet, part, pts (x, y …); ``sheets``: sheet, width, height (reference), axes (of s, degrees, dx, dy), and ``best``
    where the axes go about a winner, which is then candidate 0 before all others."""
    key_type = dict(samples.dtypes)[key]
    # A row is little to read and much to work out, so rows are spread over all tasks.
    work = spread(tiles.join(samples.join(sheets, key).hint("merge"), key), key, "ty", "tx", "part")
    about = "best" in sheets.columns

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                pts = np.asarray(r.pts, dtype=float).reshape(-1, 2)
                axes = [np.asarray(a, dtype=float) for a in r.axes]
                gain = _gains(pts, r.lit, axes, tile, r.tx, r.ty, r.width, r.height)
                k = getattr(r, key)
                held[k] = held[k] + gain if k in held else gain
                if len(held) >= 256:
                    yield rows(held)
                    held = {}
        yield rows(held)

    def rows(held: dict) -> pd.DataFrame:
        return pd.DataFrame({key: list(held), "gains": [g.tobytes() for g in held.values()]})

    def winner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A sheet's rows follow each other.
        last, total = None, None
        for pdf in batches:
            out = []
            for k, g in zip(pdf[key].tolist(), pdf["gains"]):
                g = np.frombuffer(g, np.float64)
                if k == last:
                    total = total + g
                else:
                    if total is not None:
                        out.append((last, *_best(total, about)))
                    last, total = k, g
            yield pd.DataFrame(out, columns=[key, "cand", "gain"])
        if total is not None:
            yield pd.DataFrame([(last, *_best(total, about))], columns=[key, "cand", "gain"])

    gains = spread(work.mapInPandas(score, f"{key} {key_type}, gains binary"), key).sortWithinPartitions(key)
    return gains.mapInPandas(winner, f"{key} {key_type}, cand int, gain double")


def _best(gain: np.ndarray, about: bool) -> tuple[int, float]:
    if about:
        gain = np.concatenate((gain[_CENTRE:_CENTRE + 1], gain))
    return int(np.argmax(np.round(gain, 6))), float(gain.max())


def score_transforms(points: DataFrame, edges: DataFrame, sheets: DataFrame, tile: int = TILE, key: str = "sheet_id", part: int = PART) -> DataFrame:
    """Structural alignment of each sheet: similarity whose projected edge points lie nearest the
    reference edges. Coarse grid of scales, rotations and shifts, then a finer one about the winner.

    ``points``/``edges``: sheet, x, y (edge pixels of the sheet / of the reference); ``sheets``: sheet,
    width, height (sheet), ref_width, ref_height. Result per sheet: m (affine struct), score,
    confidence, rmse_m, needs_assisted, method. Sheets with fewer than 50 edge points get the centred fit.

    All different points of a sheet are scored, dealt to parts of about ``part``; a part meets the tiles of the reference with four short
    axes of the search grid, and candidates exist only where they are scored."""
    one = cut_lineage(points.select(key, "x", "y").distinct())
    counts = cut_lineage(one.groupBy(key).agg(F.count("*").alias("n_points")))
    base = sheets.join(counts, key, "left").na.fill(0, ["n_points"])
    rich = base.filter(F.col("n_points") >= MIN_EDGE_POINTS)
    dealt = F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n_points") / part)).cast("int")
    samples = one.join(counts.filter(F.col("n_points") >= MIN_EDGE_POINTS), key).groupBy(key, dealt.alias("part")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p")).select(
        key, "part", F.flatten(F.transform("p", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("pts"))
    # Both search rounds read the tiles, so they are written once.
    tiles = cut_lineage(edge_tiles(edges, tile, key))
    samples = cut_lineage(samples)
    # Scales go about 1. The reference's go about its width over the sheet's; that is another result and left for a finding of its own.
    axis = lambda values, f: F.array(*[f(F.lit(float(v))) for v in values])
    axes = F.array(axis(_COARSE[0], lambda v: v), axis(_COARSE[1], lambda v: v), axis(_COARSE[2], lambda v: v * F.col("ref_width")), axis(_COARSE[3], lambda v: v * F.col("ref_height")))
    first = rich.select(key, F.col("ref_width").alias("width"), F.col("ref_height").alias("height"), "n_points", axes.alias("axes"))
    best1 = cut_lineage(_winner(_tile_scores(samples, tiles, first, tile, key), first, [len(a) for a in _COARSE], key))
    b = F.col("best")
    around = F.array(axis(_FINE, lambda v: b[0] * (1.0 + v * REFINE_SPAN)), axis(_FINE, lambda v: b[1] + v * REFINE_DEGREES),
                     axis(_FINE, lambda v: b[2] + v * REFINE_SHIFT), axis(_FINE, lambda v: b[3] + v * REFINE_SHIFT))
    second = best1.select(key, "width", "height", "n_points", "best", around.alias("axes"))
    best2 = _winner(_tile_scores(samples, tiles, second, tile, key), second, [REFINE_STEPS] * 4, key)
    found = best2.select(key, "best", "score")
    s, rad = F.col("best")[0], F.radians(F.col("best")[1])
    fit = F.least(F.col("ref_width") / F.col("width"), F.col("ref_height") / F.col("height"))
    searched = F.col("best").isNotNull()

    def entry(found_value, plain):
        return F.when(searched, found_value).otherwise(plain)

    m = F.struct(entry(s * F.cos(rad), fit).alias("a"), entry(-s * F.sin(rad), F.lit(0.0)).alias("b"),
                 entry(F.col("best")[2], (F.col("ref_width") - F.col("width") * fit) / 2.0).alias("tx"),
                 entry(s * F.sin(rad), F.lit(0.0)).alias("c"), entry(s * F.cos(rad), fit).alias("d"),
                 entry(F.col("best")[3], (F.col("ref_height") - F.col("height") * fit) / 2.0).alias("ty"))
    conf = F.round(F.greatest(F.lit(SCORE_LOW), F.least(F.lit(SCORE_HIGH), 100.0 * (1.0 - F.col("score") / SCORE_SCALE))), 1)
    out = base.join(found, key, "left").select(
        key, m.alias("m"), "score", entry(conf, F.lit(SOFT_FIT)).alias("confidence"),
        entry(F.round(F.col("score") * 0.05, 3), F.lit(0.85)).alias("rmse_m"),
        F.when(searched, "structural").otherwise("centred_fit").alias("method"))
    return out.withColumn("needs_assisted", F.when(F.col("method") == "centred_fit", True).otherwise(F.col("confidence") < 70.0))


def _winner(scores: DataFrame, cands: DataFrame, sizes: list[int], key: str) -> DataFrame:
    """The winner's place in the search grid and its mean distance; sheets that no tile saw are at the cap with the first candidate."""
    out = cands.join(scores, key, "left")
    about = "best" in cands.columns
    cand = F.coalesce("cand", F.lit(0)) - (1 if about else 0)
    place = [F.greatest(cand, F.lit(0))]
    for n in reversed(sizes[1:]):
        place = [F.floor(place[0] / n).cast("int"), F.pmod(place[0], F.lit(n)), *place[1:]]
    best = F.array(*[F.element_at(F.col("axes")[i], p + 1) for i, p in enumerate(place)])
    if about:
        best = F.when(cand < 0, F.col("best")).otherwise(best)
    return out.select(key, "width", "height", "n_points", best.alias("best"),
                      (DISTANCE_CAP - F.coalesce("gain", F.lit(0.0)) / F.col("n_points")).alias("score"))


# ---- whole-table alignment -----------------------------------------------------------------------

def align_parcels(parcels: DataFrame, gcps: DataFrame, key: str = "sheet_id") -> tuple[DataFrame, DataFrame]:
    """Parcels moved by their sheet's control points, status ALIGNED_DRAFT with a confidence of 0–1,
    and the parcels that could not be aligned with the reason. ``parcel_id`` is unique.

    From three points up a sheet takes the thin-plate spline through them, with two their mean offset. All
    control points count as inliers of their own fit; the error is what the fit leaves on them. Rings that
    the warp makes cross themselves are repaired, and of several parts the largest stays."""
    fits = cut_lineage(fit_tps(gcps, key).filter("method <> 'identity'"))
    sheet = fits.groupBy(key).agg(*[F.first(c).alias(c) for c in ("n", "method", "rmse")])
    conf = alignment_confidence(F.col("n"), F.col("n"), F.col("rmse"), F.col("n"))
    sheet = sheet.select(key, "method", F.round(conf / 100.0, 4).alias("_conf"))
    empty = F.coalesce(F.size("rings"), F.lit(0)) <= 0
    marked = parcels.join(sheet, key, "left").withColumn("error", F.when(empty, "empty coordinates").when(F.col("method").isNull(), "no control points"))
    given = ("alignment_status", "alignment_confidence")
    keep = [c for c in parcels.columns if c not in ("minx", "miny", "maxx", "maxy", *given)]
    moved = cut_lineage(warp_rings(marked.filter(F.col("error").isNull()), fits, key))
    crossed = moved.filter(~F.forall("rings", R.is_simple)).select("parcel_id", "rings")
    mended = largest_part(make_valid(crossed)).select("parcel_id", F.col("rings").alias("_mended"))
    done = moved.join(mended, "parcel_id", "left").withColumn("rings", F.coalesce("_mended", "rings")).withColumns(
        {"alignment_status": F.lit("ALIGNED_DRAFT"), "alignment_confidence": F.col("_conf")})
    return done.select(*keep, *given, "method"), marked.filter(F.col("error").isNotNull()).select("parcel_id", key, "error")
