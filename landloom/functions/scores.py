"""Confidence scores, bands, review flags and small conversions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits, score weights and clamps.
GREEN_FROM, AMBER_FROM = 85.0, 60.0
REVIEW_BELOW, ASSIST_BELOW = 80.0, 70.0
IMAGE_DIAGONAL = 2896.0
OCCLUDED_FACTOR = 0.82
SQM_PER_BIGHA, SQM_PER_BISWA, SQFT_PER_SQM = 2529.28, 126.464, 10.7639


def band(score: Column) -> Column:
    return F.when(score >= GREEN_FROM, "GREEN").when(score >= AMBER_FROM, "AMBER").otherwise("RED")


def _clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def alignment_confidence(inliers: Column, matches: Column, rmse: Column, gcps: Column | None = None,
                         diagonal: float = IMAGE_DIAGONAL) -> Column:
    """0–100 from inlier share, error against 2 % of the diagonal, and inlier count;
    two or more manual control points lift it to ``88 + 2n``, at most 98.5."""
    share = inliers / F.when(matches != 0, matches)
    err = F.greatest(F.lit(0.0), 1.0 - F.coalesce(rmse, F.lit(diagonal)) / (0.02 * diagonal))
    dense = F.least(F.lit(1.0), inliers / 200.0)
    raw = F.round(_clamp((0.40 * share + 0.40 * err + 0.20 * dense) * 100.0, 0.0, 100.0), 2)
    score = F.when((matches == 0) | (inliers == 0), 0.0).otherwise(raw)
    if gcps is None:
        return score
    return F.when(gcps >= 2, F.greatest(score, F.least(F.lit(98.5), 88.0 + gcps * 2.0))).otherwise(score)


def normalized_rmse(rmse_px: Column) -> Column:
    return _clamp(rmse_px / 25.0, 0.0, 1.0)


def plot_confidence(inlier_ratio: Column, nrmse: Column, iou: Column, has_footprint: bool = True) -> Column:
    err = F.when(iou < 0.25, F.greatest(nrmse, F.lit(0.75))).otherwise(nrmse)
    if has_footprint:
        raw = 100.0 * (0.40 * inlier_ratio + 0.30 * (1.0 - err) + 0.30 * iou)
    else:
        raw = 100.0 * (0.55 * inlier_ratio + 0.45 * (1.0 - err))
    return F.round(_clamp(raw, 15.0, 99.4), 1)


def boundary_score(model_score: Column, occluded: Column) -> Column:
    return F.round(model_score * 100.0 * F.when(occluded, OCCLUDED_FACTOR).otherwise(1.0), 2)


def review_required(occluded: Column, score: Column) -> Column:
    return occluded | (score < REVIEW_BELOW)


def needs_manual_review(band_col: Column) -> Column:
    return band_col != "GREEN"


def needs_assisted(confidence: Column) -> Column:
    return confidence < ASSIST_BELOW


def to_bigha(sqm: Column, decimals: int = 2) -> Column:
    """Text with fixed decimals, halves rounded up; non-positive or missing area gives ``0.00``."""
    # Formatting alone would round 0.125 to the even digit and 1.575 by the binary value below it.
    value = F.round(sqm / SQM_PER_BIGHA * 10.0 ** decimals) / 10.0 ** decimals
    text = F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))
    return F.when(sqm.isNull() | (sqm <= 0), F.lit("0.00")).otherwise(text)


def to_biswa(sqm: Column) -> Column:
    return sqm / SQM_PER_BISWA


def to_sqft(sqm: Column) -> Column:
    return sqm * SQFT_PER_SQM


def area_change(old: Column, new: Column) -> Column:
    """``struct<delta, percent>``; percent is 0 when there was no area before."""
    return F.struct((new - old).alias("delta"),
                    F.when(old > 0, (new - old) / old * 100.0).otherwise(0.0).alias("percent"))


def edited_area(old_sqm: Column, old_px: Column, new_px: Column) -> Column:
    """Area after a vertex edit, scaled by the pixel-area ratio."""
    return F.when((old_sqm > 0) & (old_px > 0), F.round(old_sqm * (new_px / F.when(old_px > 0, old_px)), 1))


def plot_area_from_pixels(px: Column, scale: float = 0.05) -> Column:
    return F.round(px * scale * scale, 1)


def skeleton_area_from_pixels(px: Column) -> Column:
    return F.round(px * 0.12 * 12.0, 1)


def transform_ok_manual(h: Column) -> Column:
    """3×3 matrix (row-major array of 9): determinant of the linear part is sane."""
    det = h[0] * h[4] - h[1] * h[3]
    return (F.abs(det) > 0.01) & (F.abs(det) < 50.0)


def transform_ok_automatic(h: Column, inliers: Column, width: Column, height: Column) -> Column:
    """Sane positive determinant, four inliers, and sheet corners keep their turning direction."""
    det = h[0] * h[4] - h[1] * h[3]

    def proj(x, y):
        w = h[6] * x + h[7] * y + h[8]
        w = F.when(w == 0, 1.0).otherwise(w)
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w

    zero = F.lit(0.0)
    (x0, y0), (x1, y1), (x2, y2) = proj(zero, zero), proj(width, zero), proj(width, height)
    turn = (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1)
    return (det > 0) & (F.abs(det) >= 0.02) & (F.abs(det) <= 50.0) & (inliers >= 4) & (turn > 0)
