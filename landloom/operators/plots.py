"""Plots on a sheet: numbering, duplicate suppression, pixel statistics."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

# Shadow and canopy limits.
SHADOW_BELOW, SHADOW_SHARE = 55, 0.18
HUE_LOW, HUE_HIGH, SATURATION_OVER, CANOPY_SHARE = 35, 85, 45, 0.22
CLEAR_TEXT = "Clear optical line-of-sight"
# Rows one numbering task should hold.
RANK_ROWS = 100_000
# Spans a larger group is cut into.
SPANS = 64


def row_numbers(df: DataFrame, group: list[str], order: list[Column], along: Column) -> DataFrame:
    """``row_number`` over each group without gathering a group in one task.

    ``along`` is a number that never falls along ``order``. A group is cut at quantiles of it, into as many spans
    as its row count asks for, so rows that crowd in one place are cut there; rows are numbered inside a span and
    shifted by the rows of the spans before it. Approximate quantiles only move the cuts, not the numbers."""
    d = df.withColumn("_k", along.cast("double"))
    cuts = F.percentile_approx("_k", F.array(*[F.lit(i / SPANS) for i in range(1, SPANS)]), F.lit(SPANS * 100))
    ext = d.groupBy(*group).agg(F.count("*").alias("_n"), cuts.alias("_q"))
    # Small groups are one span, without cuts.
    ext = ext.select(*group, F.when(F.col("_n") > RANK_ROWS, F.array_distinct("_q")).otherwise(F.array().cast("array<double>")).alias("_q"))
    binned = d.join(ext, group).withColumn("_bin", F.size(F.filter("_q", lambda q: q < F.col("_k")))).drop("_q")
    counts = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_bin", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*group, "_bin").orderBy(*order)
    return (binned.withColumn("_rn", F.row_number().over(inside)).join(shift, [*group, "_bin"])
            .withColumn("row_no", F.col("_off") + F.col("_rn"))
            .select(*df.columns, "row_no"))


def number_plots(plots: DataFrame, sheets: DataFrame, variant: str = "raster") -> DataFrame:
    """Plots of a sheet numbered from 1 by row band, then left to right. ``raster`` bands are a sixth
    of the sheet height by centre; ``skeleton`` bands are 80 px by top edge."""
    p = plots.join(sheets.select("sheet_id", F.col("height").alias("_h"), F.col("width").alias("_wd")), "sheet_id")
    if variant == "skeleton":
        band, across = F.floor(F.col("y") / 80), F.col("x")
    else:
        band, across = F.floor(F.col("cy") / F.greatest(F.lit(1), F.floor(F.col("_h") / 6))), F.col("cx")
    # Band plus place across the sheet: grows with the sort order, so a crowded band is cut up as well.
    share = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), across / F.greatest(F.lit(1.0), F.col("_wd"))))
    p = p.withColumn("row_band", band.cast("bigint")).withColumn("_along", F.col("row_band") + share).drop("_h", "_wd")
    numbered = row_numbers(p, ["sheet_id"], [F.col("row_band"), across, F.col("plot_no")], F.col("_along"))
    return numbered.drop("_along").withColumnRenamed("row_no", "plot_index")


#: Undecided plots that one task settles; larger sheets are cut into strips.
SETTLED_AT_ONCE = 50_000


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Plots of a strip that can be decided, from the largest down. ``state`` says of a rival outside
    the strip whether it stays (1), goes (0) or is not known yet (-1); rivals inside are decided on the way."""
    pdf = pdf.sort_values(["area", "plot_no"], ascending=[False, True], kind="stable")
    plots = pdf["plot_no"].to_numpy()
    first = np.flatnonzero(np.r_[True, plots[1:] != plots[:-1]])
    rivals, states, inside, decided = pdf["big"].tolist(), pdf["state"].tolist(), set(plots.tolist()), {}
    for no, lo, hi in zip(plots[first].tolist(), first.tolist(), [*first[1:].tolist(), len(plots)], strict=True):
        found = {decided.get(b, -1) if b in inside else s for b, s in zip(rivals[lo:hi], states[lo:hi])}
        if 1 in found:
            decided[no] = 0
        elif -1 not in found:
            decided[no] = 1
    return pd.DataFrame({"sheet_id": pdf["sheet_id"].iloc[0], "plot_no": list(decided), "stays": list(decided.values())})


def suppress_duplicate_plots(plots: DataFrame, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """Greedy suppression by area: a plot goes when its centre lies within
    max(14, 0.18·w) × max(14, 0.18·h) of a larger plot that stays.

    ``plots``: sheet_id, plot_no, cx, cy, bw, bh, area_px. Equal to the sequential rule, including chains.
    Plots of equal centre and size are first reduced to the largest, which decides for all of them. Conflicts
    come from a grid join whose level follows the reach, so large reaches do not flood small cells. A sheet's conflicts are
    settled in one task from the largest plot down, so the number of jobs does not depend on the length of
    chains. Sheets with more than ``at_once`` plots in conflict are cut into strips across their longer side; what a
    strip cannot decide waits for its neighbours' border, so there are as many rounds as a chain changes strips."""
    order = lambda area, no: F.struct(F.col(area).alias("area"), (-F.col(no)).alias("tie"))
    rank = order("area_px", "plot_no")
    lead = plots.groupBy("sheet_id", "cx", "cy", "bw", "bh").agg(F.max(F.struct(rank.alias("r"), F.col("plot_no").alias("no"))).alias("b"))
    lead = lead.select("sheet_id", F.col("b.no").alias("plot_no"), F.col("b.r.area").alias("area"), "cx", "cy",
                       F.greatest(F.lit(14.0), F.col("bw") * 0.18).alias("rx"), F.greatest(F.lit(14.0), F.col("bh") * 0.18).alias("ry"))
    # Written once, as four steps read it. Cells are twice as wide as the level's reach, so that a plot looks into two by two at most.
    lead = cut_lineage(lead.withColumn("lv", F.ceil(F.log2(F.greatest("rx", "ry"))).cast("int") + 1))
    levels = [r[0] for r in lead.select("lv").distinct().collect()]
    if not levels:
        return plots
    s = F.pow(F.lit(2.0), F.col("lv"))

    def span(c, r):
        return F.sequence(F.floor((F.col(c) - F.col(r)) / s), F.floor((F.col(c) + F.col(r)) / s))

    look = lead.withColumn("gx", F.explode(span("cx", "rx"))).withColumn("gy", F.explode(span("cy", "ry")))
    held = lead.select("sheet_id", F.col("plot_no").alias("big"), F.col("area").alias("big_area"), F.col("cx").alias("bx"), F.col("cy").alias("by"),
                       F.explode(F.array(*[F.lit(v) for v in levels])).alias("lv"))
    held = held.withColumn("gx", F.floor(F.col("bx") / s)).withColumn("gy", F.floor(F.col("by") / s))
    hit = look.join(held, ["sheet_id", "lv", "gx", "gy"]).filter(
        (order("area", "plot_no") < order("big_area", "big")) & (F.abs(F.col("cx") - F.col("bx")) < F.col("rx")) & (F.abs(F.col("cy") - F.col("by")) < F.col("ry")))
    edges = cut_lineage(hit.select("sheet_id", "plot_no", "area", "cx", "cy", "big"))
    beaten = edges.groupBy("sheet_id", "plot_no").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    extent = beaten.groupBy("sheet_id").agg(F.ceil(F.count("*") / at_once).alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("cx", "cy") for n, f in (("lo", F.min), ("hi", F.max))])
    wide = (F.col("cx_hi") - F.col("cx_lo")) >= (F.col("cy_hi") - F.col("cy_lo"))
    side = lambda n: F.when(wide, F.col(f"cx{n}")).otherwise(F.col(f"cy{n}"))
    strip = F.floor((side("") - side("_lo")) / F.when(side("_hi") > side("_lo"), side("_hi") - side("_lo")) * F.col("n") * 0.999999)
    # A rival without rivals of its own stays; the others are open.
    rivals = beaten.select("sheet_id", F.col("plot_no").alias("big"), F.lit(-1).alias("_open"))
    waiting = cut_lineage(edges.join(extent, "sheet_id").withColumn("strip", F.coalesce(strip, F.lit(0))).join(rivals, ["sheet_id", "big"], "left").select(
        "sheet_id", "strip", "plot_no", "area", "big", F.coalesce("_open", F.lit(1)).alias("state")))
    types = dict(plots.dtypes)
    schema = f"sheet_id {types['sheet_id']}, plot_no {types['plot_no']}, stays int"
    gone = None
    while waiting.take(1):
        settled = cut_lineage(spread(waiting, "sheet_id", "strip").groupBy("sheet_id", "strip").applyInPandas(_settle, schema))
        lost = settled.filter("stays = 0").select("sheet_id", "plot_no")
        gone = lost if gone is None else gone.unionByName(lost)
        known = settled.select("sheet_id", F.col("plot_no").alias("big"), "stays")
        rest = waiting.join(settled.select("sheet_id", "plot_no"), ["sheet_id", "plot_no"], "left_anti").join(known, ["sheet_id", "big"], "left")
        waiting = cut_lineage(rest.select("sheet_id", "strip", "plot_no", "area", "big", F.coalesce("stays", "state").alias("state")))
    stay = lead.select("sheet_id", "plot_no")
    if gone is not None:
        stay = stay.join(gone, ["sheet_id", "plot_no"], "left_anti")
    return plots.join(stay, ["sheet_id", "plot_no"], "left_semi")


# ---- pixels --------------------------------------------------------------------------------------

def hsv(r: Column, g: Column, b: Column) -> Column:
    """8-bit HSV with hue halved to 0–179, in integer arithmetic (12-bit reciprocals, rounded)."""
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    s_of = F.when(v > 0, F.floor(F.lit(255 << 12) / v + 0.5)).otherwise(0)
    h_of = F.when(d > 0, F.floor(F.lit(180 << 12) / (6.0 * d) + 0.5)).otherwise(0)
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.floor((turn * h_of + (1 << 11)) / (1 << 12))
    return F.struct(F.when(h < 0, h + 180).otherwise(h).cast("int").alias("h"),
                    F.floor((d * s_of + (1 << 11)) / (1 << 12)).cast("int").alias("s"), v.cast("int").alias("v"))


def occlusion_ratios(pixels: DataFrame, key: str = "tile_id") -> DataFrame:
    """Shadow and canopy shares of the masked pixels per tile, verdict and reason text."""
    p = pixels.withColumn("_p", hsv(F.col("r"), F.col("g"), F.col("b")))
    m = F.col("in_mask")
    n = F.count_if(m)
    shadow = F.count_if(m & (F.col("_p.v") < SHADOW_BELOW))
    canopy = F.count_if(m & F.col("_p.h").between(HUE_LOW, HUE_HIGH) & (F.col("_p.s") > SATURATION_OVER))
    agg = p.groupBy(key).agg(n.alias("masked_px"), shadow.alias("_s"), canopy.alias("_c"))
    share = lambda c: F.coalesce(F.col(c) / F.when(F.col("masked_px") > 0, F.col("masked_px")), F.lit(0.0))
    agg = agg.withColumn("_sr", share("_s")).withColumn("_cr", share("_c"))
    dark, green = F.col("_sr") > SHADOW_SHARE, F.col("_cr") > CANOPY_SHARE
    pct = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    text = F.concat_ws("; ", F.when(dark, F.concat(F.lit("Severe cloud/structure shadow ("), pct("_sr"), F.lit(")"))),
                       F.when(green, F.concat(F.lit("Dense vegetative canopy overhang ("), pct("_cr"), F.lit(")"))))
    return agg.select(key, "masked_px", F.round("_sr", 4).alias("shadow_ratio"), F.round("_cr", 4).alias("canopy_ratio"),
                      (dark | green).alias("is_occluded"), F.when(text == "", F.lit(CLEAR_TEXT)).otherwise(text).alias("reason"))


def gray_level(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma with 14-bit integer weights."""
    return F.floor((r * 4899 + g * 9617 + b * 1868 + (1 << 13)) / (1 << 14)).cast("int")


def otsu_threshold(pixels: DataFrame, key: str = "tile_id") -> DataFrame:
    """Grey level that separates each tile best; pixels above it are foreground.

    Pixels are counted per level before any shuffle, so at most 256 rows per tile reach the window."""
    hist = pixels.groupBy(key, gray_level(F.col("r"), F.col("g"), F.col("b")).alias("gray")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(key).orderBy("gray")
    whole = Window.partitionBy(key)
    h = hist.select(key, "gray", F.sum("n").over(run).alias("w1"), F.sum(F.col("n") * F.col("gray")).over(run).alias("s1"),
                    F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("gray")).over(whole).alias("s"))
    q1 = F.col("w1") / F.col("w")
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / F.when(F.col("w") > F.col("w1"), F.col("w") - F.col("w1"))
    h = h.withColumn("sigma", F.coalesce(F.round(q1 * (1.0 - q1) * gap * gap, 9), F.lit(0.0)))
    return h.groupBy(key).agg(F.max_by("gray", F.struct("sigma", -F.col("gray"))).alias("_t"), F.max("sigma").alias("sigma"), F.max("w").alias("n_pixels")).select(
        key, F.when(F.col("sigma") > 0, F.col("_t")).otherwise(0).alias("threshold"), F.round("sigma", 4).alias("sigma"), "n_pixels")
