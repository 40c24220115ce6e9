"""GeoJSON and summary writers: one feature or sheet per line, partitioned, no driver assembly."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.scores import SQFT_PER_SQM
from ..functions.status import aligned_status, band_colour

PARCEL_PROPERTIES = ["id", "khasra_no", "owner_name", "village", "tehsil", "district", "alignment_status", "ulpin",
                     "area_sqm", "alignment_confidence", "centroid_lat", "centroid_lon"]


def _geometry(rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), R.geojson_coordinates(rings).alias("coordinates"))


def parcel_features(parcels: DataFrame) -> DataFrame:
    """khasra_no, parcel_id and the feature text with the twelve parcel properties (nulls are kept)."""
    def prop(c):
        return (F.col("parcel_id").cast("string") if c == "id" else F.col(c)).alias(c)

    props = F.struct(*[prop(c) for c in PARCEL_PROPERTIES])
    feature = F.struct(F.lit("Feature").alias("type"), _geometry(F.col("rings")).alias("geometry"), props.alias("properties"))
    return parcels.select("khasra_no", "parcel_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def aligned_features(plots: DataFrame, last_wins: bool = False) -> DataFrame:
    """Aligned plots of a sheet as features. Legacy properties keep their own map under ``legacy``;
    ``last_wins`` merges them over the computed ones instead, so a legacy value replaces a computed one."""
    b = F.col("confidence_band")
    computed = {
        "khasra_no": F.col("plot_id"), "plot_id": F.col("plot_id"), "area_sqm": F.col("area_sqm"),
        "area_sqft": F.col("area_sqm") * SQFT_PER_SQM, "confidence_score": F.col("confidence_score"), "confidence_band": b,
        "situation": F.col("situation"), "reason": F.col("reason"), "status_color": band_colour(b),
        "iou_score": F.round("iou_score", 3), "needs_manual_review": b != "GREEN", "alignment_status": aligned_status(b),
    }
    legacy = F.coalesce("legacy_props", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    if last_wins:
        flat = F.map_from_arrays(F.array(*[F.lit(k) for k in computed]), F.array(*[v.cast("string") for v in computed.values()]))
        kept = F.map_filter(flat, lambda k, _: ~F.map_contains_key(legacy, k))
        props = F.map_concat(kept, legacy)
    else:
        props = F.struct(*[v.alias(k) for k, v in computed.items()], legacy.alias("legacy"))
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), _geometry(F.transform("rings", R.close_ring)).alias("geometry"))
    return plots.select("sheet_id", "plot_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(features: DataFrame, path: str, ordered: bool = True) -> None:
    """One feature per line over many files. ``ordered`` range-partitions by plot number, so that the
    files read in name order are sorted."""
    out = features.orderBy("khasra_no", "parcel_id") if ordered and "khasra_no" in features.columns else features
    out.select("value").write.mode("error").text(path)


def sheet_summary(plots: DataFrame, sheets: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Per sheet: plot counts by band, area totals and the alignment figures of ``sheets``
    (key, inliers, matches, rmse_px, and whatever else it carries)."""
    b = F.col("confidence_band")
    agg = plots.groupBy(key).agg(
        F.count("*").alias("total_plots"), F.count_if(b == "GREEN").alias("plots_high_confidence"),
        F.count_if(b == "AMBER").alias("plots_medium_confidence"), F.count_if(b == "RED").alias("plots_flagged_red"),
        F.sum("area_sqm").alias("total_area_sqm"), F.sum(F.col("area_sqm") * SQFT_PER_SQM).alias("total_area_sqft"))
    out = sheets.join(agg, key, "left").na.fill(0, ["total_plots", "plots_high_confidence", "plots_medium_confidence", "plots_flagged_red"])
    return out.withColumn("inlier_ratio", F.round(F.col("inliers") / F.greatest(F.lit(1), F.col("matches")), 4)).withColumn(
        "rmse_m", F.round(F.col("rmse_px") * 0.05, 3))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("error").json(path)
