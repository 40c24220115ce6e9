"""One-pass aggregates: dashboard, bands, totals, quality, progress, timelines, control-point errors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import SQFT_PER_SQM, band


def _count(cond) -> Column:
    return F.count_if(cond)


def dashboard_stats(parcels: DataFrame, approvals: DataFrame) -> DataFrame:
    """Nine counts in one row; each table is scanned once."""
    s = F.col("alignment_status")
    p = parcels.agg(
        F.count("*").alias("total_parcels"), _count(s == "DRAFT").alias("raw_count"),
        _count(s == "ALIGNED_DRAFT").alias("aligned_count"), _count(s == "TOPOLOGY_CLEANED").alias("cleaned_count"),
        _count(s == "ULPIN_ASSIGNED").alias("ulpin_assigned_count"), _count(s == "PUBLISHED").alias("published_count"),
    ).withColumn("_one", F.lit(1))
    r = F.col("status")
    a = approvals.agg(
        _count(r == "pending").alias("pending_approvals"), _count(r == "approved").alias("approved_count"),
        _count(r == "rejected").alias("rejected_count"),
    ).withColumn("_one", F.lit(1))
    return p.join(a, "_one").drop("_one")


def status_breakdown(stats: DataFrame) -> DataFrame:
    """Chart rows (name, value) from the dashboard row."""
    return stats.select(F.expr(
        "stack(3, 'Approved / Published', published_count, 'AI-Drafted / Pending', aligned_count + pending_approvals,"
        " 'Flagged (GCP Required)', raw_count) AS (name, value)"))


def band_counts(plots: DataFrame, *keys: str, colour: str = "status_color", band_col: str = "confidence_band") -> DataFrame:
    """GREEN/AMBER/RED plots per key, by band or by colour alias."""
    c, b = F.col(colour), F.col(band_col)

    def hit(colours, name):
        return F.coalesce(c.isin(colours), F.lit(False)) | F.coalesce(b == name, F.lit(False))

    return plots.groupBy(*keys).agg(_count(hit(["green"], "GREEN")).alias("green"),
                                    _count(hit(["amber", "orange"], "AMBER")).alias("amber"),
                                    _count(hit(["red"], "RED")).alias("red"))


def sheet_area_totals(plots: DataFrame, *keys: str) -> DataFrame:
    return plots.groupBy(*keys).agg(F.sum("area_sqm").alias("total_area_sqm"),
                                    F.sum(F.col("area_sqm") * SQFT_PER_SQM).alias("total_area_sqft"))


def flag_rate(plots: DataFrame, *keys: str, band_col: str = "confidence_band") -> DataFrame:
    red = _count(F.col(band_col) == "RED")
    return plots.groupBy(*keys).agg(
        F.round((1.0 - red / F.greatest(F.lit(1), F.count("*"))) * 100.0, 1).alias("matched_boundary_pct"),
        red.alias("discrepancy_count"))


def overall_confidence(plots: DataFrame, *keys: str, score: str = "confidence_score") -> DataFrame:
    """Mean plot score per key, 88.0 without plots, and its band."""
    mean = F.round(F.coalesce(F.avg(score), F.lit(88.0)), 1)
    return plots.groupBy(*keys).agg(mean.alias("overall_confidence")).withColumn(
        "confidence_band", band(F.col("overall_confidence")))


def layer_bbox(parcels: DataFrame, *keys: str, pad: float = 0.08) -> DataFrame:
    """Padded extent per key from stored boxes; an empty span counts as 1e-6."""
    raw = parcels.groupBy(*keys).agg(F.min("minx").alias("_x0"), F.max("maxx").alias("_x1"),
                                     F.min("miny").alias("_y0"), F.max("maxy").alias("_y1"))
    dx = F.when(F.col("_x1") == F.col("_x0"), 1e-6).otherwise(F.col("_x1") - F.col("_x0"))
    dy = F.when(F.col("_y1") == F.col("_y0"), 1e-6).otherwise(F.col("_y1") - F.col("_y0"))
    return raw.select(*keys, (F.col("_x0") - dx * pad).alias("min_x"), (F.col("_x1") + dx * pad).alias("max_x"),
                      (F.col("_y0") - dy * pad).alias("min_y"), (F.col("_y1") + dy * pad).alias("max_y"))


def rms(dx: Column, dy: Column, empty: float | None = None) -> Column:
    value = F.sqrt(F.avg(dx * dx + dy * dy))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def displacement_rmse(gcps: DataFrame, *keys: str) -> DataFrame:
    return gcps.groupBy(*keys).agg(rms(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"), 0.0).alias("rmse"))


def reprojection_rmse(residuals: DataFrame, *keys: str, scale: float = 0.05) -> DataFrame:
    """Error over inliers (px, py projected; tx, ty true; is_inlier); 999 px when there is none."""
    inl = F.col("is_inlier")
    e2 = F.pow(F.col("px") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("ty"), F.lit(2.0))
    out = residuals.groupBy(*keys).agg(
        F.coalesce(F.sqrt(F.avg(F.when(inl, e2))), F.lit(999.0)).alias("rmse_px"),
        _count(inl).alias("inliers"), F.count("*").alias("matches"))
    return out.withColumn("rmse_m", F.round(F.col("rmse_px") * scale, 3)).withColumn(
        "inlier_ratio", F.col("inliers") / F.greatest(F.lit(1), F.col("matches")))


def inlier_ratio(matches: DataFrame, *keys: str, flag: str = "is_inlier") -> DataFrame:
    return matches.groupBy(*keys).agg(
        (_count(F.col(flag)) / F.greatest(F.lit(1), F.count("*"))).alias("inlier_ratio"))


def ulpin_collisions(parcels: DataFrame) -> DataFrame:
    """Codes held by more than one parcel."""
    return (parcels.filter(F.col("ulpin").isNotNull()).groupBy("ulpin").agg(F.count("*").alias("n_parcels"))
            .filter(F.col("n_parcels") > 1))


def layer_quality(parcels: DataFrame, approvals: DataFrame, required: list[str]) -> DataFrame:
    """Row of data-quality counts: empty geometry, missing fields, status identity, orphan requests."""
    from ..functions.status import LIFE_CYCLE

    missing = None
    for c in required:
        m = F.col(c).isNull() | (F.col(c).cast("string") == "")
        missing = m if missing is None else missing | m
    p = parcels.agg(
        F.count("*").alias("total"), _count(F.coalesce(F.size("rings"), F.lit(0)) <= 0).alias("empty_geometry"),
        _count(missing).alias("missing_required"),
        _count(F.col("alignment_status").isin(LIFE_CYCLE)).alias("known_status"),
    ).withColumn("_one", F.lit(1))
    o = approvals.join(parcels.select("parcel_id"), "parcel_id", "left_anti").agg(
        F.count("*").alias("orphan_approvals")).withColumn("_one", F.lit(1))
    return p.join(o, "_one").drop("_one").withColumn("status_identity", F.col("known_status") == F.col("total"))


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """Last ``n`` rows per key. The rank filter is pushed below the shuffle as a per-task top-n,
    so a key that fills a third of the table sends n rows per task, not the group."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def batch_progress(events: DataFrame, totals: DataFrame, keep_errors: int = 10) -> DataFrame:
    """``events``: batch_id, ts, event_id, success, error; ``totals``: batch_id, total."""
    counts = events.groupBy("batch_id").agg(_count(F.col("success")).alias("completed"),
                                            _count(~F.col("success")).alias("failed"),
                                            F.max("ts").alias("updated_at"))
    errors = (last_n(events.filter(~F.col("success") & F.col("error").isNotNull() & (F.col("error") != ""))
                     .select("batch_id", "ts", "event_id", "error"), ["batch_id"], ["ts", "event_id"], keep_errors)
              .groupBy("batch_id")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "error"))),
                               lambda e: e["error"]).alias("errors")))
    done = (F.col("completed") + F.col("failed") >= F.col("total")) & (F.col("total") > 0)
    return (totals.join(counts, "batch_id", "left").join(errors, "batch_id", "left")
            .select("batch_id", "total", F.coalesce("completed", F.lit(0)).alias("completed"),
                    F.coalesce("failed", F.lit(0)).alias("failed"), "updated_at",
                    F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
            .withColumn("status", F.when(done, "COMPLETED").otherwise("PROCESSING")))


def weekly_timeline(events: DataFrame, origin: str = "2024-01-01 00:00:00") -> DataFrame:
    """Drafted and approved events per 7-day window counted from ``origin``."""
    days = F.datediff(F.to_date("ts"), F.to_date(F.lit(origin)))
    return (events.groupBy(F.floor(days / 7).cast("bigint").alias("week"))
            .agg(_count(F.col("action") == "DRAFT_PUT").alias("ai_drafted"),
                 _count(F.col("action") == "APPROVE").alias("officer_approved")))


def neighbor_union(pairs: DataFrame, shapes: DataFrame, grid: float = 1e-9) -> DataFrame:
    """Union of each target's neighbour shapes, a row a part: a_id, part_no, rings, area.
    ``pairs``: a_id, shape_id; ``shapes``: shape_id, rings. See ``arrangement.union_parts``."""
    from .arrangement import union_parts

    return union_parts(pairs.select("a_id", "shape_id").distinct().join(shapes.select("shape_id", "rings"), "shape_id"), "a_id", grid)


def largest_part(parts: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Largest-area part per key; the lower part number wins a tie."""
    from ..functions.rings import planar_area

    sized = parts.withColumn("_a", planar_area(F.col("rings")))
    rank = F.struct(F.col("_a"), -F.col("part_no"))
    # The number is in the rank, and rings have a column of their own: who does not read them does not shuffle them.
    return sized.groupBy(key).agg(F.max(rank).alias("_m"), F.max_by("rings", rank).alias("rings")).select(
        key, (-F.col("_m.col2")).cast(dict(parts.dtypes)["part_no"]).alias("part_no"), "rings")
