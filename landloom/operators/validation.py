"""Row checks that split a table into valid rows and rejects with reason codes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import officer_id
from ..functions.rings import close_ring

# Accepted text patterns (digits and spaces in the Unicode sense, end of text at \z).
NAME_RE = r"^[A-Za-z\p{IsWhite_Space}]{2,100}\z"
PHONE_RE = r"^\p{Nd}{10}\z"
KHASRA_RE = r"^[0-9]+(/[0-9]+)?\z"
DESIGNATIONS = ["Patwari", "Tehsildar", "Naib Tehsildar", "Revenue Inspector"]
ROLES = ["patwari", "tehsildar"]
ACTIONS = ["approved", "rejected", "revision_requested"]


def _fails(ok: Column, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the codes of the failed checks, empty when the row is valid."""
    return df.withColumn("reasons", F.array_compact(F.array(*[_fails(ok, code) for code, ok in checks.items()])))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def _length(c: str, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def validate_officers(df: DataFrame) -> DataFrame:
    """Adds ``reasons`` and, for valid rows, ``officer_id``."""
    out = with_reasons(df, {
        "name": F.col("officer_name").rlike(NAME_RE),
        "phone": F.col("phone_number").rlike(PHONE_RE),
        "designation": F.col("designation").isin(DESIGNATIONS),
        "ward": _length("jurisdiction_ward", 2, 100),
    })
    return out.withColumn("officer_id", F.when(F.size("reasons") == 0, officer_id(F.col("designation"), F.col("phone_number"))))


def validate_registrations(df: DataFrame) -> DataFrame:
    return with_reasons(df, {
        "khasra": F.col("khasra_no").rlike(KHASRA_RE),
        "owner": F.col("owner_name").rlike(NAME_RE),
        "phone": F.col("owner_phone").rlike(PHONE_RE),
        "village": _length("village", 2, 100),
        "tehsil": _length("tehsil", 2, 100),
    })


def validate_rings(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Rings need four listed points; open ones are closed."""
    out = with_reasons(df, {
        "empty": F.size(rings) > 0,
        "short_ring": F.forall(rings, lambda r: F.size(r) >= 4),
    })
    return out.withColumn(rings, F.when(F.size("reasons") == 0, F.transform(rings, close_ring)).otherwise(F.col(rings)))


def validate_bounds(df: DataFrame, minx="min_lon", miny="min_lat", maxx="max_lon", maxy="max_lat") -> DataFrame:
    numeric = None
    for c in (minx, miny, maxx, maxy):
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        numeric = ok if numeric is None else numeric & ok
    return with_reasons(df, {
        "not_a_number": numeric,
        "lon_order": F.isnan(minx) | F.isnan(maxx) | (F.col(minx) < F.col(maxx)),
        "lat_order": F.isnan(miny) | F.isnan(maxy) | (F.col(miny) < F.col(maxy)),
    })


def role_gate(events: DataFrame, role: str = "role", header: str = "header_role", action: str = "action") -> DataFrame:
    """Who may do what: a known role that agrees with the header; a patwari may not act on dockets."""
    r, h = F.lower(F.trim(role)), F.lower(F.trim(header))
    return with_reasons(events, {
        "unknown_role": r.isin(ROLES),
        "header_mismatch": F.col(header).isNull() | (F.col(header) == "") | (h == r),
        "patwari_may_not_act": ~F.col(action).isin(ACTIONS) | ~F.coalesce(h == "patwari", F.lit(False)),
    })


def filter_candidate_plots(plots: DataFrame, sheets: DataFrame, variant: str = "raster") -> DataFrame:
    """Polygons plausible as plots for their sheet. ``plots``: sheet_id, area_px, x, y, bw, bh,
    n_vertices; ``sheets``: sheet_id, width, height."""
    wh = F.col("width") * F.col("height")
    joined = plots.join(sheets.select("sheet_id", "width", "height"), "sheet_id")
    if variant == "skeleton":
        return joined.filter((F.col("area_px") > 450) & (F.col("area_px") < 0.85 * wh))
    strip = (F.col("bw") / F.greatest(F.lit(1), F.col("bh")) > 4.0) | (F.col("bh") / F.greatest(F.lit(1), F.col("bw")) > 4.0)
    margin = (F.col("y") < 0.15 * F.col("height")) | (F.col("y") > 0.85 * F.col("height"))
    return joined.filter((F.col("area_px") > 0.002 * wh) & (F.col("area_px") < 0.38 * wh)
                         & ~(strip & margin) & (F.col("n_vertices") >= 3))
