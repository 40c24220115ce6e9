"""Projections, filters, key joins, anti-join unions and orderings over parcel tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_COLUMNS = ["parcel_id", "khasra_no", "owner_name", "village", "alignment_status", "ulpin", "area_sqm"]

# Situation and reason text of each band in the register.
BAND_TEXT = {
    "RED": ("सरकारी भूमि / अवैध कब्जा", "Govt. Land / Encroachment - State Property Verification Required"),
    "AMBER": ("ओकल्शन (पेड़ / छाया)", "Tree Occultation / Canopy Shadow - High Ground Discrepancy"),
    "GREEN": ("सही (Verified Clear)", "Verified Clear - Undisputed Legal Cadastral Parcel"),
}


def parcel_summary(parcels: DataFrame) -> DataFrame:
    """The listing columns in text order of the plot number."""
    return sort_by_khasra(parcels.select(*SUMMARY_COLUMNS))


def sort_by_khasra(df: DataFrame) -> DataFrame:
    return df.orderBy("khasra_no", "parcel_id")


def newest_first(df: DataFrame, ts: str = "requested_at", tie: str = "approval_id") -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie))


def limit_n(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows of a total order (planned as one top-n per partition, then a merge)."""
    return df.orderBy(*order).limit(n)


def top1_by(df: DataFrame, keys, value: Column, *order: Column) -> DataFrame:
    """Best row value per key, reduced in each task before the shuffle. The order is a struct, which Spark keeps
    in a sort aggregate; for single numeric orders use ``min``."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("value"))


def parcel_detail(parcels: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ids, and the ids that have none."""
    ids = wanted.select("parcel_id").distinct()
    return parcels.join(ids, "parcel_id", "left_semi"), ids.join(parcels, "parcel_id", "left_anti")


def _matches(q: str) -> Column:
    needle = q.lower().strip()
    if not needle:
        return F.lit(True)

    def has(c):
        return F.lower(F.col(c)).contains(needle)

    return has("khasra_no") | has("owner_name") | F.coalesce(has("ulpin"), F.lit(False))


def roster_search(parcels: DataFrame, q: str = "", status: str = "ALL") -> DataFrame:
    s = F.col("alignment_status")
    klass = {
        "DRAFT": s.isin("raw", "DRAFT"),
        "ALIGNED": s.contains("aligned") | (s == "ALIGNED_DRAFT"),
        "ULPIN": F.coalesce(F.col("ulpin") != "", F.lit(False)),
    }.get(status, F.lit(True))
    return parcels.filter(_matches(q) & klass)


def docket_filter(docket: DataFrame, q: str = "", klass: str = "ALL", approved: str = "is_approved") -> DataFrame:
    done = F.col(approved)
    rule = {
        "PENDING": ~done & (F.col("status") == "pending"),
        "APPROVED": done,
        "OCCLUDED": F.coalesce(F.col("alignment_confidence"), F.lit(1.0)) < 0.8,
    }.get(klass, F.lit(True))
    return docket.filter(_matches(q) & rule)


def issue_filter(parcels: DataFrame, klass: str = "ALL", status: str = "alignment_status") -> DataFrame:
    groups = {"ALIGNED": ["PUBLISHED", "ALIGNED_DRAFT", "TOPOLOGY_CLEANED"], "ISSUES": ["OCCLUDED", "DRAFT"]}
    return parcels.filter(F.col(status).isin(groups[klass])) if klass in groups else parcels


def select_batch(parcels: DataFrame, village: str, ward: str | None = None, max_parcels: int = 50) -> DataFrame:
    """DRAFT parcels of a village (and ward), at most ``max_parcels``, lowest ids first."""
    if not 1 <= max_parcels <= 500:
        raise ValueError("max_parcels must be between 1 and 500")
    df = parcels.filter((F.col("village") == village) & (F.col("alignment_status") == "DRAFT"))
    if ward:
        df = df.filter(F.col("tehsil") == ward)
    return limit_n(df, max_parcels, "parcel_id")


def pending_approvals(approvals: DataFrame, parcels: DataFrame, include_approved: bool = True) -> DataFrame:
    """Open (and optionally approved) requests with their parcel, newest first."""
    wanted = ["pending", "approved"] if include_approved else ["pending"]
    keep = [c for c in ("khasra_no", "owner_name", "village", "tehsil", "district", "ulpin", "area_sqm",
                        "alignment_status", "alignment_confidence", "rings") if c in parcels.columns]
    p = parcels.select("parcel_id", F.struct(F.col("parcel_id").alias("id"), *keep).alias("parcel"))
    joined = approvals.filter(F.col("status").isin(wanted)).join(p, "parcel_id")
    return newest_first(joined.select("approval_id", "parcel_id", "requested_by", "status", "requested_at",
                                      *[F.col(f"parcel.{c}").alias(c) for c in keep], "parcel"))


def risk_register_join(plots: DataFrame, register: DataFrame, key: str = "khasra_no") -> DataFrame:
    """Band and texts from the register (khasra_no, band); plots outside it are GREEN.
    RED outranks AMBER when the register names a plot twice."""
    clean = F.trim(F.replace(F.col(key), F.lit("Kh."), F.lit("")))
    reg = register.groupBy(F.col("khasra_no").alias("_k")).agg(F.max("band").alias("_band"))
    band = F.coalesce(F.col("_band"), F.lit("GREEN"))

    def text(i):
        return F.when(band == "RED", BAND_TEXT["RED"][i]).when(band == "AMBER", BAND_TEXT["AMBER"][i]).otherwise(BAND_TEXT["GREEN"][i])

    return (plots.withColumn("_k", clean).join(reg, "_k", "left")
            .withColumn("register_band", band).withColumn("situation", text(0)).withColumn("reason", text(1))
            .drop("_k", "_band"))


def _falsy_to_null(c: Column, dtype: str) -> Column:
    if dtype in ("string",):
        return F.nullif(c, F.lit(""))
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        return F.when((c != 0) & ~F.isnan(c.cast("double")), c)
    return c


def first_truthy(*pairs: tuple[Column, str], default=None) -> Column:
    """First value that is neither null, empty text nor zero."""
    options = [_falsy_to_null(c, t) for c, t in pairs]
    return F.coalesce(*options, F.lit(default)) if default is not None else F.coalesce(*options)


def enrich_with_local(remote: DataFrame, local: DataFrame, columns: dict[str, object], key: str = "khasra_no") -> DataFrame:
    """Left join on the plot number; each listed column takes remote, else local, else its default.
    Where local holds a plot number twice, the lowest parcel id speaks for it."""
    types = dict(remote.dtypes)
    order = F.col("parcel_id") if "parcel_id" in local.columns else F.struct(*columns)
    one = local.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_l"))
    out = remote.join(one, key, "left")
    for c, default in columns.items():
        out = out.withColumn(c, first_truthy((F.col(c), types[c]), (F.col(f"_l.{c}"), types[c]), default=default))
    return out.drop("_l")


def merge_prefer_local(local: DataFrame, remote: DataFrame, key: str = "khasra_no") -> DataFrame:
    """All local rows, then the remote rows whose key local does not hold."""
    return local.unionByName(remote.join(distinct_keys(local, key), key, "left_anti"), allowMissingColumns=True)


union_precedence = merge_prefer_local


def distinct_keys(df: DataFrame, key: str = "khasra_no") -> DataFrame:
    return df.select(key).distinct()


def mark_approved(docket: DataFrame, approved_ids: DataFrame) -> DataFrame:
    """Approved when parcel id, approval id or plot number is in the set. The three keys are
    three equi-joins, never one OR-join."""
    ids = approved_ids.select(F.col("id").cast("string").alias("_id")).filter("_id is not null").distinct()
    out = docket
    for i, key in enumerate(("parcel_id", "approval_id", "khasra_no")):
        hit = ids.select(F.col("_id").alias(f"_k{i}"), F.lit(True).alias(f"_h{i}"))
        out = out.join(hit, F.col(key).cast("string") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    hit = F.coalesce(F.col("_h0"), F.col("_h1"), F.col("_h2"), F.lit(False))
    return out.withColumn("is_approved", hit | (F.col("status") == "approved")).drop("_h0", "_h1", "_h2")


def resolve_parcel(requests: DataFrame, parcels: DataFrame) -> DataFrame:
    """Attach the parcel a request means: by id, else by plot number (and village when given),
    else by the plot number inside a composite id; lowest parcel id wins. Null means a new parcel.

    ``requests`` needs request_id, parcel_ref, khasra_no, village. Each key is looked up in a table
    with one row per key, so a plot number that fills a third of the parcels costs one row."""
    from ..functions.codes import khasra_from_id

    p = parcels.select("parcel_id", "khasra_no", "village")
    by_id = p.select(F.col("parcel_id").cast("string").alias("_ref"), F.col("parcel_id").alias("_p1"))
    by_kv = p.groupBy(F.col("khasra_no").alias("_k"), F.col("village").alias("_v")).agg(F.min("parcel_id").alias("_p2"))
    by_k = p.groupBy(F.col("khasra_no").alias("_k")).agg(F.min("parcel_id").alias("_p3"))
    by_c = by_k.select(F.col("_k").alias("_ck"), F.col("_p3").alias("_p4"))
    # A missing key becomes one of the request's own that no parcel has, so requests without it do not meet in one task.
    own = lambda c: F.coalesce(c, F.concat(F.lit("\0"), F.col("request_id").cast("string")))
    k = F.col("khasra_no")
    r = requests.withColumns({"_rf": own(F.col("parcel_ref").cast("string")), "_rk": own(F.when(F.col("village").isNotNull(), k)), "_rn": own(F.when(F.col("village").isNull(), k)), "_rc": own(khasra_from_id(F.col("parcel_ref")))})
    out = (r.join(by_id, F.col("_rf") == F.col("_ref"), "left")
           .join(by_kv, (F.col("_rk") == F.col("_k")) & (F.col("village") == F.col("_v")), "left").drop("_k", "_v")
           .join(by_k, F.col("_rn") == F.col("_k"), "left").drop("_k")
           .join(by_c, F.col("_rc") == F.col("_ck"), "left"))
    return out.withColumn("resolved_id", F.coalesce("_p1", "_p2", "_p3", "_p4")).drop("_ref", "_p1", "_p2", "_p3", "_p4", "_ck", "_rf", "_rk", "_rn", "_rc")
