"""State changes as table functions: current tables and change rows in, new tables, audit rows and
rejects out. Nothing is updated in place; callers write the results as a new snapshot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions.codes import state_signature, ulpin
from ..functions.projection import fix_axis_order
from ..session import cut_lineage
from .relational import resolve_parcel
from .topology import clean_topology, make_valid
from .validation import ACTIONS, validate_registrations

# What a parcel created by a request gets where the request is silent.
NEW_PARCEL = {"khasra_no": "101", "village": "Revenue Halqa", "tehsil": "Central Tehsil", "district": "Lucknow"}
NEW_AREA_SQM, NEW_CONFIDENCE = 10000.0, 0.95
BOX = ["minx", "miny", "maxx", "maxy"]


def _micros(c) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _coded(parcels: DataFrame) -> DataFrame:
    """Adds ``_ac`` (area, centroid) once, so that later expressions share it."""
    return parcels.withColumn("_ac", R.area_centroid(F.col("rings")))


# ---- registration, codes, geometry edits ---------------------------------------------------------

def register_parcels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid registrations as DRAFT parcels (registration area formula), and the rejects."""
    checked = validate_registrations(rows)
    good = _coded(checked.filter(F.size("reasons") == 0))
    drafts = good.select(
        *[c for c in rows.columns if c not in ("owner_phone",)], F.lit("DRAFT").alias("alignment_status"),
        F.round("_ac.y", 6).alias("centroid_lat"), F.round("_ac.x", 6).alias("centroid_lon"),
        R.area_sqm(F.col("rings"), "registration").alias("area_sqm"))
    return drafts, checked.filter(F.size("reasons") > 0)


def assign_ulpins(parcels: DataFrame) -> DataFrame:
    """Centroid, ground area and location code of every parcel; a projection without shuffle."""
    own = [c for c in parcels.columns if c not in ("ulpin", "centroid_lat", "centroid_lon", "area_sqm", "alignment_status")]
    c = _coded(parcels.select(*own)).select(
        *own, F.round("_ac.y", 6).alias("centroid_lat"), F.round("_ac.x", 6).alias("centroid_lon"),
        F.round(R.metric_area(F.col("_ac.area"), F.col("_ac.y")), 2).alias("area_sqm"))
    return c.select("*", ulpin(F.col("centroid_lat"), F.col("centroid_lon")).alias("ulpin"), F.lit("ULPIN_ASSIGNED").alias("alignment_status"))


def apply_cleanup(parcels: DataFrame, tol: float | None = None, priority: str | None = None) -> DataFrame:
    """Cleaned geometry and area, status TOPOLOGY_CLEANED."""
    kw = {} if tol is None else {"tol": tol}
    clean = clean_topology(parcels, priority=priority, **kw).select(
        "parcel_id", F.col("rings").alias("_r"), F.col("area_sqm").alias("_a"))
    own = [c for c in parcels.columns if c not in ("rings", "area_sqm", "alignment_status", *BOX)]
    return parcels.select(*own).join(clean, "parcel_id").select(
        *own, F.col("_r").alias("rings"), F.col("_a").alias("area_sqm"), F.lit("TOPOLOGY_CLEANED").alias("alignment_status"))


def update_boundaries(parcels: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hand-edited outlines: parcels after the edits, one audit row per edit, and the rejects.

    ``edits``: edit_id (unique), parcel_ref, khasra_no, village (as ``resolve_parcel`` takes them; a plain
    parcel_id does instead), ring (any axis order, open or closed), area_sqm (wins when given), modified_by, notes,
    ts. Edits take effect in order of ts and edit_id. A repaired outline keeps all its parts in ``parts``, largest
    first; area and centroid are theirs together, ``rings`` is the largest. An edit of an unknown parcel, with
    fewer than three points or without area is rejected with the reason."""
    if "parcel_ref" in edits.columns:
        asked = resolve_parcel(edits.withColumnRenamed("edit_id", "request_id"), parcels).withColumnRenamed("request_id", "edit_id").withColumnRenamed("resolved_id", "parcel_id")
    else:
        known = parcels.select("parcel_id", F.lit(True).alias("_known"))
        asked = edits.join(known, "parcel_id", "left").withColumn("parcel_id", F.when(F.col("_known"), F.col("parcel_id")))
    asked = asked.withColumn("rings", F.array(fix_axis_order(F.col("ring"))))
    unknown, short = F.col("parcel_id").isNull(), F.col("rings")[0].isNull()
    sized = R.area_centroid(F.col("rings"))
    # The parts of one outline, at most as many as it has edges, meet in one row.
    shapes = make_valid(asked.filter(~unknown & ~short), "edit_id").withColumn("_m", sized).filter(F.col("_m.area") > 0)
    parts = shapes.groupBy("edit_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_m.area").alias("area"), F.col("part_no"), F.col("rings"))), asc=False).alias("_p"),
        F.sum("_m.area").alias("_area"), F.sum(F.col("_m.area") * F.col("_m.x")).alias("_mx"), F.sum(F.col("_m.area") * F.col("_m.y")).alias("_my"))
    e = asked.select("edit_id", "parcel_id", F.col("area_sqm").alias("_user"), "modified_by", "notes", "ts", unknown.alias("_unknown"), short.alias("_short")).join(parts, "edit_id", "left")
    x, y = F.col("_mx") / F.col("_area"), F.col("_my") / F.col("_area")
    e = e.withColumns({"_x": x, "_y": y}).withColumn("_sqm", F.coalesce(F.when(F.col("_user") != 0, F.col("_user")), F.round(R.metric_area(F.col("_area"), F.col("_y")), 2)))
    reason = F.when(F.col("_unknown"), "unknown parcel").when(F.col("_short"), "fewer than three points").when(F.col("_p").isNull(), "no area")
    e = cut_lineage(e.withColumn("reason", reason))
    rejects = e.filter(F.col("reason").isNotNull()).select("edit_id", "parcel_id", "modified_by", "ts", "reason")
    good = e.filter(F.col("reason").isNull())

    def was(c):
        return F.col(c) if c in parcels.columns else F.lit(None).cast("double")

    # The latest edit by plain values first; its shape is attached afterwards.
    newest = good.groupBy("parcel_id").agg(F.max("ts").alias("ts"))
    last = good.join(newest, ["parcel_id", "ts"]).groupBy("parcel_id").agg(F.max("edit_id").alias("edit_id"))
    shaped = good.join(last.select("edit_id"), "edit_id").select("parcel_id", "_p", "_sqm", "_x", "_y")
    own = [c for c in parcels.columns if c not in ("rings", "parts", "area_sqm", "centroid_lat", "centroid_lon", *BOX)]
    out = parcels.withColumns({"_old": was("area_sqm"), "_lat": was("centroid_lat"), "_lon": was("centroid_lon")}).join(shaped, "parcel_id", "left").select(
        *own, F.coalesce(F.col("_p")[0]["rings"], "rings").alias("rings"), F.coalesce(F.transform("_p", lambda p: p["rings"]), F.array("rings")).alias("parts"),
        F.coalesce("_sqm", "_old").alias("area_sqm"), F.coalesce("_y", "_lat").alias("centroid_lat"), F.coalesce("_x", "_lon").alias("centroid_lon"))
    in_turn = Window.partitionBy("parcel_id").orderBy("ts", "edit_id")  # the edits of one parcel
    audit = good.select("edit_id", "parcel_id", "_sqm", "modified_by", "notes", "ts").join(parcels.select("parcel_id", was("area_sqm").alias("_old")), "parcel_id").select(
        "edit_id", "parcel_id", F.col("modified_by").alias("officer_id"), F.lit("PATWARI").alias("officer_role"),
        F.lit("MANUAL_BOUNDARY_ADJUST").alias("action"), F.coalesce(F.lag("_sqm").over(in_turn), "_old").cast("string").alias("previous_state"),
        F.to_json(F.struct(F.col("_sqm").alias("area_sqm"), "notes")).alias("new_state"),
        F.sha2(F.concat_ws(":", F.col("parcel_id").cast("string"), F.col("_sqm").cast("string"), F.col("ts").cast("string"), F.col("edit_id").cast("string")), 256).alias("digital_signature"),
        "ts")
    return out, audit, rejects


def discard_drafts(parcels: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed parcels go back to DRAFT without a confidence."""
    hit = ids.select("parcel_id").distinct().withColumn("_hit", F.lit(True))
    out = parcels.join(hit, "parcel_id", "left")
    gone = F.col("_hit").isNotNull()
    return (out.withColumn("alignment_status", F.when(gone, "DRAFT").otherwise(F.col("alignment_status")))
            .withColumn("alignment_confidence", F.when(~gone, F.col("alignment_confidence"))).select(*parcels.columns))


# ---- approvals -----------------------------------------------------------------------------------

def current_request(approvals: DataFrame) -> DataFrame:
    """The pending request of each parcel: newest, then lowest id. A hash aggregate, so a parcel with
    very many requests is reduced before the shuffle."""
    cols = [c for c in approvals.columns if c != "parcel_id"]
    order = F.struct((-_micros("requested_at")).alias("t"), F.col("approval_id").alias("i"))
    best = approvals.filter(F.col("status") == "pending").groupBy("parcel_id").agg(F.min_by(F.struct(*cols), order).alias("r"))
    return best.select("parcel_id", "r.*").select(*approvals.columns)


def submit_approvals(requests: DataFrame, parcels: DataFrame, approvals: DataFrame) -> dict[str, DataFrame]:
    """Survey submissions. Known parcels take the latest non-empty values, unknown plots become new
    parcels, a pending request is re-stamped and otherwise a new one is opened.

    ``requests``: request_id, parcel_ref, khasra_no, village, owner_name, tehsil, area_sqm,
    alignment_confidence, requested_by, requested_at. Returns parcels, new_parcels, approvals and opened
    (the requests that are new, keyed by the submission that opened them)."""
    r = resolve_parcel(requests, parcels).withColumn("_o", F.struct(_micros("requested_at").alias("t"), F.col("request_id").alias("i")))
    known = r.filter(F.col("resolved_id").isNotNull())

    def latest(c, ok=None):
        ok = F.col(c).isNotNull() if ok is None else ok
        return F.max_by(F.col(c), F.when(ok, F.col("_o")))

    def text(c):
        return latest(c, F.col(c).isNotNull() & (F.col(c) != "")).alias(f"_{c}")

    upd = known.groupBy(F.col("resolved_id").alias("parcel_id")).agg(
        text("village"), text("tehsil"), text("owner_name"), latest("area_sqm", F.col("area_sqm") > 0).alias("_area_sqm"),
        latest("alignment_confidence").alias("_alignment_confidence"),
        F.max_by(F.struct("request_id", "requested_by", "requested_at"), "_o").alias("_last"))
    joined = parcels.join(upd, "parcel_id", "left")
    fields = [c for c in ("village", "tehsil", "owner_name", "area_sqm", "alignment_confidence") if c in parcels.columns]
    new = joined
    for c in fields:
        new = new.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    touched_raw = F.col("_last").isNotNull() & F.lower("alignment_status").eqNullSafe("raw")
    new = new.withColumn("alignment_status", F.when(touched_raw, "ALIGNED_DRAFT").otherwise(F.col("alignment_status"))).select(*parcels.columns)

    cur = current_request(approvals).select("approval_id", F.col("parcel_id").alias("_pid"))
    stamped = upd.select("parcel_id", "_last").join(cur, F.col("parcel_id") == F.col("_pid"), "left").drop("_pid")
    stamp = stamped.filter(F.col("approval_id").isNotNull()).select("approval_id", "_last")
    out = approvals.join(stamp, "approval_id", "left")
    out = (out.withColumn("requested_by", F.coalesce("_last.requested_by", "requested_by"))
           .withColumn("requested_at", F.coalesce("_last.requested_at", "requested_at")).select(*approvals.columns))

    fresh_key = F.sha2(F.concat_ws("|", F.coalesce("khasra_no", F.lit(NEW_PARCEL["khasra_no"])), F.coalesce("village", F.lit(NEW_PARCEL["village"]))), 256)
    fresh = r.filter(F.col("resolved_id").isNull()).withColumn("new_key", fresh_key).groupBy("new_key").agg(
        F.min_by("khasra_no", "_o").alias("khasra_no"), text("village").alias("village"), text("tehsil").alias("tehsil"),
        text("owner_name").alias("owner_name"), latest("area_sqm", F.col("area_sqm") > 0).alias("area_sqm"),
        latest("alignment_confidence").alias("alignment_confidence"),
        F.max_by(F.struct("request_id", "requested_by", "requested_at"), "_o").alias("_last"))
    no = F.coalesce("khasra_no", F.lit(NEW_PARCEL["khasra_no"]))
    born = fresh.select(
        "new_key", no.alias("khasra_no"), F.coalesce("owner_name", F.concat(F.lit("Khatedar (Khasra "), no, F.lit(")"))).alias("owner_name"),
        F.coalesce("village", F.lit(NEW_PARCEL["village"])).alias("village"), F.coalesce("tehsil", F.lit(NEW_PARCEL["tehsil"])).alias("tehsil"),
        F.lit(NEW_PARCEL["district"]).alias("district"), F.coalesce("area_sqm", F.lit(NEW_AREA_SQM)).alias("area_sqm"),
        F.coalesce("alignment_confidence", F.lit(NEW_CONFIDENCE)).alias("alignment_confidence"), F.lit("ALIGNED_DRAFT").alias("alignment_status"))
    opened = stamped.filter(F.col("approval_id").isNull()).select(
        F.col("parcel_id").cast("string").alias("parcel_key"), "_last.request_id", "_last.requested_by", "_last.requested_at", F.lit("pending").alias("status")
    ).unionByName(fresh.select(F.col("new_key").alias("parcel_key"), "_last.request_id", "_last.requested_by", "_last.requested_at", F.lit("pending").alias("status")))
    return {"parcels": new, "new_parcels": born, "approvals": out, "opened": opened}


def apply_actions(actions: DataFrame, approvals: DataFrame, parcels: DataFrame) -> dict[str, DataFrame]:
    """Decisions on pending requests. Only the first allowed action of a request counts.

    ``actions``: action_id, approval_id, action, reviewed_by, remarks, role, ts. Returns approvals,
    parcels (rejected → DRAFT, revision_requested → ALIGNED_DRAFT, approved leaves the status alone) and
    rejects with a reason."""
    a = actions.join(approvals.select("approval_id", F.col("status").alias("_was"), F.col("parcel_id").alias("_pid")), "approval_id", "left")
    why = (F.when(~F.col("action").isin(ACTIONS), "invalid action")
           .when(F.lower(F.trim("role")).eqNullSafe("patwari"), "role may not act")
           .when(F.col("_was").isNull(), "request not found")
           .when(F.col("_was") != "pending", "request not pending"))
    a = a.withColumn("reason", why)
    order = F.struct(_micros("ts").alias("t"), F.col("action_id").alias("i"))
    first = a.filter(F.col("reason").isNull()).groupBy("approval_id").agg(
        F.min_by(F.struct("action_id", "action", "reviewed_by", "remarks", "ts", F.col("_pid").alias("parcel_id")), order).alias("f"))
    late = a.filter(F.col("reason").isNull()).join(first.select("approval_id", F.col("f.action_id").alias("_win")), "approval_id").filter(
        F.col("action_id") != F.col("_win")).withColumn("reason", F.lit("request not pending"))
    cols = [c for c in approvals.columns if c not in ("reviewed_by", "reviewed_at", "status", "remarks")]
    out = approvals.join(first, "approval_id", "left").select(
        *cols, F.coalesce("f.action", "status").alias("status"), F.coalesce("f.remarks", "remarks").alias("remarks") if "remarks" in approvals.columns
        else F.col("f.remarks").alias("remarks"), F.col("f.reviewed_by").alias("reviewed_by"), F.col("f.ts").alias("reviewed_at"))
    back = first.select("f.*").filter(F.col("action").isin("rejected", "revision_requested")).groupBy("parcel_id").agg(
        F.max_by("action", order).alias("_last"))
    p = parcels.join(back, "parcel_id", "left").withColumn(
        "alignment_status", F.when(F.col("_last") == "rejected", "DRAFT").when(F.col("_last") == "revision_requested", "ALIGNED_DRAFT")
        .otherwise(F.col("alignment_status"))).select(*parcels.columns)
    rejects = a.filter(F.col("reason").isNotNull()).select("action_id", "approval_id", "reason").unionByName(
        late.select("action_id", "approval_id", "reason"))
    return {"approvals": out, "parcels": p, "rejects": rejects}


def _state(status: Column, code: Column, area: Column, *more: Column) -> Column:
    return F.to_json(F.struct(status.alias("status"), code.alias("ulpin"), area.alias("area_sqm"), *more), {"ignoreNullFields": "false"})


def commit_parcels(commits: DataFrame, parcels: DataFrame) -> dict[str, DataFrame]:
    """Publication: status PUBLISHED with a code, one signed audit row per commit, rejects for unknown
    parcels, commits without any code and commits overtaken by a later one of the same batch.

    ``commits``: commit_id, parcel_id, ulpin, officer_id, notes, ts."""
    order = F.struct(_micros("ts").alias("t"), F.col("commit_id").alias("i"))
    last = commits.groupBy("parcel_id").agg(F.max_by(F.struct("commit_id", "ulpin", "officer_id", "notes", "ts"), order).alias("c"))
    joined = parcels.join(last, "parcel_id", "left")
    code = F.coalesce(F.nullif(F.col("c.ulpin"), F.lit("")), F.nullif(F.col("ulpin"), F.lit("")))
    joined = joined.withColumn("_code", code).withColumn("_ok", F.col("c").isNotNull() & F.col("_code").isNotNull())
    ok = F.col("_ok")
    out = (joined.withColumn("_was", F.col("alignment_status")).withColumn("_old", F.col("ulpin"))
           .withColumn("alignment_status", F.when(ok, "PUBLISHED").otherwise(F.col("alignment_status")))
           .withColumn("ulpin", F.when(ok, F.col("_code")).otherwise(F.col("ulpin"))))
    states = out.filter(ok).withColumn("previous_state", _state(F.col("_was"), F.col("_old"), F.col("area_sqm"))).withColumn(
        "new_state", _state(F.lit("PUBLISHED"), F.col("_code"), F.col("area_sqm"), F.col("c.notes").alias("notes")))
    stamp = F.date_format(F.col("c.ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    audit = states.select(
        "parcel_id", F.col("c.officer_id").alias("officer_id"), F.lit("TEHSILDAR").alias("officer_role"), F.lit("COMMITTED").alias("action"),
        "previous_state", "new_state",
        state_signature(F.col("parcel_id"), F.col("_code"), F.col("c.officer_id"), stamp, F.col("new_state")).alias("digital_signature"),
        F.col("c.ts").alias("ts"))
    known = joined.filter(F.col("c").isNotNull()).select("parcel_id", F.col("c.commit_id").alias("_win"), "_ok")
    r = commits.join(known, "parcel_id", "left")
    reason = (F.when(F.col("_win").isNull(), "parcel not found").when(F.col("commit_id") != F.col("_win"), "superseded")
              .when(~F.col("_ok"), "no code"))
    rejects = r.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("commit_id", "parcel_id", "reason")
    return {"parcels": out.select(*parcels.columns), "audit": audit, "rejects": rejects}


def reset_workflow(parcels: DataFrame, approvals: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """Everything back to DRAFT, no requests, no audit rows."""
    return {"parcels": parcels.withColumn("alignment_status", F.lit("DRAFT")),
            "approvals": approvals.filter(F.lit(False)), "audit": audit.filter(F.lit(False))}


# ---- audit ---------------------------------------------------------------------------------------

def audit_trail(audit: DataFrame, parcel_id=None) -> DataFrame:
    """Audit rows newest first, of one parcel when given."""
    rows = audit if parcel_id is None else audit.filter(F.col("parcel_id") == parcel_id)
    return rows.orderBy(F.col("ts").desc_nulls_last(), F.col("audit_id"))


def audit_continuity(audit: DataFrame, bucket: str = "day") -> DataFrame:
    """Each audit row with the state the row before it left behind and whether the two agree.

    Rows look back inside their time bucket; the first of a bucket takes the last state of the parcel's
    previous bucket from a table with one row per parcel and bucket. So a parcel with a third of all rows
    is read in as many tasks as it has buckets."""
    a = audit.withColumn("_b", F.date_trunc(bucket, F.col("ts").cast("timestamp")))
    inside = Window.partitionBy("parcel_id", "_b").orderBy("ts", "audit_id")
    rows = a.withColumn("_rn", F.row_number().over(inside)).withColumn("_lag", F.lag("new_state").over(inside))
    ends = a.groupBy("parcel_id", "_b").agg(F.max_by("new_state", F.struct("ts", "audit_id")).alias("_end"))
    across = Window.partitionBy("parcel_id").orderBy("_b")
    ends = ends.withColumn("_before", F.lag("_end").over(across)).select("parcel_id", "_b", "_before")
    out = rows.join(ends, ["parcel_id", "_b"])
    prior = F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_lag"))
    return out.withColumn("prior_state", prior).withColumn(
        "continuous", F.col("prior_state").isNull() | F.col("prior_state").eqNullSafe(F.col("previous_state"))).select(
        *audit.columns, "prior_state", "continuous")
