"""State changes and audit."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rings as R
from ..operators import alignment as AL
from ..operators import workflow as WF
from .q_geometry import DEG_AREA, SIDES, area_sql, ulpin_sql
from .q_relational import REGISTRATIONS, REQUESTS, RESOLVED, registrations, requests
from .registry import query
from .views import bent, parcels, view, with_views


@query("m1_register_parcels", with_views("WITH " + REGISTRATIONS + f"""
SELECT parcel_id, 'DRAFT' AS alignment_status, round((y0 + y1) / 2, 6) AS centroid_lat, round((x0 + x1) / 2, 6) AS centroid_lon, round({DEG_AREA} * 111320e0 * (111320e0 * 0.89e0), 2) AS area_sqm
FROM reg WHERE regexp_full_match(khasra_no, '[0-9]+(/[0-9]+)?') AND regexp_full_match(owner_name, '[A-Za-z\\s]{{2,100}}')""", "parcels"))
def m1(spark, d):
    good, _ = WF.register_parcels(registrations(spark, d))
    return good.select("parcel_id", "alignment_status", "centroid_lat", "centroid_lon", "area_sqm")


EDITS = f"""e AS (SELECT event_id, parcel_id, ts, value, event_id % 7 = 0 AS short, event_id % 5 = 0 AS bow FROM survey_events WHERE action = 'SUBMIT'),
good AS (SELECT e.event_id, e.ts, p.*, CASE WHEN p.parcel_id % 2 <> 0 AND value <> 0 THEN value WHEN bow THEN {area_sql("(x1 - x0) * (y1 - y0) * 0.25e0")} ELSE {area_sql("(x1 - x0) * (y1 - y0) * 0.5e0")} END AS sqm,
 CASE WHEN bow THEN 2 ELSE 1 END AS n_parts FROM e JOIN parcels p ON e.parcel_id = p.parcel_id WHERE NOT short)"""


def edited(spark, d):
    """Edits from the submitted events: the left half of the parcel as latitude/longitude pairs without the closing
    point, every fifth crossed over itself, every seventh of two points; some parcels are unknown, many are edited often."""
    p = parcels(spark, d)
    mid = (F.col("x0") + F.col("x1")) / 2
    a, b, c, e = R.point(F.col("y0"), F.col("x0")), R.point(F.col("y0"), mid), R.point(F.col("y1"), mid), R.point(F.col("y1"), F.col("x0"))
    ring = F.when(F.col("event_id") % 7 == 0, F.array(a, b)).when(F.col("event_id") % 5 == 0, F.array(a, c, b, e)).otherwise(F.array(a, b, c, e))
    ev = view(spark, d, "survey_events").filter("action = 'SUBMIT'").join(p.select("parcel_id", "x0", "y0", "x1", "y1"), "parcel_id", "left")
    return WF.update_boundaries(p, ev.select(
        F.col("event_id").alias("edit_id"), "parcel_id", ring.alias("ring"), F.when(F.col("parcel_id") % 2 != 0, F.col("value")).alias("area_sqm"),
        F.lit("patwari_01").alias("modified_by"), F.lit("edit").alias("notes"), "ts"))


@query("m2_update_boundaries", with_views("WITH " + EDITS + """, l AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts DESC, event_id DESC) AS rn FROM good)
SELECT p.parcel_id, l.sqm AS area_sqm, round(CASE WHEN l.parcel_id IS NULL THEN NULL ELSE (l.y0 + l.y1) / 2 END, 6) AS centroid_lat, coalesce(l.n_parts, 1) AS n_parts
FROM parcels p LEFT JOIN l ON p.parcel_id = l.parcel_id AND l.rn = 1""", "parcels", "survey_events"))
def m2(spark, d):
    out, _, _ = edited(spark, d)
    return out.select("parcel_id", "area_sqm", F.round("centroid_lat", 6).alias("centroid_lat"), F.size("parts").alias("n_parts"))


@query("m2_audit", with_views("WITH " + EDITS + """ SELECT event_id AS edit_id, parcel_id, lag(sqm) OVER (PARTITION BY parcel_id ORDER BY ts, event_id) AS previous_sqm, sqm AS new_sqm FROM good""", "parcels", "survey_events"))
def m2_audit(spark, d):
    _, audit, _ = edited(spark, d)
    return audit.select("edit_id", "parcel_id", F.col("previous_state").cast("double").alias("previous_sqm"), F.get_json_object("new_state", "$.area_sqm").cast("double").alias("new_sqm"))


@query("m2_rejects", with_views("WITH " + EDITS + """ SELECT e.event_id AS edit_id, CASE WHEN p.parcel_id IS NULL THEN 'unknown parcel' ELSE 'fewer than three points' END AS reason
FROM e LEFT JOIN parcels p ON e.parcel_id = p.parcel_id WHERE p.parcel_id IS NULL OR short""", "parcels", "survey_events"))
def m2_rejects(spark, d):
    _, _, rejects = edited(spark, d)
    return rejects.select("edit_id", "reason")


@query("m3_apply_cleanup", with_views("WITH " + SIDES + f" SELECT parcel_id, khasra_no, {area_sql('(coalesce(rx, x1) - coalesce(lx, x0)) * (y1 - y0)')} AS area_sqm, 'TOPOLOGY_CLEANED' AS alignment_status FROM sides", "parcels"))
def m3(spark, d):
    return WF.apply_cleanup(parcels(spark, d)).select("parcel_id", "khasra_no", "area_sqm", "alignment_status")


@query("m4_assign_ulpins", with_views(f"""WITH c AS (SELECT parcel_id, khasra_no, owner_name, village, round((y0 + y1) / 2, 6) AS centroid_lat, round((x0 + x1) / 2, 6) AS centroid_lon, {area_sql()} AS area_sqm FROM parcels),
u AS (SELECT *, {ulpin_sql("centroid_lat", "centroid_lon")} FROM c)
SELECT parcel_id, khasra_no, owner_name, village, 'ULPIN_ASSIGNED' AS alignment_status, ulpin, area_sqm, centroid_lat, centroid_lon FROM u""", "parcels"))
def m4(spark, d):
    return WF.assign_ulpins(parcels(spark, d)).select(
        "parcel_id", "khasra_no", "owner_name", "village", "alignment_status", "ulpin", "area_sqm", "centroid_lat", "centroid_lon")


# Control points on a known spline, which the fit through them is then.
@query("m5_align_parcels", with_views(f"""WITH cf AS (SELECT sheet_id, greatest(round((0.8e0 + 0.2e0 * least(1e0, count(*) / 2e2)) * 1e2, 2), least(98.5e0, 88e0 + count(*) * 2e0)) AS c FROM spline_gcps GROUP BY sheet_id)
SELECT p.parcel_id, round({bent("x0", "y0")[0]}, 5) AS ux, round({bent("x1", "y1")[1]}, 5) AS vy, 'thin_plate_spline' AS method, 'ALIGNED_DRAFT' AS alignment_status, round(cf.c / 1e2, 4) AS alignment_confidence, CAST(NULL AS VARCHAR) AS error
FROM parcels p JOIN cf ON cf.sheet_id = p.parcel_id % 128
UNION ALL SELECT parcel_id, NULL, NULL, NULL, NULL, NULL, 'no control points' FROM parcels WHERE parcel_id % 128 NOT IN (SELECT sheet_id FROM cf)""", "parcels", "spline_gcps"))
def m5(spark, d):
    p = parcels(spark, d).withColumn("sheet_id", F.col("parcel_id") % 128)
    done, failed = AL.align_parcels(p, view(spark, d, "spline_gcps"))
    ok = done.select("parcel_id", F.round(F.col("rings")[0][0]["x"], 5).alias("ux"), F.round(F.col("rings")[0][2]["y"], 5).alias("vy"), "method", "alignment_status", "alignment_confidence", F.lit(None).cast("string").alias("error"))
    return ok.unionByName(failed.select("parcel_id", "error"), allowMissingColumns=True)


@query("m6_discard_drafts", with_views("""SELECT parcel_id, CASE WHEN parcel_id IN (SELECT parcel_id FROM survey_events WHERE action = 'DRAFT_DISCARD') THEN 'DRAFT' ELSE alignment_status END AS alignment_status,
 CASE WHEN parcel_id IN (SELECT parcel_id FROM survey_events WHERE action = 'DRAFT_DISCARD') THEN NULL ELSE alignment_confidence END AS alignment_confidence FROM parcels""", "parcels", "survey_events"))
def m6(spark, d):
    ids = view(spark, d, "survey_events").filter("action = 'DRAFT_DISCARD'")
    return WF.discard_drafts(view(spark, d, "parcels"), ids).select("parcel_id", "alignment_status", "alignment_confidence")


def submissions(spark, d):
    return requests(spark, d).withColumns({"owner_name": F.lit(None).cast("string"), "tehsil": F.lit("Central"), "alignment_confidence": F.lit(None).cast("double")})


CURRENT = """cur AS (SELECT parcel_id, approval_id FROM (SELECT parcel_id, approval_id, row_number() OVER (PARTITION BY parcel_id ORDER BY requested_at DESC, approval_id) AS rn FROM approvals WHERE status = 'pending') WHERE rn = 1)"""


@query("m7_submit_approvals", with_views("WITH " + REQUESTS.format(events="events") + ", " + RESOLVED + ", " + CURRENT + """, lastr AS (SELECT resolved_id, arg_max(requested_by, (requested_at, request_id)) AS requested_by, max(requested_at) AS requested_at FROM resolved WHERE resolved_id IS NOT NULL GROUP BY resolved_id),
st AS (SELECT c.approval_id, l.requested_by, l.requested_at FROM lastr l JOIN cur c ON l.resolved_id = c.parcel_id)
SELECT 'request' AS kind, CAST(a.approval_id AS VARCHAR) AS id, coalesce(st.requested_by, a.requested_by) AS who, coalesce(st.requested_at, a.requested_at) AS at FROM approvals a LEFT JOIN st ON a.approval_id = st.approval_id
UNION ALL SELECT 'opened', CAST(l.resolved_id AS VARCHAR), l.requested_by, l.requested_at FROM lastr l WHERE l.resolved_id NOT IN (SELECT parcel_id FROM cur)
UNION ALL SELECT 'opened', sha256(concat_ws('|', coalesce(khasra_no, '101'), coalesce(village, 'Revenue Halqa'))), arg_max(requested_by, (requested_at, request_id)), max(requested_at) FROM resolved WHERE resolved_id IS NULL GROUP BY 2""",
    "parcels", "approvals"))
def m7(spark, d):
    out = WF.submit_approvals(submissions(spark, d), view(spark, d, "parcels").withColumn("area_sqm", F.lit(100.0)), view(spark, d, "approvals"))
    one = out["approvals"].select(F.lit("request").alias("kind"), F.col("approval_id").cast("string").alias("id"), F.col("requested_by").alias("who"), F.col("requested_at").alias("at"))
    return one.unionByName(out["opened"].select(F.lit("opened").alias("kind"), F.col("parcel_key").alias("id"), F.col("requested_by").alias("who"), F.col("requested_at").alias("at")))


@query("m7_submit_parcels", with_views("WITH " + REQUESTS.format(events="events") + ", " + RESOLVED + """, u AS (SELECT resolved_id, arg_max(area_sqm, (requested_at, request_id)) FILTER (area_sqm > 0) AS a, arg_max(village, (requested_at, request_id)) FILTER (village IS NOT NULL) AS v, count(*) AS n FROM resolved WHERE resolved_id IS NOT NULL GROUP BY resolved_id)
SELECT p.parcel_id, coalesce(u.v, p.village) AS village, coalesce(u.a, 1e2) AS area_sqm, CASE WHEN u.n IS NOT NULL THEN 'Central' ELSE p.tehsil END AS tehsil FROM parcels p LEFT JOIN u ON p.parcel_id = u.resolved_id""", "parcels"))
def m7b(spark, d):
    out = WF.submit_approvals(submissions(spark, d), view(spark, d, "parcels").withColumn("area_sqm", F.lit(100.0)), view(spark, d, "approvals"))
    return out["parcels"].select("parcel_id", "village", "area_sqm", "tehsil")


def actions(spark, d):
    """Two decisions per request on every third request, some by roles that may not act."""
    a = view(spark, d, "approvals").filter("approval_id % 3 <> 0")
    i = F.col("approval_id")
    twice = a.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    act = F.when((i + F.col("k")) % 4 == 0, "approved").when((i + F.col("k")) % 4 == 1, "rejected").when((i + F.col("k")) % 4 == 2, "revision_requested").otherwise("shelved")
    return twice.select((i * 2 + F.col("k")).alias("action_id"), "approval_id", act.alias("action"), F.lit("tehsildar_01").alias("reviewed_by"),
                        F.lit("seen").alias("remarks"), F.when(i % 10 == 0, " Patwari").otherwise("tehsildar").alias("role"),
                        (F.col("requested_at") + F.expr("make_interval(0, 0, 0, k)")).alias("ts"))


ACTIONS = """act AS (SELECT approval_id * 2 + k AS action_id, approval_id, parcel_id, status, CASE (approval_id + k) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'revision_requested' ELSE 'shelved' END AS action,
  approval_id % 10 = 0 AS patwari, requested_at + to_days(CAST(k AS INT)) AS ts FROM approvals, (SELECT unnest([0, 1]) AS k) WHERE approval_id % 3 <> 0),
good AS (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY ts, action_id) AS rn FROM act WHERE action <> 'shelved' AND NOT patwari AND status = 'pending')"""


@query("m8_apply_actions", with_views("WITH " + ACTIONS + """ SELECT a.approval_id, coalesce(g.action, a.status) AS status, coalesce(CASE WHEN g.action IS NOT NULL THEN 'seen' END, a.remarks) AS remarks, g.ts AS reviewed_at
FROM approvals a LEFT JOIN good g ON a.approval_id = g.approval_id AND g.rn = 1""", "approvals"))
def m8(spark, d):
    out = WF.apply_actions(actions(spark, d), view(spark, d, "approvals"), view(spark, d, "parcels"))
    return out["approvals"].select("approval_id", "status", "remarks", "reviewed_at")


@query("m8_action_rejects", with_views("WITH " + ACTIONS + """ SELECT a.action_id, CASE WHEN a.action = 'shelved' THEN 'invalid action' WHEN a.patwari THEN 'role may not act' ELSE 'request not pending' END AS reason
FROM act a LEFT JOIN good g ON a.action_id = g.action_id AND g.rn = 1 WHERE g.action_id IS NULL""", "approvals"))
def m8b(spark, d):
    out = WF.apply_actions(actions(spark, d), view(spark, d, "approvals"), view(spark, d, "parcels"))
    return out["rejects"].select("action_id", "reason")


@query("m8_action_parcels", with_views("WITH " + ACTIONS + """, b AS (SELECT parcel_id, arg_max(action, (ts, action_id)) AS action FROM good WHERE rn = 1 AND action <> 'approved' GROUP BY parcel_id)
SELECT p.parcel_id, CASE b.action WHEN 'rejected' THEN 'DRAFT' WHEN 'revision_requested' THEN 'ALIGNED_DRAFT' ELSE p.alignment_status END AS alignment_status FROM parcels p LEFT JOIN b ON p.parcel_id = b.parcel_id""", "parcels", "approvals"))
def m8c(spark, d):
    out = WF.apply_actions(actions(spark, d), view(spark, d, "approvals"), view(spark, d, "parcels"))
    return out["parcels"].select("parcel_id", "alignment_status")


def commits(spark, d):
    e = view(spark, d, "survey_events").filter("action = 'APPROVE'")
    i = F.col("event_id")
    return e.select(i.alias("commit_id"), F.when(i % 5 == 0, F.col("parcel_id") + 1000000).otherwise(F.col("parcel_id")).alias("parcel_id"),
                    F.when(i % 2 == 0, F.concat(F.lit("C"), i.cast("string"))).alias("ulpin"), F.lit("off_1").alias("officer_id"), F.lit("ok").alias("notes"), "ts")


COMMITS = """com AS (SELECT event_id AS commit_id, CASE WHEN event_id % 5 = 0 THEN parcel_id + 1000000 ELSE parcel_id END AS parcel_id, CASE WHEN event_id % 2 = 0 THEN concat('C', CAST(event_id AS VARCHAR)) END AS ulpin, ts FROM survey_events WHERE action = 'APPROVE'),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts DESC, commit_id DESC) AS rn FROM com) WHERE rn = 1),
own AS (SELECT parcel_id, alignment_status, CASE WHEN parcel_id % 2 = 0 THEN concat('P', CAST(parcel_id AS VARCHAR)) END AS ulpin FROM parcels)"""


def _own(spark, d):
    i = F.col("parcel_id")
    return view(spark, d, "parcels").select("parcel_id", "alignment_status", F.when(i % 2 == 0, F.concat(F.lit("P"), i.cast("string"))).alias("ulpin"), F.lit(12.5).alias("area_sqm"))


@query("m9_commit_parcels", with_views("WITH " + COMMITS + """ SELECT o.parcel_id, CASE WHEN l.parcel_id IS NOT NULL AND coalesce(l.ulpin, o.ulpin) IS NOT NULL THEN 'PUBLISHED' ELSE o.alignment_status END AS alignment_status,
 CASE WHEN l.parcel_id IS NOT NULL THEN coalesce(l.ulpin, o.ulpin) ELSE o.ulpin END AS ulpin,
 CASE WHEN l.parcel_id IS NOT NULL AND coalesce(l.ulpin, o.ulpin) IS NOT NULL THEN concat('{"status":"PUBLISHED","ulpin":"', coalesce(l.ulpin, o.ulpin), '","area_sqm":12.5,"notes":"ok"}') END AS new_state
FROM own o LEFT JOIN lst l ON o.parcel_id = l.parcel_id""", "parcels", "survey_events"))
def m9(spark, d):
    out = WF.commit_parcels(commits(spark, d), _own(spark, d))
    return out["parcels"].join(out["audit"].select("parcel_id", "new_state"), "parcel_id", "left").select("parcel_id", "alignment_status", "ulpin", "new_state")


@query("m9_commit_rejects", with_views("WITH " + COMMITS + """ SELECT c.commit_id, CASE WHEN o.parcel_id IS NULL THEN 'parcel not found' WHEN c.commit_id <> l.commit_id THEN 'superseded' ELSE 'no code' END AS reason
FROM com c LEFT JOIN own o ON c.parcel_id = o.parcel_id LEFT JOIN lst l ON c.parcel_id = l.parcel_id WHERE o.parcel_id IS NULL OR c.commit_id <> l.commit_id OR coalesce(l.ulpin, o.ulpin) IS NULL""", "parcels", "survey_events"))
def m9b(spark, d):
    return WF.commit_parcels(commits(spark, d), _own(spark, d))["rejects"].select("commit_id", "reason")


@query("m10_reset_workflow", with_views("SELECT 'DRAFT' AS alignment_status, count(*) AS n_parcels, CAST(0 AS BIGINT) AS n_approvals FROM parcels", "parcels"))
def m10(spark, d):
    a = view(spark, d, "approvals")
    out = WF.reset_workflow(view(spark, d, "parcels"), a, a)
    n = out["approvals"].agg(F.count("*").alias("n_approvals")).withColumn("k", F.lit(1))
    return out["parcels"].groupBy("alignment_status").agg(F.count("*").alias("n_parcels")).withColumn("k", F.lit(1)).join(n, "k").drop("k")


@query("w2_current_request", with_views("WITH " + CURRENT + " SELECT parcel_id, approval_id FROM cur", "approvals"))
def w2(spark, d):
    return WF.current_request(view(spark, d, "approvals")).select("parcel_id", "approval_id")


AUDIT = """audit AS (SELECT event_id AS audit_id, parcel_id, ts, action AS new_state, CASE WHEN event_id % 3 = 0 THEN 'DRAFT_PUT' WHEN event_id % 3 = 1 THEN 'SUBMIT' END AS previous_state FROM survey_events)"""


def audit(spark, d):
    i = F.col("event_id")
    return view(spark, d, "survey_events").select(i.alias("audit_id"), "parcel_id", "ts", F.col("action").alias("new_state"),
                                                  F.when(i % 3 == 0, "DRAFT_PUT").when(i % 3 == 1, "SUBMIT").alias("previous_state"))


@query("w3_audit_trail", with_views("WITH " + AUDIT + " SELECT audit_id, parcel_id, ts, new_state FROM audit ORDER BY ts DESC, audit_id", "survey_events"))
def w3(spark, d):
    return WF.audit_trail(audit(spark, d)).select("audit_id", "parcel_id", "ts", "new_state")


@query("w3_audit_continuity", with_views("WITH " + AUDIT + """, l AS (SELECT *, lag(new_state) OVER (PARTITION BY parcel_id ORDER BY ts, audit_id) AS prior_state FROM audit)
SELECT audit_id, prior_state, prior_state IS NULL OR prior_state IS NOT DISTINCT FROM previous_state AS continuous FROM l""", "survey_events"))
def w3b(spark, d):
    return WF.audit_continuity(audit(spark, d)).select("audit_id", "prior_state", "continuous")
