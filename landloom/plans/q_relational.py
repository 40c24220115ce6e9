"""Projections, filters, key joins, aggregates, windows and orderings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import status as ST
from ..operators import aggregates as A
from ..operators import relational as RL
from ..operators import validation as VA
from .registry import query
from .views import load, parcels, view, with_views

# Parcels with the columns the listing needs; the code column stands in for an assigned ULPIN.
LISTED = """listed AS (SELECT parcel_id, khasra_no, owner_name, village, tehsil, district, alignment_status, alignment_confidence,
  CASE WHEN alignment_status IN ('ULPIN_ASSIGNED', 'PUBLISHED') THEN concat('UL', CAST(parcel_id * 37 % 997 AS STRING)) END AS ulpin,
  CASE WHEN parcel_id % 4 = 0 THEN 0e0 ELSE round(parcel_id * 1.5e0 + 1e2, 2) END AS area_sqm FROM parcels)"""


def listed(spark, d):
    p = view(spark, d, "parcels")
    i = F.col("parcel_id")
    return p.select(
        "parcel_id", "khasra_no", "owner_name", "village", "tehsil", "district", "alignment_status", "alignment_confidence",
        F.when(F.col("alignment_status").isin("ULPIN_ASSIGNED", "PUBLISHED"), F.concat(F.lit("UL"), (i * 37 % 997).cast("string"))).alias("ulpin"),
        F.when(i % 4 == 0, 0.0).otherwise(F.round(i * 1.5 + 100.0, 2)).alias("area_sqm"))


def _listed(sql, *more):
    return with_views("WITH " + LISTED + " " + sql, "parcels", *more)


def _sql_list(*extra_ctes_then_sql, views=()):
    *ctes, sql = extra_ctes_then_sql
    return with_views("WITH " + ", ".join([LISTED, *ctes]) + " " + sql, "parcels", *views)


@query("p1_parcel_summary", _sql_list("SELECT parcel_id, khasra_no, owner_name, village, alignment_status, ulpin, area_sqm FROM listed"))
def p1(spark, d):
    return RL.parcel_summary(listed(spark, d))


@query("p2_parcel_detail", _sql_list(
    "wanted AS (SELECT DISTINCT user_id * 17 AS parcel_id FROM events)",
    "SELECT w.parcel_id, l.khasra_no, CASE WHEN l.parcel_id IS NULL THEN 'missing' ELSE 'found' END AS state FROM wanted w LEFT JOIN listed l ON w.parcel_id = l.parcel_id"))
def p2(spark, d):
    wanted = load(spark, d, "events")["events"].select((F.col("user_id") * 17).alias("parcel_id"))
    hit, miss = RL.parcel_detail(listed(spark, d), wanted)
    return hit.select("parcel_id", "khasra_no", F.lit("found").alias("state")).unionByName(
        miss.select("parcel_id", F.lit(None).cast("string").alias("khasra_no"), F.lit("missing").alias("state")))


@query("p3_roster_search", _sql_list(
    """SELECT parcel_id, khasra_no, ulpin FROM listed WHERE (lower(khasra_no) LIKE '%12%' OR lower(owner_name) LIKE '%12%' OR coalesce(lower(ulpin) LIKE '%12%', FALSE))
       AND coalesce(ulpin <> '', FALSE)"""))
def p3(spark, d):
    return RL.roster_search(listed(spark, d), " 12 ", "ULPIN").select("parcel_id", "khasra_no", "ulpin")


DOCKET = """docket AS (SELECT a.approval_id, a.parcel_id, a.status, a.requested_at, l.khasra_no, l.owner_name, l.ulpin, l.alignment_confidence
  FROM approvals a JOIN listed l ON a.parcel_id = l.parcel_id)"""


def docket(spark, d):
    a = view(spark, d, "approvals").select("approval_id", "parcel_id", "status", "requested_at")
    p = listed(spark, d).select("parcel_id", "khasra_no", "owner_name", "ulpin", "alignment_confidence")
    return a.join(p, "parcel_id")


@query("p4_docket_filter", _sql_list(DOCKET, """
SELECT 'PENDING' AS klass, approval_id FROM docket WHERE status = 'pending' AND (lower(khasra_no) LIKE '%1%' OR lower(owner_name) LIKE '%1%' OR coalesce(lower(ulpin) LIKE '%1%', FALSE))
UNION ALL SELECT 'OCCLUDED', approval_id FROM docket WHERE coalesce(alignment_confidence, 1e0) < 0.8e0""", views=["approvals"]))
def p4(spark, d):
    k = docket(spark, d).withColumn("is_approved", F.col("status") == "approved")
    one = RL.docket_filter(k, "1", "PENDING").select(F.lit("PENDING").alias("klass"), "approval_id")
    return one.unionByName(RL.docket_filter(k, "", "OCCLUDED").select(F.lit("OCCLUDED").alias("klass"), "approval_id"))


@query("p5_issue_filter", _sql_list("""
SELECT 'ALIGNED' AS klass, parcel_id FROM listed WHERE alignment_status IN ('PUBLISHED', 'ALIGNED_DRAFT', 'TOPOLOGY_CLEANED')
UNION ALL SELECT 'ISSUES', parcel_id FROM listed WHERE alignment_status IN ('OCCLUDED', 'DRAFT')"""))
def p5(spark, d):
    p = listed(spark, d)
    return RL.issue_filter(p, "ALIGNED").select(F.lit("ALIGNED").alias("klass"), "parcel_id").unionByName(
        RL.issue_filter(p, "ISSUES").select(F.lit("ISSUES").alias("klass"), "parcel_id"))


OLD_STATUS = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'raw' WHEN 'BUILDING' THEN 'aligned' WHEN 'FURNITURE' THEN 'cleaned' WHEN 'HOUSEHOLD' THEN 'ulpin_assigned' ELSE 'PUBLISHED' END"""


def _old_status(spark, d):
    return load(spark, d, "customer")["customer"].select(F.col("c_custkey").alias("parcel_id"), F.expr(OLD_STATUS).alias("old"))


@query("p6_normalize_status", """SELECT c_custkey AS parcel_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'DRAFT' WHEN 'BUILDING' THEN 'ALIGNED_DRAFT'
  WHEN 'FURNITURE' THEN 'TOPOLOGY_CLEANED' WHEN 'HOUSEHOLD' THEN 'ULPIN_ASSIGNED' ELSE 'PUBLISHED' END AS alignment_status FROM customer""")
def p6(spark, d):
    return _old_status(spark, d).select("parcel_id", ST.normalize_status(F.col("old")).alias("alignment_status"))


@query("p7_status_label", """SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 6 = 0 THEN 'Draft' ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Draft'
  WHEN 'BUILDING' THEN 'Aligned Candidate' WHEN 'FURNITURE' THEN 'Topology Cleaned' WHEN 'HOUSEHOLD' THEN 'Bhu-Aadhaar Assigned' ELSE 'Legally Published' END END AS label FROM customer""")
def p7(spark, d):
    s = F.when(F.col("parcel_id") % 6 != 0, F.col("old"))
    return _old_status(spark, d).select("parcel_id", ST.status_label(s).alias("label"))


@query("p8_status_badge", with_views("""SELECT sheet_id, plot_no, CASE WHEN n_vertices = 6 THEN 'Submitted' WHEN status_color = 'red' OR confidence_score < 60 THEN 'GOVT_ILLEGAL'
  WHEN status_color = 'orange' OR confidence_score < 85 THEN 'OCCLUDED' ELSE 'VERIFIED_CLEAR' END AS badge FROM plots""", "plots"))
def p8(spark, d):
    p = view(spark, d, "plots")
    return p.select("sheet_id", "plot_no", ST.status_badge(
        F.when(F.col("n_vertices") == 6, "PENDING_APPROVAL"), F.col("status_color"), S.band(F.col("confidence_score")), F.lit(None).cast("string")).alias("badge"))


@query("p9_validate_officers", """
WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' 2') ELSE p_name END AS officer_name,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 10, '9') END AS phone_number,
  CASE p_partkey % 4 WHEN 0 THEN 'Patwari' WHEN 1 THEN 'Tehsildar' WHEN 2 THEN 'Naib Tehsildar' ELSE 'Clerk' END AS designation,
  CASE WHEN p_partkey % 11 = 0 THEN 'X' ELSE p_brand END AS jurisdiction_ward FROM part),
f AS (SELECT *, CAST(NOT regexp_full_match(officer_name, '[A-Za-z\\s]{2,100}') AS INT) AS e1, CAST(NOT regexp_full_match(phone_number, '[0-9]{10}') AS INT) AS e2,
  CAST(designation = 'Clerk' AS INT) AS e3, CAST(length(jurisdiction_ward) < 2 AS INT) AS e4 FROM o)
SELECT id, CAST(e1 + e2 + e3 + e4 AS INT) AS n_reasons, CASE WHEN e1 + e2 + e3 + e4 = 0 THEN concat('REV-', upper(substr(designation, 1, 3)), '-', right(phone_number, 4)) END AS officer_id FROM f""")
def p9(spark, d):
    p, i = load(spark, d, "part")["part"], F.col("p_partkey")
    rows = p.select(
        i.alias("id"), F.when(i % 5 == 0, F.concat("p_name", F.lit(" 2"))).otherwise(F.col("p_name")).alias("officer_name"),
        F.when(i % 3 == 0, i.cast("string")).otherwise(F.lpad(i.cast("string"), 10, "9")).alias("phone_number"),
        F.when(i % 4 == 0, "Patwari").when(i % 4 == 1, "Tehsildar").when(i % 4 == 2, "Naib Tehsildar").otherwise("Clerk").alias("designation"),
        F.when(i % 11 == 0, "X").otherwise(F.col("p_brand")).alias("jurisdiction_ward"))
    return VA.validate_officers(rows).select("id", F.size("reasons").alias("n_reasons"), "officer_id")


def registrations(spark, d):
    i = F.col("parcel_id")
    return parcels(spark, d).select(
        "parcel_id", F.when(i % 9 == 0, F.concat("khasra_no", F.lit("a"))).otherwise(F.col("khasra_no")).alias("khasra_no"),
        F.when(i % 2 == 0, F.translate("village", "_0123456789", " abcdefghij")).otherwise(F.col("owner_name")).alias("owner_name"),
        F.lpad(i.cast("string"), 10, "9").alias("owner_phone"), "village", "tehsil", "district", "rings")


REGISTRATIONS = """reg AS (SELECT parcel_id, CASE WHEN parcel_id % 9 = 0 THEN concat(khasra_no, 'a') ELSE khasra_no END AS khasra_no,
  CASE WHEN parcel_id % 2 = 0 THEN translate(village, '_0123456789', ' abcdefghij') ELSE owner_name END AS owner_name, village, tehsil, x0, y0, x1, y1 FROM parcels)"""


@query("p10_validate_registrations", with_views("WITH " + REGISTRATIONS + """
SELECT parcel_id, regexp_full_match(khasra_no, '[0-9]+(/[0-9]+)?') AND regexp_full_match(owner_name, '[A-Za-z\\s]{2,100}') AS valid FROM reg""", "parcels"))
def p10(spark, d):
    return VA.validate_registrations(registrations(spark, d)).select("parcel_id", (F.size("reasons") == 0).alias("valid"))


@query("p12_validate_bounds", with_views("""SELECT plot_no, sheet_id, CAST((CASE WHEN NOT x < x + bw - 40 THEN 1 ELSE 0 END) + (CASE WHEN NOT y < y + bh - 30 THEN 1 ELSE 0 END) AS INT) AS n_reasons FROM plots""", "plots"))
def p12(spark, d):
    p = view(spark, d, "plots").select("sheet_id", "plot_no", F.col("x").alias("min_lon"), F.col("y").alias("min_lat"),
                                       (F.col("x") + F.col("bw") - 40).alias("max_lon"), (F.col("y") + F.col("bh") - 30).alias("max_lat"))
    return VA.validate_bounds(p).select("plot_no", "sheet_id", F.size("reasons").alias("n_reasons"))


@query("p13_select_batch", with_views("SELECT parcel_id, khasra_no FROM parcels WHERE village = 'NATION_3' AND alignment_status = 'DRAFT' ORDER BY parcel_id LIMIT 50", "parcels"))
def p13(spark, d):
    return RL.select_batch(view(spark, d, "parcels"), "NATION_3").select("parcel_id", "khasra_no")


@query("p14_role_gate", """
WITH e AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'clerk' WHEN user_id % 2 = 0 THEN 'Patwari' ELSE 'tehsildar ' END AS role,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'PATWARI' ELSE 'tehsildar' END AS header_role,
  CASE WHEN event_type = 'purchase' THEN 'approved' ELSE event_type END AS action FROM events)
SELECT event_id, trim(lower(role)) IN ('patwari', 'tehsildar') AND (header_role IS NULL OR lower(header_role) = trim(lower(role)))
  AND (action <> 'approved' OR NOT coalesce(lower(header_role) = 'patwari', FALSE)) AS allowed FROM e""")
def p14(spark, d):
    e, u, i = load(spark, d, "events")["events"], F.col("user_id"), F.col("event_id")
    rows = e.select("event_id", F.when(u % 7 == 0, "clerk").when(u % 2 == 0, "Patwari").otherwise("tehsildar ").alias("role"),
                    F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, "PATWARI").otherwise("tehsildar").alias("header_role"),
                    F.when(F.col("event_type") == "purchase", "approved").otherwise(F.col("event_type")).alias("action"))
    return VA.role_gate(rows).select("event_id", (F.size("reasons") == 0).alias("allowed"))


def sheets(spark, d):
    return load(spark, d, "supplier")["supplier"].select(
        F.col("s_suppkey").alias("sheet_id"), F.lit(1200.0).alias("width"), (F.lit(880.0) + F.col("s_suppkey") % 40).alias("height"))


SHEETS = "sheets AS (SELECT s_suppkey AS sheet_id, 12e2 AS width, 88e1 + s_suppkey % 40 AS height FROM supplier)"


@query("p15_filter_candidate_plots", with_views("WITH " + SHEETS + """
SELECT p.sheet_id, p.plot_no FROM plots p JOIN sheets s ON p.sheet_id = s.sheet_id
WHERE area_px > 0.002e0 * width * height AND area_px < 0.38e0 * width * height AND n_vertices >= 3
  AND NOT ((bw / greatest(1, bh) > 4 OR bh / greatest(1, bw) > 4) AND (y < 0.15e0 * height OR y > 0.85e0 * height))""", "plots"))
def p15(spark, d):
    return VA.filter_candidate_plots(view(spark, d, "plots"), sheets(spark, d)).select("sheet_id", "plot_no")


@query("p16_review_flag", with_views("""SELECT sheet_id, plot_no, (status_color = 'red' OR confidence_score < 80) AS hitl_review, confidence_score < 85 AS manual_review,
  confidence_score < 70 AS assisted FROM plots""", "plots"))
def p16(spark, d):
    s = F.col("confidence_score")
    return view(spark, d, "plots").select("sheet_id", "plot_no", S.review_required(F.col("status_color") == "red", s).alias("hitl_review"),
                                          S.needs_manual_review(S.band(s)).alias("manual_review"), S.needs_assisted(s).alias("assisted"))


# ---- key joins -----------------------------------------------------------------------------------

@query("j1_pending_approvals", with_views("""SELECT a.approval_id, a.parcel_id, a.requested_by, a.status, a.requested_at, p.khasra_no, p.owner_name, p.village
  FROM approvals a JOIN parcels p ON a.parcel_id = p.parcel_id WHERE a.status IN ('pending', 'approved')""", "parcels", "approvals"))
def j1(spark, d):
    return RL.pending_approvals(view(spark, d, "approvals"), view(spark, d, "parcels")).select(
        "approval_id", "parcel_id", "requested_by", "status", "requested_at", "khasra_no", "owner_name", "village")


REGISTER = "register AS (SELECT khasra_no, CASE WHEN parcel_id % 13 = 0 THEN 'RED' ELSE 'AMBER' END AS band FROM parcels WHERE parcel_id % 13 = 0 OR parcel_id % 11 = 0)"


def register(spark, d):
    i = F.col("parcel_id")
    return view(spark, d, "parcels").filter((i % 13 == 0) | (i % 11 == 0)).select(
        "khasra_no", F.when(i % 13 == 0, "RED").otherwise("AMBER").alias("band"))


@query("j6_risk_register_join", with_views("WITH " + REGISTER + """, r AS (SELECT khasra_no, max(band) AS band FROM register GROUP BY khasra_no)
SELECT p.parcel_id, coalesce(r.band, 'GREEN') AS register_band, CASE r.band WHEN 'RED' THEN 'Govt. Land / Encroachment - State Property Verification Required'
  WHEN 'AMBER' THEN 'Tree Occultation / Canopy Shadow - High Ground Discrepancy' ELSE 'Verified Clear - Undisputed Legal Cadastral Parcel' END AS reason
FROM parcels p LEFT JOIN r ON p.khasra_no = r.khasra_no""", "parcels"))
def j6(spark, d):
    p = view(spark, d, "parcels").withColumn("khasra_no", F.concat(F.lit("Kh."), "khasra_no"))
    return RL.risk_register_join(p, register(spark, d)).select("parcel_id", "register_band", "reason")


LOCAL = "local AS (SELECT parcel_id, khasra_no, concat(tehsil, ' L') AS tehsil, round(alignment_confidence + 1, 6) AS area_sqm FROM listed WHERE parcel_id % 3 = 0)"


def local(spark, d):
    return listed(spark, d).filter("parcel_id % 3 = 0").select(
        "parcel_id", "khasra_no", F.concat("tehsil", F.lit(" L")).alias("tehsil"), F.round(F.col("alignment_confidence") + 1, 6).alias("area_sqm"))


@query("j9_enrich_with_local", _sql_list(LOCAL, """
SELECT r.parcel_id, coalesce(nullif(CASE WHEN r.parcel_id % 2 = 0 THEN '' ELSE r.tehsil END, ''), l.tehsil, '') AS tehsil,
  coalesce(CASE WHEN r.area_sqm <> 0 THEN r.area_sqm END, l.area_sqm, 0e0) AS area_sqm
FROM listed r LEFT JOIN local l ON r.khasra_no = l.khasra_no"""))
def j9(spark, d):
    remote = listed(spark, d).withColumn("tehsil", F.when(F.col("parcel_id") % 2 == 0, "").otherwise(F.col("tehsil")))
    return RL.enrich_with_local(remote, local(spark, d), {"tehsil": "", "area_sqm": 0.0}).select("parcel_id", "tehsil", "area_sqm")


@query("j10_merge_prefer_local", _sql_list(LOCAL, """
SELECT parcel_id, khasra_no, tehsil, area_sqm, CAST(NULL AS VARCHAR) AS village FROM local
UNION ALL SELECT parcel_id, khasra_no, tehsil, area_sqm, village FROM listed WHERE khasra_no NOT IN (SELECT khasra_no FROM local)"""))
def j10(spark, d):
    return RL.merge_prefer_local(local(spark, d), listed(spark, d).select("parcel_id", "khasra_no", "tehsil", "area_sqm", "village"))


APPROVED_IDS = """ids AS (SELECT CAST(parcel_id AS VARCHAR) AS id FROM approvals WHERE parcel_id % 50 = 0 UNION SELECT CAST(approval_id AS VARCHAR) FROM approvals WHERE approval_id % 97 = 0
  UNION SELECT khasra_no FROM parcels WHERE parcel_id % 77 = 0)"""


@query("j11_mark_approved", _sql_list(DOCKET, APPROVED_IDS, """
SELECT approval_id, status = 'approved' OR CAST(parcel_id AS VARCHAR) IN (SELECT id FROM ids) OR CAST(approval_id AS VARCHAR) IN (SELECT id FROM ids) OR khasra_no IN (SELECT id FROM ids) AS is_approved
FROM docket""", views=["approvals"]))
def j11(spark, d):
    a, p = view(spark, d, "approvals"), view(spark, d, "parcels")
    ids = (a.filter("parcel_id % 50 = 0").select(F.col("parcel_id").cast("string").alias("id"))
           .union(a.filter("approval_id % 97 = 0").select(F.col("approval_id").cast("string")))
           .union(p.filter("parcel_id % 77 = 0").select("khasra_no")))
    return RL.mark_approved(docket(spark, d), ids).select("approval_id", "is_approved")


REQUESTS = """requests AS (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) WHEN event_id % 3 = 1 THEN concat('par-', CAST(100 + user_id AS STRING), '-x') END AS parcel_ref,
  CASE WHEN event_id % 3 = 2 THEN CAST(100 + user_id + event_id % 7 * 100000 AS STRING) END AS khasra_no, CASE WHEN event_id % 2 = 0 THEN concat('NATION_', CAST(user_id % 25 AS STRING)) END AS village,
  ts AS requested_at, concat('patwari_', CAST(user_id % 9 AS STRING)) AS requested_by, CASE WHEN event_id % 4 = 0 THEN 0e0 ELSE value END AS area_sqm FROM {events})"""


def requests(spark, d):
    sql = REQUESTS[len("requests AS ("):-1]
    return spark.sql(sql, **load(spark, d, "events"))


RESOLVED = """resolved AS (SELECT r.*, coalesce(p1.parcel_id, p2.pid, p3.pid, p4.pid) AS resolved_id FROM requests r
 LEFT JOIN parcels p1 ON r.parcel_ref = CAST(p1.parcel_id AS VARCHAR)
 LEFT JOIN (SELECT khasra_no, village, min(parcel_id) AS pid FROM parcels GROUP BY ALL) p2 ON r.khasra_no = p2.khasra_no AND r.village = p2.village
 LEFT JOIN (SELECT khasra_no, min(parcel_id) AS pid FROM parcels GROUP BY ALL) p3 ON r.khasra_no = p3.khasra_no AND r.village IS NULL
 LEFT JOIN (SELECT khasra_no, min(parcel_id) AS pid FROM parcels GROUP BY ALL) p4 ON split_part(replace(replace(r.parcel_ref, 'par-', ''), 'preview-', ''), '-', 1) = p4.khasra_no)"""


@query("j12_resolve_parcel", with_views("WITH " + REQUESTS.format(events="events") + ", " + RESOLVED + " SELECT request_id, resolved_id FROM resolved", "parcels"))
def j12(spark, d):
    return RL.resolve_parcel(requests(spark, d), view(spark, d, "parcels")).select("request_id", "resolved_id")


# ---- aggregates ----------------------------------------------------------------------------------

STATS = """SELECT (SELECT count(*) FROM parcels) AS total_parcels, (SELECT count(*) FROM parcels WHERE alignment_status = 'DRAFT') AS raw_count,
 (SELECT count(*) FROM parcels WHERE alignment_status = 'ALIGNED_DRAFT') AS aligned_count, (SELECT count(*) FROM parcels WHERE alignment_status = 'TOPOLOGY_CLEANED') AS cleaned_count,
 (SELECT count(*) FROM parcels WHERE alignment_status = 'ULPIN_ASSIGNED') AS ulpin_assigned_count, (SELECT count(*) FROM parcels WHERE alignment_status = 'PUBLISHED') AS published_count,
 (SELECT count(*) FROM approvals WHERE status = 'pending') AS pending_approvals, (SELECT count(*) FROM approvals WHERE status = 'approved') AS approved_count,
 (SELECT count(*) FROM approvals WHERE status = 'rejected') AS rejected_count"""


@query("a1_dashboard_stats", with_views(STATS, "parcels", "approvals"))
def a1(spark, d):
    return A.dashboard_stats(view(spark, d, "parcels"), view(spark, d, "approvals"))


@query("a2_status_breakdown", with_views("WITH s AS (" + STATS + """) SELECT 'Approved / Published' AS name, published_count AS value FROM s UNION ALL
 SELECT 'AI-Drafted / Pending', aligned_count + pending_approvals FROM s UNION ALL SELECT 'Flagged (GCP Required)', raw_count FROM s""", "parcels", "approvals"))
def a2(spark, d):
    return A.status_breakdown(a1(spark, d))


def scored_plots(spark, d):
    return view(spark, d, "plots").withColumn("confidence_band", S.band(F.col("confidence_score")))


SCORED = "scored AS (SELECT *, CASE WHEN confidence_score >= 85 THEN 'GREEN' WHEN confidence_score >= 60 THEN 'AMBER' ELSE 'RED' END AS confidence_band FROM plots)"


@query("a3_band_counts", with_views("WITH " + SCORED + """
SELECT sheet_id, count(*) FILTER (status_color = 'green' OR confidence_band = 'GREEN') AS green, count(*) FILTER (status_color IN ('amber', 'orange') OR confidence_band = 'AMBER') AS amber,
 count(*) FILTER (status_color = 'red' OR confidence_band = 'RED') AS red FROM scored GROUP BY sheet_id""", "plots"))
def a3(spark, d):
    return A.band_counts(scored_plots(spark, d), "sheet_id")


@query("a4_sheet_area_totals", with_views("SELECT sheet_id, round(sum(area_sqm), 2) AS total_area_sqm, round(sum(area_sqm * 10.7639e0), 2) AS total_area_sqft FROM plots GROUP BY sheet_id", "plots"))
def a4(spark, d):
    return A.sheet_area_totals(view(spark, d, "plots"), "sheet_id").select(
        "sheet_id", F.round("total_area_sqm", 2).alias("total_area_sqm"), F.round("total_area_sqft", 2).alias("total_area_sqft"))


@query("a5_flag_rate", with_views("WITH " + SCORED + """
SELECT sheet_id, round((1e0 - CAST(count(*) FILTER (confidence_band = 'RED') AS DOUBLE) / greatest(1, count(*))) * 1e2, 1) AS matched_boundary_pct,
 count(*) FILTER (confidence_band = 'RED') AS discrepancy_count FROM scored GROUP BY sheet_id""", "plots"))
def a5(spark, d):
    return A.flag_rate(scored_plots(spark, d), "sheet_id")


@query("a6_overall_confidence", with_views("""WITH s AS (SELECT sheet_id, round(coalesce(avg(confidence_score), 88e0), 1) AS overall_confidence FROM plots GROUP BY sheet_id)
SELECT *, CASE WHEN overall_confidence >= 85 THEN 'GREEN' WHEN overall_confidence >= 60 THEN 'AMBER' ELSE 'RED' END AS confidence_band FROM s""", "plots"))
def a6(spark, d):
    return A.overall_confidence(view(spark, d, "plots"), "sheet_id")


@query("a7_layer_bbox", with_views("""SELECT village, round(min(x0) - 0.08e0 * (max(x1) - min(x0)), 9) AS min_x, round(max(x1) + 0.08e0 * (max(x1) - min(x0)), 9) AS max_x,
 round(min(y0) - 0.08e0 * (max(y1) - min(y0)), 9) AS min_y, round(max(y1) + 0.08e0 * (max(y1) - min(y0)), 9) AS max_y FROM parcels GROUP BY village""", "parcels"))
def a7(spark, d):
    return A.layer_bbox(parcels(spark, d), "village").select("village", *[F.round(c, 9).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("a8_reprojection_rmse", with_views("""
WITH r AS (SELECT sheet_id, 1.02e0 * sx - 3e-2 * sy + 12e0 AS px, 3e-2 * sx + 98e-2 * sy - 7e0 AS py, tx, ty FROM gcps),
e AS (SELECT sheet_id, (px - tx) * (px - tx) + (py - ty) * (py - ty) AS e2 FROM r)
SELECT sheet_id, round(coalesce(sqrt(avg(e2) FILTER (e2 < 6.4e-3)), 999e0), 8) AS rmse_px, count(*) FILTER (e2 < 6.4e-3) AS inliers, count(*) AS matches FROM e GROUP BY sheet_id""", "gcps"))
def a8(spark, d):
    return A.reprojection_rmse(residuals(spark, d), "sheet_id").select("sheet_id", F.round("rmse_px", 8).alias("rmse_px"), "inliers", "matches")


def residuals(spark, d):
    g = view(spark, d, "gcps").select("sheet_id", (1.02 * F.col("sx") - 3e-2 * F.col("sy") + 12.0).alias("px"),
                                      (3e-2 * F.col("sx") + 98e-2 * F.col("sy") - 7.0).alias("py"), "tx", "ty")
    ex, ey = F.col("px") - F.col("tx"), F.col("py") - F.col("ty")
    return g.withColumn("is_inlier", ex * ex + ey * ey < 6.4e-3)


@query("a8_displacement_rmse", with_views("SELECT round(sqrt(avg((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy))), 6) AS rmse FROM gcps", "gcps"))
def a8b(spark, d):
    return A.displacement_rmse(view(spark, d, "gcps")).select(F.round("rmse", 6).alias("rmse"))


@query("a9_inlier_ratio", with_views("""
WITH r AS (SELECT sheet_id, 1.02e0 * sx - 3e-2 * sy + 12e0 AS px, 3e-2 * sx + 98e-2 * sy - 7e0 AS py, tx, ty FROM gcps)
SELECT sheet_id, round(CAST(count(*) FILTER ((px - tx) * (px - tx) + (py - ty) * (py - ty) < 6.4e-3) AS DOUBLE) / greatest(1, count(*)), 6) AS inlier_ratio FROM r GROUP BY sheet_id""", "gcps"))
def a9(spark, d):
    return A.inlier_ratio(residuals(spark, d), "sheet_id").select("sheet_id", F.round("inlier_ratio", 6).alias("inlier_ratio"))


@query("a12_ulpin_collisions", _sql_list("SELECT ulpin, count(*) AS n_parcels FROM listed WHERE ulpin IS NOT NULL GROUP BY ulpin HAVING count(*) > 1"))
def a12(spark, d):
    return A.ulpin_collisions(listed(spark, d))


@query("a13_layer_quality", _sql_list("""
SELECT (SELECT count(*) FROM listed) AS total, CAST(0 AS BIGINT) AS empty_geometry, (SELECT count(*) FROM listed WHERE ulpin IS NULL OR owner_name = '') AS missing_required,
 (SELECT count(*) FROM listed WHERE alignment_status IN ('DRAFT', 'ALIGNED_DRAFT', 'TOPOLOGY_CLEANED', 'ULPIN_ASSIGNED', 'PUBLISHED')) AS known_status,
 (SELECT count(*) FROM approvals WHERE parcel_id NOT IN (SELECT parcel_id FROM listed)) AS orphan_approvals, TRUE AS status_identity""", views=["approvals"]))
def a13(spark, d):
    p = listed(spark, d).join(parcels(spark, d).select("parcel_id", "rings"), "parcel_id")
    return A.layer_quality(p, view(spark, d, "approvals"), ["owner_name", "ulpin"])


def job_events(spark, d):
    e = view(spark, d, "survey_events")
    fail = F.col("action") == "FAIL"
    return e.select("batch_id", "ts", "event_id", (~fail).alias("success"),
                    F.when(fail, F.concat(F.lit("parcel "), F.col("parcel_id").cast("string"), F.lit(" failed at "), F.col("event_id").cast("string"))).alias("error"))


def job_totals(spark, d):
    e = view(spark, d, "survey_events")
    return e.groupBy("batch_id").agg((F.count("*") + F.col("batch_id") % 2).alias("total"))


TOTALS = "totals AS (SELECT batch_id, count(*) + batch_id % 2 AS total FROM survey_events GROUP BY batch_id)"


@query("a17_batch_progress", with_views("WITH " + TOTALS + """, c AS (SELECT batch_id, count(*) FILTER (action <> 'FAIL') AS completed, count(*) FILTER (action = 'FAIL') AS failed FROM survey_events GROUP BY batch_id),
x AS (SELECT batch_id, string_agg(error, '|' ORDER BY ts, event_id) AS errors FROM (SELECT batch_id, ts, event_id, concat('parcel ', CAST(parcel_id AS VARCHAR), ' failed at ', CAST(event_id AS VARCHAR)) AS error,
   row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, event_id DESC) AS rn FROM survey_events WHERE action = 'FAIL') WHERE rn <= 10 GROUP BY batch_id)
SELECT t.batch_id, t.total, c.completed, c.failed, x.errors, CASE WHEN completed + failed >= total AND total > 0 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status
FROM totals t JOIN c ON t.batch_id = c.batch_id JOIN x ON t.batch_id = x.batch_id""", "survey_events"))
def a17(spark, d):
    return A.batch_progress(job_events(spark, d), job_totals(spark, d)).select(
        "batch_id", "total", "completed", "failed", F.array_join("errors", "|").alias("errors"), "status")


@query("a18_weekly_timeline", with_views("""SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week,
 count(*) FILTER (action = 'DRAFT_PUT') AS ai_drafted, count(*) FILTER (action = 'APPROVE') AS officer_approved FROM survey_events GROUP BY 1""", "survey_events"))
def a18(spark, d):
    return A.weekly_timeline(view(spark, d, "survey_events"))


# ---- orderings and sets --------------------------------------------------------------------------

@query("t1_sort_by_khasra", with_views("SELECT parcel_id, khasra_no FROM parcels ORDER BY khasra_no, parcel_id", "parcels"))
def t1(spark, d):
    return RL.sort_by_khasra(view(spark, d, "parcels").select("parcel_id", "khasra_no"))


@query("t2_newest_first", with_views("SELECT approval_id, requested_at FROM approvals ORDER BY requested_at DESC, approval_id", "approvals"))
def t2(spark, d):
    return RL.newest_first(view(spark, d, "approvals").select("approval_id", "requested_at"))


@query("t3_limit", with_views("SELECT approval_id, requested_at FROM approvals ORDER BY requested_at DESC, approval_id LIMIT 50", "approvals"))
def t3(spark, d):
    return RL.limit_n(view(spark, d, "approvals").select("approval_id", "requested_at"), 50, F.col("requested_at").desc(), F.col("approval_id"))


@query("t4_top1_by", with_views("SELECT sheet_id, plot_no AS value FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY area_px DESC, plot_no) AS rn FROM plots) WHERE rn = 1", "plots"))
def t4(spark, d):
    return RL.top1_by(view(spark, d, "plots"), ["sheet_id"], F.col("plot_no"), -F.col("area_px"), F.col("plot_no"))


@query("t5_last_n", with_views("""SELECT batch_id, event_id FROM (SELECT batch_id, event_id, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, event_id DESC) AS rn FROM survey_events) WHERE rn <= 10""", "survey_events"))
def t5(spark, d):
    return A.last_n(view(spark, d, "survey_events"), ["batch_id"], ["ts", "event_id"]).select("batch_id", "event_id")


@query("u1_union_precedence", _sql_list(LOCAL, """
SELECT khasra_no, count(*) AS n, count(village) AS n_remote FROM (SELECT khasra_no, CAST(NULL AS VARCHAR) AS village FROM local
UNION ALL SELECT khasra_no, village FROM listed WHERE khasra_no NOT IN (SELECT khasra_no FROM local)) GROUP BY khasra_no"""))
def u1(spark, d):
    merged = RL.union_precedence(local(spark, d), listed(spark, d).select("parcel_id", "khasra_no", "village"))
    return merged.groupBy("khasra_no").agg(F.count("*").alias("n"), F.count("village").alias("n_remote"))


@query("u2_distinct_keys", with_views("SELECT DISTINCT village FROM parcels", "parcels"))
def u2(spark, d):
    return RL.distinct_keys(view(spark, d, "parcels"), "village")
