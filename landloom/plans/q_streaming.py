"""Streams over the event table, run to the end of what is there, against the batch answer in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import run_dir
from ..streaming import jobs as J
from .q_relational import TOTALS, job_totals
from .q_sources import layer_documents
from .registry import query
from .views import VIEW_SQL, load, view, with_views


def event_stream(spark, d):
    """The event file as a stream, in the shape of the survey_events view."""
    schema = load(spark, d, "events")["events"].schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")
    return spark.sql(VIEW_SQL["survey_events"], events=raw)


def shuffled_stream(spark, d, files: int = 6):
    """The events in files that are not in time order, one file a micro-batch."""
    folder = run_dir(spark, "events")
    events = load(spark, d, "events")["events"]
    events.repartition(files, F.xxhash64("event_id")).write.parquet(folder)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return spark.sql(VIEW_SQL["survey_events"], events=raw)


DRAFTS = """lst AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts DESC, event_id DESC) AS rn FROM survey_events WHERE action IN ('DRAFT_PUT', 'DRAFT_DISCARD'))"""
DRAFT_SQL = with_views("WITH " + DRAFTS + " SELECT parcel_id, event_id, value FROM lst WHERE rn = 1 AND action = 'DRAFT_PUT' AND ts + INTERVAL 24 HOURS >= (SELECT max(ts) FROM survey_events)", "survey_events")


@query("x1_draft_state_stream", DRAFT_SQL)
def x1(spark, d):
    return J.run_draft_state(event_stream(spark, d), view(spark, d, "survey_events")).select("parcel_id", "event_id", "value")


@query("x1_draft_state_batch", DRAFT_SQL)
def x1b(spark, d):
    return J.draft_state(view(spark, d, "survey_events")).select("parcel_id", "event_id", "value")


@query("x2_progress_stream", with_views("WITH " + TOTALS + """, c AS (SELECT batch_id, count(*) FILTER (action <> 'FAIL') AS completed, count(*) FILTER (action = 'FAIL') AS failed FROM survey_events GROUP BY batch_id)
SELECT t.batch_id, t.total, completed, failed, CASE WHEN completed + failed >= total AND total > 0 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status FROM totals t JOIN c ON t.batch_id = c.batch_id""", "survey_events"))
def x2(spark, d):
    e = event_stream(spark, d).withColumn("success", F.col("action") != "FAIL")
    return J.run_progress(e, job_totals(spark, d)).drop("updated_at")


@query("x3_approval_stream", with_views("""WITH e AS (SELECT * FROM survey_events WHERE parcel_id IN (SELECT parcel_id FROM parcels)),
s AS (SELECT parcel_id, min((ts, event_id)) AS k FROM e WHERE action = 'SUBMIT' GROUP BY parcel_id),
a AS (SELECT e.parcel_id, min((e.ts, e.event_id)) AS k FROM e JOIN s ON e.parcel_id = s.parcel_id WHERE action = 'APPROVE' AND (e.ts, e.event_id) > s.k GROUP BY e.parcel_id)
SELECT s.parcel_id, s.k[2] AS submitted_id, a.k[2] AS action_id FROM s LEFT JOIN a ON s.parcel_id = a.parcel_id""", "survey_events", "parcels"))
def x3(spark, d):
    return J.run_approvals(shuffled_stream(spark, d), view(spark, d, "parcels")).select("parcel_id", "submitted_id", "action_id")


@query("x4_audit_append", with_views("""SELECT event_id, sha256(concat_ws(':', CAST(parcel_id AS VARCHAR), action, CAST(epoch_us(ts) AS VARCHAR), CAST(event_id AS VARCHAR))) AS digital_signature FROM survey_events WHERE action IN ('SUBMIT', 'APPROVE', 'DRAFT_DISCARD')""", "survey_events"))
def x4(spark, d):
    # Every event arrives twice; the ledger keeps one.
    twice = shuffled_stream(spark, d).withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_n")
    return J.run_audit(twice).select("event_id", "digital_signature")


@query("x5_weekly_timeline_stream", with_views("""SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week,
 count(*) FILTER (action = 'DRAFT_PUT') AS ai_drafted, count(*) FILTER (action = 'APPROVE') AS officer_approved FROM survey_events GROUP BY 1""", "survey_events"))
def x5(spark, d):
    t = J.run_timeline(shuffled_stream(spark, d))
    return t.select(F.floor(F.datediff(F.to_date("week_start"), F.lit("2024-01-01").cast("date")) / 7).cast("bigint").alias("week"), "ai_drafted", "officer_approved")


@query("x6_layer_ingest_stream", with_views("""SELECT CAST(floor(parcel_id / 50) AS BIGINT) AS first_id, count(*) AS n_plots FROM parcels WHERE parcel_id % 25 <> 24 GROUP BY 1""", "parcels"))
def x6(spark, d):
    # One document per file, named by Spark; each file's parcels tell which sheet it was.
    folder = run_dir(spark, "incoming")
    layer_documents(spark, d).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    files, plots = J.ingest_layers(J.layer_stream(spark, folder))
    good = files.select("path")
    owner = F.regexp_extract(F.col("legacy_props")["owner_name"], r"(\d+)\z", 1).cast("bigint")
    return plots.join(good, "path", "left_semi").groupBy("path").agg(F.count("*").alias("n_plots"), F.min(owner).alias("o")).select(
        F.floor(F.col("o") / 50).alias("first_id"), "n_plots")
