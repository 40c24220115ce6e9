"""Streaming jobs over survey events, with batch twins that give the same final tables."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import run_dir
from ..sources.readers import parse_geojson, profile_documents

# Fixed value: a draft lives 24 hours.
DRAFT_TTL_HOURS = 24
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str, write, name: str) -> list:
    """Run a stream over everything that is there now and stop; gives the progress of its batches. ``write(df, batch_id)``
    must be idempotent per batch, since a batch is replayed after a failure."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
             .option("checkpointLocation", run_dir(spark, f"{name}-checkpoint")).start())
        q.awaitTermination()
        return q.recentProgress
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run to the end and read back what was emitted, with ``batch_no`` telling the order. Each batch
    owns one folder and overwrites it on replay."""
    spark = stream.sparkSession
    out = run_dir(spark, name)
    schema = stream.schema

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_no={batch}")

    run_available(stream, mode, write, name)
    return spark.read.schema(schema.add("batch_no", "long")).option("basePath", out).parquet(out)


# ---- drafts --------------------------------------------------------------------------------------

class DraftProcessor(StatefulProcessor):
    """Keeps the live draft of a key, one row a key, until an event-time timer says that it is over 24 hours old.

    The watermark trails the newest event by the life of a draft, so whatever it has passed has expired. The timer of a key
    stands just after its newest event; when it fires all that is known of the key goes, and a live draft is reported as
    ended. Events that come for such a key later and are older still lie behind the watermark and are dropped by Spark;
    they could only name drafts that have expired too. Nothing depends on processing time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "event_id bigint, ts timestamp, ms bigint, value double, live boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # One running best at a time: the group is never held together.
        best = None
        for pdf in rows:
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if best is None or (top["ts"], top["event_id"]) > (best["ts"], best["event_id"]):
                best = top
        if best is None:
            return
        last = self.newest.get() if self.newest.exists() else None
        if last is not None:
            if (best["ts"], int(best["event_id"])) <= (pd.Timestamp(last[1]), last[0]):
                return
            self.handle.deleteTimer(last[2] + 1)
        live = best["action"] == "DRAFT_PUT"
        value = float(best["value"]) if live and pd.notna(best["value"]) else None
        ms = int(best["ms"])
        self.newest.update((int(best["event_id"]), best["ts"].to_pydatetime(), ms, value, live))
        self.handle.registerTimer(ms + 1)
        yield _draft_row(key, best["event_id"], best["ts"], value, live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.newest.get() if self.newest.exists() else None
        if last is None or last[2] >= expiredTimerInfo.getExpiryTimeInMs():
            return
        self.newest.clear()
        if last[4]:
            yield _draft_row(key, last[0], pd.Timestamp(last[1]), None, False)

    def close(self) -> None:
        pass


def _draft_row(key, event_id, ts, value, live) -> pd.DataFrame:
    return pd.DataFrame({"parcel_id": [key[0]], "event_id": [int(event_id)], "ts": [ts], "value": [value], "live": [bool(live)]})


DRAFT_OUT = "parcel_id bigint, event_id bigint, ts timestamp, value double, live boolean"


def _draft_events(events: DataFrame) -> DataFrame:
    """Events of drafts; those without a parcel, an id or a time cannot be put in order and are left out."""
    return events.filter(F.col("action").isin("DRAFT_PUT", "DRAFT_DISCARD")).dropna(subset=["parcel_id", "event_id", "ts"])


def _newest_per_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: only the newest event of a parcel in each Arrow chunk goes on to the state."""
    for pdf in batches:
        yield pdf.sort_values(["ts", "event_id"]).drop_duplicates("parcel_id", keep="last")


def draft_changes(events: DataFrame) -> DataFrame:
    """Draft state per parcel after each batch that mentions it, and once more, not live, when a draft expires. ``events``:
    parcel_id, event_id, ts, action (DRAFT_PUT / DRAFT_DISCARD count), value."""
    e = _draft_events(events).select("parcel_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action", "value")
    e = e.withColumn("ms", F.unix_millis("ts"))
    thin = e.mapInPandas(_newest_per_chunk, e.schema).withWatermark("ts", f"{DRAFT_TTL_HOURS} hours")
    return thin.groupBy("parcel_id").transformWithStateInPandas(
        statefulProcessor=DraftProcessor(), outputStructType=DRAFT_OUT, outputMode="update", timeMode="eventTime")


def draft_state(events: DataFrame, as_of=None) -> DataFrame:
    """Batch twin: live draft per parcel, not older than 24 h at ``as_of`` (default: the last event)."""
    last = _draft_events(events).groupBy("parcel_id").agg(
        F.max_by(F.struct("event_id", "ts", "action", "value"), F.struct("ts", "event_id")).alias("l")).select("parcel_id", "l.*")
    return _live(last.filter("action = 'DRAFT_PUT'"), events, as_of)


def _live(drafts: DataFrame, events: DataFrame, as_of) -> DataFrame:
    if as_of is not None:
        at = drafts.withColumn("_now", F.lit(as_of).cast("timestamp"))
    else:
        now = events.agg(F.max("ts").cast("timestamp").alias("_now")).withColumn("_one", F.lit(1))
        at = drafts.withColumn("_one", F.lit(1)).join(now, "_one")
    fresh = F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {DRAFT_TTL_HOURS} HOURS") >= F.col("_now")
    return at.filter(fresh).select("parcel_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


def run_draft_state(stream: DataFrame, events: DataFrame, as_of=None) -> DataFrame:
    """Run the draft stream to the end and give the live drafts, as draft_state does."""
    out = run_to_table(draft_changes(stream), "update", "drafts")
    # The end of a draft carries its event, so of two equal events the one that is over is the later.
    last = out.groupBy("parcel_id").agg(F.max_by(F.struct("event_id", "ts", "value", "live"), F.struct("ts", "event_id", ~F.col("live"))).alias("l")).select("parcel_id", "l.*")
    return _live(last.filter("live"), events, as_of)


# ---- progress ------------------------------------------------------------------------------------

def progress_counts(events: DataFrame) -> DataFrame:
    """Counters per batch of jobs; update mode when streaming."""
    return events.groupBy("batch_id").agg(
        F.count_if(F.col("success")).alias("completed"), F.count_if(~F.col("success")).alias("failed"), F.max("ts").alias("updated_at"))


def progress_status(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Latest counters against the totals: COMPLETED once all are accounted for."""
    out = totals.join(counts, "batch_id", "left").na.fill(0, ["completed", "failed"])
    done = (F.col("completed") + F.col("failed") >= F.col("total")) & (F.col("total") > 0)
    return out.select("batch_id", "total", "completed", "failed", "updated_at", F.when(done, "COMPLETED").otherwise("PROCESSING").alias("status"))


def run_progress(stream: DataFrame, totals: DataFrame) -> DataFrame:
    out = run_to_table(progress_counts(stream), "update", "progress")
    last = out.groupBy("batch_id").agg(F.max_by(F.struct("completed", "failed", "updated_at"), "batch_no").alias("l")).select("batch_id", "l.*")
    return progress_status(last, totals)


# ---- approvals -----------------------------------------------------------------------------------

def _docket_events(events: DataFrame, parcels: DataFrame) -> DataFrame:
    return events.filter(F.col("action").isin("SUBMIT", "APPROVE")).select(
        "parcel_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action").join(parcels.select("parcel_id"), "parcel_id")


def _submissions(e: DataFrame) -> DataFrame:
    """Earliest submission per parcel; only aggregates of a parcel's events are shuffled."""
    return e.filter("action = 'SUBMIT'").groupBy("parcel_id").agg(F.min(F.struct("ts", "event_id")).alias("s"))


def _chosen(submissions: DataFrame, actions: DataFrame) -> DataFrame:
    """Each parcel's earliest submission and the first action after it."""
    k = F.struct("ts", "event_id")
    act = actions.join(submissions, "parcel_id").filter(k > F.col("s")).groupBy("parcel_id").agg(F.min(k).alias("a"))
    return submissions.join(act, "parcel_id", "left").select(
        "parcel_id", F.col("s.event_id").alias("submitted_id"), F.col("s.ts").alias("submitted_at"),
        F.col("a.event_id").alias("action_id"), F.col("a.ts").alias("acted_at"))


def approval_state(events: DataFrame, parcels: DataFrame) -> DataFrame:
    """First submission of each known parcel and the first action after it."""
    e = _docket_events(events, parcels)
    return _chosen(_submissions(e), e.filter("action = 'APPROVE'"))


def run_approvals(stream: DataFrame, parcels: DataFrame) -> DataFrame:
    """The same as a stream joined to the parcel table, whatever order and batches the events come in.

    A batch adds what it knows, the earliest submission per parcel and its actions, in a folder of its own that
    a replay overwrites; nothing kept is rewritten. The choice is made over all batches when the state is read, so an action
    that came before its submission counts, and a submission that moves earlier opens the choice again."""
    spark = stream.sparkSession
    out = run_dir(spark, "approvals")
    known = "parcel_id bigint, event_id bigint, ts timestamp"

    def write(df: DataFrame, batch: int) -> None:
        _submissions(df).select("parcel_id", "s.event_id", "s.ts").write.mode("overwrite").parquet(f"{out}/submitted/batch_no={batch}")
        df.filter("action = 'APPROVE'").select("parcel_id", "event_id", "ts").write.mode("overwrite").parquet(f"{out}/acted/batch_no={batch}")

    empty = spark.createDataFrame([], known).withColumn("batch_no", F.lit(-1))
    for part in ("submitted", "acted"):  # the folders exist even if no batch comes
        empty.write.mode("append").partitionBy("batch_no").parquet(f"{out}/{part}")
    run_available(_docket_events(stream, parcels), "append", write, "approvals")
    read = lambda part: spark.read.schema(known + ", batch_no int").parquet(f"{out}/{part}").drop("batch_no")
    first = read("submitted").groupBy("parcel_id").agg(F.min(F.struct("ts", "event_id")).alias("s"))
    return _chosen(first, read("acted"))


# ---- audit ledger --------------------------------------------------------------------------------

def audit_entries(events: DataFrame) -> DataFrame:
    """Signed ledger rows of the acting events."""
    state = F.to_json(F.struct("action", "value"))
    return events.filter(F.col("action").isin("SUBMIT", "APPROVE", "DRAFT_DISCARD")).select(
        "event_id", "parcel_id", F.col("ts").cast("timestamp").alias("ts"), "action", state.alias("new_state"),
        F.sha2(F.concat_ws(":", F.col("parcel_id").cast("string"), "action", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.col("event_id").cast("string")), 256).alias("digital_signature"))


def run_audit(stream: DataFrame) -> DataFrame:
    """Append-only ledger: an entry is written once, however late or often it comes.

    A batch is freed of its own repeats and of what earlier batches have written. Equal entries have the same day, so
    only the days that a batch mentions are read back (the join prunes the others). A replay overwrites its batch."""
    spark = stream.sparkSession
    out = run_dir(spark, "audit")
    entries = audit_entries(stream)
    schema = entries.schema.add("batch_no", "long").add("day", "date")
    spark.createDataFrame([], schema).write.partitionBy("batch_no", "day").parquet(out)

    def ledger() -> DataFrame:
        return spark.read.schema(schema).option("basePath", out).parquet(out)

    def write(df: DataFrame, batch: int) -> None:
        new = df.withColumn("day", F.to_date("ts")).dropDuplicates(["digital_signature"])
        old = ledger().filter(F.col("batch_no") < batch).select("day", "digital_signature")
        new.join(old, ["day", "digital_signature"], "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch_no={batch}")

    run_available(entries, "append", write, "audit")
    return ledger().drop("day")


# ---- timeline ------------------------------------------------------------------------------------

def week_counts(events: DataFrame) -> DataFrame:
    """Drafted and approved events per week from Monday on."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "7 days", startTime="4 days")).agg(
        F.count_if(F.col("action") == "DRAFT_PUT").alias("ai_drafted"), F.count_if(F.col("action") == "APPROVE").alias("officer_approved")
    ).select(F.col("window.start").alias("week_start"), "ai_drafted", "officer_approved")


def run_timeline(stream: DataFrame) -> DataFrame:
    """Counts per week over all batches. Each batch writes its own counts, which add up; no event is too late."""
    spark = stream.sparkSession
    out = run_dir(spark, "timeline")
    schema = "week_start timestamp, ai_drafted bigint, officer_approved bigint"
    spark.createDataFrame([], schema).withColumn("batch_no", F.lit(-1)).write.partitionBy("batch_no").parquet(out)

    def write(df: DataFrame, batch: int) -> None:
        week_counts(df).write.mode("overwrite").parquet(f"{out}/batch_no={batch}")

    run_available(stream.select("ts", "action"), "append", write, "timeline")
    parts = spark.read.schema(schema + ", batch_no int").parquet(out)
    return parts.groupBy("week_start").agg(F.sum("ai_drafted").alias("ai_drafted"), F.sum("officer_approved").alias("officer_approved"))


# ---- layer ingest --------------------------------------------------------------------------------

def layer_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Layer documents as they arrive in a folder."""
    return (spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
            .load(folder).select(F.col("_metadata.file_path").alias("path"), "value"))


def ingest_layers(stream: DataFrame, name: str = "layers") -> tuple[DataFrame, DataFrame]:
    """Run the ingest to the end: (file profiles, parsed plots). Each micro-batch is profiled and parsed
    in parallel and written under its own batch folder."""
    spark = stream.sparkSession
    out = run_dir(spark, name)

    def write(df: DataFrame, batch: int) -> None:
        profile_documents(df).write.mode("overwrite").parquet(f"{out}/files/batch_no={batch}")
        parse_geojson(df).write.mode("overwrite").parquet(f"{out}/plots/batch_no={batch}")

    run_available(stream, "append", write, name)
    return spark.read.parquet(f"{out}/files"), spark.read.parquet(f"{out}/plots")
