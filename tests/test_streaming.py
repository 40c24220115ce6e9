"""Streams that forget: state falls once drafts expire, and the live drafts equal those of the batch twin."""
import datetime as dt

from landloom.session import run_dir
from landloom.streaming import jobs as J

SCHEMA = "parcel_id bigint, event_id bigint, ts timestamp, action string, value double"
START = dt.datetime(2024, 3, 1)


def files(spark, batches):
    """One file a batch, read one a micro-batch in that order."""
    folder = run_dir(spark, "drafts-in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.schema(SCHEMA).parquet(folder)


def test_drafts_leave_the_state(spark):
    n, days = 40, 6
    batches = [[(d * n + i, d * n + i, START + dt.timedelta(days=d, minutes=i), "DRAFT_PUT", float(i)) for i in range(n)] for d in range(days)]
    stream, table = files(spark, batches)
    seen = []
    progress = J.run_available(J.draft_changes(stream), "update", lambda df, b: seen.extend(df.collect()), "drafts-forget")
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # Rows count timers too. The state peaks at the days that a watermark of a day leaves open, not at all parcels.
    assert max(state) < state[0] * 4 and state[-1] <= state[0] * 2
    ended = {r.parcel_id for r in seen if not r.live}
    assert set(range((days - 2) * n)) <= ended and not ended & set(range((days - 1) * n + 1, days * n))
    stream, table = files(spark, batches)
    got = {tuple(r) for r in J.run_draft_state(stream, table).collect()}
    # The last draft of the day before is exactly a day old and lives.
    assert got == {tuple(r) for r in J.draft_state(table).collect()} and len(got) == n + 1


def test_late_repeated_and_odd_events(spark):
    h = dt.timedelta(hours=1)
    batches = [
        [(1, 1, START, "DRAFT_PUT", 1.0), (2, 2, START + 20 * h, "DRAFT_PUT", None), (3, 3, START + 30 * h, "DRAFT_PUT", 3.0)],
        # Late within the day, repeated, without a time, without a parcel, an action of no concern.
        [(3, 4, START + 29 * h, "DRAFT_DISCARD", None), (3, 3, START + 30 * h, "DRAFT_PUT", 3.0), (4, 5, None, "DRAFT_PUT", 1.0),
         (None, 6, START + 30 * h, "DRAFT_PUT", 1.0), (5, 7, START + 31 * h, "APPROVE", 1.0)],
        # A draft of exactly 24 hours lives; a parcel comes back after its draft expired; then events far behind the watermark.
        [(1, 8, START + 44 * h, "DRAFT_PUT", 8.0), (6, 9, START + 40 * h, "DRAFT_PUT", 9.0), (6, 10, START + 41 * h, "DRAFT_DISCARD", None)],
        [(1, 11, START + 1 * h, "DRAFT_DISCARD", None), (7, 12, START + 2 * h, "DRAFT_PUT", 1.0)],
    ]
    stream, table = files(spark, batches)
    got = {tuple(r) for r in J.run_draft_state(stream, table).collect()}
    assert got == {tuple(r) for r in J.draft_state(table).collect()}
    assert {r[0] for r in got} == {1, 2, 3}
    stream, table = files(spark, [[]])
    assert J.run_draft_state(stream, table).count() == 0
