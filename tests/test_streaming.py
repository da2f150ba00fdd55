"""The streaming status monitor: state carried across micro-batches, late
changes flagged, same verdicts as the batch check."""

import datetime as dt
import tempfile

from provenant.streaming.status_monitor import transition_verdicts

SCHEMA = "event_id bigint, user_id bigint, ts timestamp_ntz, status string"


def t(s):
    return dt.datetime(2024, 1, 1, 0, 0, s)


def test_state_across_batches_and_late_events(spark):
    src = tempfile.mkdtemp(prefix="provenant-stream-src-")
    out = tempfile.mkdtemp(prefix="provenant-stream-out-")
    batches = [
        [(1, 7, t(1), "Not-Running"), (2, 8, t(1), "Running")],
        [(3, 7, t(2), "Running"), (4, 8, t(3), "Not-Initialized")],
        [(5, 7, t(0), "Finished"), (6, 7, t(4), "Running")],  # event 5 is older than what was judged
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/slice={i:04d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = (transition_verdicts(stream).writeStream.format("parquet")
         .option("checkpointLocation", out + "/_ckpt").outputMode("append")
         .trigger(availableNow=True).start(out + "/data"))
    q.awaitTermination()
    got = {r.event_id: (r.prev_status, r.verdict) for r in spark.read.parquet(out + "/data").collect()}
    assert got == {
        1: (None, "ok"),
        2: (None, "bad_start"),
        3: ("Not-Running", "ok"),
        4: ("Running", "to_uninitialized"),
        5: (None, "late"),
        6: ("Running", "bad_start"),
    }


def test_stream_equals_batch_on_events(spark):
    """The ``events`` status log in time slices through the stream gives
    the batch verdicts (the registered query, whole table)."""
    from provenant.plans.catalog import QUERIES

    from conftest import SF_SMALL

    stream = {r.event_id: (r.prev_status, r.verdict)
              for r in QUERIES["check_transitions_stream"](spark, SF_SMALL).collect()}
    batch = {r.event_id: (r.prev_status, r.verdict)
             for r in QUERIES["check_transitions"](spark, SF_SMALL).collect()}
    assert stream == batch and len(batch) > 0


def _stream(spark, batches, **options):
    src = tempfile.mkdtemp(prefix="provenant-stream-src-")
    out = tempfile.mkdtemp(prefix="provenant-stream-out-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/slice={i:04d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = (transition_verdicts(stream, **options).writeStream.format("parquet")
         .option("checkpointLocation", out + "/_ckpt").outputMode("append")
         .trigger(availableNow=True).start(out + "/data"))
    q.awaitTermination()
    got = {r.event_id: (r.user_id, r.prev_status, r.verdict) for r in spark.read.parquet(out + "/data").collect()}
    return got, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_units_share_groups_and_state(spark):
    """Groups follow the buckets, not the units; units of a bucket keep apart."""
    big = 2**60 + 1  # exact although rows without a unit are there
    batches = [
        [(1, 7, t(1), "Not-Running"), (2, big, t(5), "Not-Running"), (3, None, t(2), "Not-Running"), (4, 7, t(1), "Running")],
        [(5, big, t(4), "Running"), (6, big, t(5), "Running"), (7, 7, t(3), None), (8, None, t(3), "Running"), (9, 9, t(0), "Running")],
        [(10, 7, t(3), "Running"), (11, 9, t(0), "Not-Initialized"), (12, None, t(1), "Running"), (13, big, t(6), "Finished")],
    ]
    got, states = _stream(spark, batches, buckets=1)
    assert got == {
        1: (7, None, "ok"), 2: (big, None, "ok"), 3: (None, None, "ok"), 4: (7, "Not-Running", "ok"),
        5: (big, None, "late"), 6: (big, "Not-Running", "ok"), 7: (7, "Running", "ok"), 8: (None, "Not-Running", "ok"),
        9: (9, None, "bad_start"),
        10: (7, None, "bad_start"), 11: (9, "Running", "to_uninitialized"), 12: (None, None, "late"),
        13: (big, "Running", "ok"),
    }
    assert states == 2  # one bucket, and the rows without a unit


def test_groups_do_not_follow_the_units(spark):
    rows = [(i, i % 700, t(i % 50), "Running") for i in range(1400)]
    got, states = _stream(spark, [rows[:700], rows[700:]], buckets=5)
    assert len(got) == 1400 and states == 5
