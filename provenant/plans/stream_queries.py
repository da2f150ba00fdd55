"""Registered query for the streaming status monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.plans.registry import register
from provenant.plans.source_queries import scratch_dir
from provenant.plans.study_fixtures import transition_log
from provenant.plans.study_sql import TRANSITIONS_SQL
from provenant.streaming.status_monitor import bucket_count, transition_verdicts

N_SLICES = 4


@register("check_transitions_stream", TRANSITIONS_SQL)
def q_check_transitions_stream(spark, sf_dir):
    """#73 incrementally: the ``events`` status log arrives as time slices
    (one file each, oldest first), a stream judges each change against the
    state kept for each user, results land in a parquet sink that is read back."""
    log = transition_log(spark, sf_dir)
    src = scratch_dir(spark, "status-log")
    us = log.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    bounds = us.approxQuantile("u", [i / N_SLICES for i in range(1, N_SLICES)], 0.0)
    edges = [None, *sorted(set(int(b) for b in bounds)), None]
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    for i in range(len(edges) - 1):
        cond = F.lit(True)
        if edges[i] is not None:
            cond = cond & (u >= edges[i])
        if edges[i + 1] is not None:
            cond = cond & (u < edges[i + 1])
        log.where(cond).coalesce(1).write.parquet(f"{src}/slice={i:04d}")
    stream = (
        spark.readStream.schema(log.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(src)
    )
    out = scratch_dir(spark, "status-verdicts")
    # state partitions are fixed when a stream first starts: size them to
    # the cluster's parallelism rather than the batch shuffle default
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        parallelism = spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect: keep the session's setting
        parallelism = int(before)
    users = log.select(F.approx_count_distinct("user_id")).first()[0]
    spark.conf.set(key, str(max(1, parallelism)))
    try:
        q = (
            transition_verdicts(stream, unit="user_id", ts="ts", tie="event_id", status="status",
                                buckets=bucket_count(users, parallelism))
            .writeStream.format("parquet")
            .option("checkpointLocation", out + "-checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start(out)
        )
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "ts", "status", "prev_status", "verdict")
