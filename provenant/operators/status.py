"""Status queries (#68-#77) over VarSteps, markers and a transition log.

Markers are what a run leaves in its folder (``status.<state>`` files, read
by :func:`provenant.sources.files.scan_status`): ``(vs_id, marker)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.numbering import number_rows, with_previous
from provenant.operators.skew import hot_split_join

# Marker file suffixes and the state labels they map to.
MARKERS = {
    "notrunning": "Not-Running",
    "running": "Running",
    "finished": "Finished",
    "error": "Error",
}
NOT_INITIALIZED = "Not-Initialized"
NOT_RUNNING = "Not-Running"
RUNNING = "Running"
FINISHED = "Finished"
ERROR = "Error"
MULTIPLE = "Multiple-Statuses"  # more than one marker: the reference refuses to go on
RUNNABLE = (NOT_INITIALIZED, NOT_RUNNING)
MAX_STEPS = 1_000_000


_CODES = {m: i for i, m in enumerate(MARKERS)}


def resolve_status(vsteps: DataFrame, markers: DataFrame) -> DataFrame:
    """#68: no marker = Not-Initialized; one = its state; more = Multiple-Statuses.

    Markers are aggregated as small integer codes so the aggregation stays
    a (map-side combined) hash aggregate."""
    code = F.lit(None).cast("int")
    for m, i in _CODES.items():
        code = F.when(F.col("marker") == m, F.lit(i)).otherwise(code)
    # other files named status.* are no markers
    per = markers.where(F.col("marker").isin(*MARKERS)).groupBy("vs_id").agg(
        F.count(F.lit(1)).alias("n_markers"), F.min(code).alias("_code")
    )
    label = F.lit(None).cast("string")
    for m, i in _CODES.items():
        label = F.when(F.col("_code") == i, F.lit(MARKERS[m])).otherwise(label)
    j = vsteps.join(per, "vs_id", "left")
    status = (
        F.when(F.col("n_markers").isNull(), F.lit(NOT_INITIALIZED))
        .when(F.col("n_markers") > 1, F.lit(MULTIPLE))
        .otherwise(label)
    )
    return j.select("vs_id", "step", status.alias("status"),
                    F.coalesce("n_markers", F.lit(0)).cast("bigint").alias("n_markers"))


def readiness(deps: DataFrame, status: DataFrame) -> DataFrame:
    """#69: a VarStep is ready when every direct dependency is Finished."""
    st = status.select(F.col("vs_id").alias("dep_vs_id"), F.col("status").alias("dep_status"))
    # a VarStep many others depend on (shared by every variation) is a hot key
    per = hot_split_join(deps, st, "dep_vs_id", "left").groupBy("vs_id").agg(
        F.count(F.lit(1)).alias("n_deps"),
        F.count_if(F.col("dep_status") == FINISHED).alias("n_deps_finished"),
    )
    return status.select("vs_id", "step", "status").join(per, "vs_id", "left").select(
        "vs_id", "step", "status",
        F.coalesce("n_deps", F.lit(0)).cast("bigint").alias("n_deps"),
        F.coalesce("n_deps_finished", F.lit(0)).cast("bigint").alias("n_deps_finished"),
        (F.coalesce("n_deps", F.lit(0)) == F.coalesce("n_deps_finished", F.lit(0))).alias("ready"),
    )


def run_order(links: DataFrame, levels: DataFrame) -> DataFrame:
    """#55: VarSteps parents first: by step level, then first design row,
    then step name and id; ``order_pos`` from 0."""
    vs = links.groupBy("vs_id", "step").agg(F.min("variation_pos").alias("first_pos"))
    n_levels = levels.count()  # one row per step: configuration-sized, checked
    if n_levels > MAX_STEPS:
        raise ValueError(f"{n_levels} steps; more than {MAX_STEPS} is not a study configuration")
    vs = vs.join(F.broadcast(levels), "step", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return number_rows(vs, ["level", "first_pos", "step", "vs_id"], out="order_pos")


def ready_set(order: DataFrame, ready: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """#71: every VarStep that can start now, in run order; of ``subset``
    (a frame of ``vs_id``) if given."""
    if subset is not None:
        ready = ready.join(subset.select("vs_id").distinct(), "vs_id", "left_semi")
    r = ready.where(F.col("ready") & F.col("status").isin(*RUNNABLE)).select("vs_id", "status")
    return order.join(r, "vs_id").select("order_pos", "vs_id", "step", "level", "status")


def next_step(order: DataFrame, ready: DataFrame) -> DataFrame:
    """#70: the first VarStep in run order that can start (top-1)."""
    return ready_set(order, ready).orderBy("order_pos").limit(1)


def pending_count(status: DataFrame) -> DataFrame:
    """#72: VarSteps still to run, and all."""
    return status.agg(
        F.count_if(F.col("status").isin(*RUNNABLE)).alias("n_pending"),
        F.count(F.lit(1)).alias("n_total"),
    )


def check_transitions(log: DataFrame, unit: str = "vs_id", order_by: tuple = ("ts",),
                      status: str = "status") -> DataFrame:
    """#73: judge each status change against the previous one of its unit:
    no move back to Not-Initialized; a run starts only from Not-Running."""
    prev = with_previous(log, [unit], list(order_by), [status])
    verdict = (
        F.when(F.col(status) == NOT_INITIALIZED, F.lit("to_uninitialized"))
        .when((F.col(status) == RUNNING) & ~F.col("prev_" + status).eqNullSafe(F.lit(NOT_RUNNING)), F.lit("bad_start"))
        .otherwise(F.lit("ok"))
    )
    return prev.withColumn("verdict", verdict)


def status_step(status: DataFrame, upstream: DataFrame, deps: DataFrame) -> DataFrame:
    """#74: per VarStep its upstream branches and its dependencies with
    their states: rows ``(vs_id, step, status, item, name, value)``."""
    br = upstream.select("vs_id", F.lit("branch").alias("item"), F.col("variable").alias("name"), "value")
    st = status.select(F.col("vs_id").alias("dep_vs_id"), F.col("step").alias("dep_step"),
                       F.col("status").alias("dep_status"))
    dp = hot_split_join(deps.select("vs_id", "dep_vs_id"), st, "dep_vs_id").select(
        "vs_id", F.lit("dependency").alias("item"), F.concat_ws(" ", "dep_step", "dep_vs_id").alias("name"),
        F.col("dep_status").alias("value"),
    )
    return status.select("vs_id", "step", "status").join(br.unionByName(dp), "vs_id", "left")


def status_list(status: DataFrame) -> DataFrame:
    """#75: one compact line per VarStep: id, step name cut to 14, state."""
    name14 = F.rpad(F.substring("step", 1, 14), 14, " ")
    return status.select(
        "vs_id", "step", "status",
        F.concat(F.lit("  "), F.col("vs_id"), F.lit(" "), name14, F.lit(" "), F.col("status")).alias("line"),
    )


def status_variation(branches: DataFrame, varsteps: DataFrame, status: DataFrame) -> DataFrame:
    """#76: per distinct variation its branches ``(v_id, variable, value)``
    and its VarSteps ``(v_id, step, vs_id)`` with states: rows
    ``(v_id, item, name, value)``."""
    br = branches.select("v_id", F.lit("branch").alias("item"), F.col("variable").alias("name"), "value")
    # a VarStep shared by every variation is a hot key of the link rows
    vs = hot_split_join(varsteps, status.select("vs_id", "status"), "vs_id").select(
        "v_id", F.lit("varstep").alias("item"), F.concat_ws(" ", "step", "vs_id").alias("name"),
        F.col("status").alias("value"))
    return br.unionByName(vs)


def status_study(status: DataFrame) -> DataFrame:
    """#77: VarStep counts per step and state."""
    return status.groupBy("step", "status").agg(F.count(F.lit(1)).alias("n_varsteps"))
