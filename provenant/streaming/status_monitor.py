"""Incremental status-change checks (#73 as a Structured Streaming job).

A run folder's marker changes over time; a monitor judges each change as it
arrives, against the last state seen for its unit, with the same rules as
:func:`provenant.operators.status.check_transitions`:

* ``to_uninitialized`` -- nothing may move back to Not-Initialized;
* ``bad_start``        -- Running only right after Not-Running;
* ``late``             -- older than the last change already judged for the unit
  (a batch job would have ordered it; a stream cannot re-judge the past);
* ``ok`` otherwise.

Units are dealt to a fixed number of buckets by a hash of their name.  A bucket
is one group of ``applyInPandasWithState``, and its state holds the last status,
time and tie-breaker of each of its units: Spark spends milliseconds on a group,
however small, so a group a unit made the time follow the units.  A bucket's
events of one micro-batch are one group, bounded by the trigger's size
(``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).  Rows without a unit have a
bucket of their own, as one unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenant.operators.status import NOT_INITIALIZED, NOT_RUNNING, RUNNING

#: units that a bucket should hold, where their number is known
BUCKET_UNITS = 500
#: stands for a missing time: after all others
NO_TIME = np.iinfo(np.int64).max


def bucket_count(units: int, parallelism: int) -> int:
    """Buckets for so many units: about ``BUCKET_UNITS`` each, a few a core."""
    return max(4 * parallelism, math.ceil(units / BUCKET_UNITS))


def _judge(unit: str, ts: str, tie: str, status: str, columns: list[str]):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True)
        # the last change judged, by unit: (status, time in microseconds, tie-breaker)
        last = {u: rest for u, *rest in zip(*state.get)} if state.exists else {}
        code, units = pd.factorize(pdf[unit], use_na_sentinel=False)
        names = [None if pd.isna(u) else u for u in units.tolist()]
        old = [last.get(u, (None, None, None)) for u in names]
        old_status = np.array([o[0] for o in old] + [None], object)[:-1]
        # without a last time nothing is late
        old_us = np.array([np.iinfo(np.int64).min if o[1] is None else o[1] for o in old], np.int64)
        old_tie = np.array([np.iinfo(np.int64).min if o[2] is None else o[2] for o in old], np.int64)

        us = pdf[ts].to_numpy("datetime64[us]").astype(np.int64)
        us = np.where(pdf[ts].isna(), NO_TIME, us)
        ties = pdf[tie].to_numpy()
        order = np.lexsort((ties, us, code))
        code, us, ties = code[order], us[order], ties[order]
        pdf = pdf.iloc[order]
        now = pdf[status].astype(object).where(pdf[status].notna(), None).to_numpy()
        # a unit's late changes come before its others in this order
        late = (us < old_us[code]) | ((us == old_us[code]) & (ties < old_tie[code]))
        follows = np.zeros(len(code), bool)
        follows[1:] = (code[1:] == code[:-1]) & ~late[:-1]
        prev = np.where(follows, np.roll(now, 1), old_status[code])
        prev[late] = None
        verdict = np.select([late, now == NOT_INITIALIZED, (now == RUNNING) & (prev != NOT_RUNNING)],
                            ["late", "to_uninitialized", "bad_start"], "ok")

        ends = np.flatnonzero(np.append(code[1:] != code[:-1], True) & ~late)
        for c, s, t, k in zip(code[ends].tolist(), now[ends].tolist(), us[ends].tolist(), ties[ends].tolist()):
            last[names[c]] = (s, None if t == NO_TIME else t, None if pd.isna(k) else int(k))
        state.update((list(last), *map(list, zip(*last.values()))))
        out = pdf.assign(**{"prev_" + status: prev, "verdict": verdict.astype(object)})
        yield out[columns]

    return fn


def transition_verdicts(log: DataFrame, unit: str = "user_id", ts: str = "ts", tie: str = "event_id",
                        status: str = "status", buckets: int = 256) -> DataFrame:
    """Streaming (or batch) frame of log rows with ``prev_<status>`` and
    ``verdict``; for a stream, write it in append mode.  ``buckets`` must stay
    the same when a stream is started again from its checkpoint."""
    fields = [f for f in log.schema.fields]
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    out_schema += f", prev_{status} string, verdict string"
    state_schema = (f"units array<{log.schema[unit].dataType.simpleString()}>, last_status array<string>, "
                    "last_us array<bigint>, last_tie array<bigint>")
    bucket = F.when(F.col(unit).isNotNull(), F.pmod(F.xxhash64(unit), F.lit(buckets)))
    columns = [*log.columns, "prev_" + status, "verdict"]
    return log.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        _judge(unit, ts, tie, status, columns), out_schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )
