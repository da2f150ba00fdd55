"""Dense 0-based row numbers in a total order, without a one-task window.

``row_number() OVER (PARTITION BY p ORDER BY o)`` puts every row of one ``p``
into one task; with four report classes that is the whole table in four
tasks.  Here the rows are range-partitioned and sorted by ``(p, o)``; each
task numbers its own rows (``monotonically_increasing_id`` carries the task
index in its upper bits), a tiny per-(task, p) count table gives the offsets,
and a join adds them.  The numbered frame is written once as a table in the
shared checkpoint folder, so both uses see the same numbers (and a lost
executor cannot make a recomputation disagree).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.session import materialize

_LOW_BITS = (1 << 33) - 1


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_rows(df: DataFrame, order_by: Sequence[str | Column],
                partition_by: Sequence[str] = (), out: str = "row_num",
                count_out: str | None = None) -> DataFrame:
    """Add ``out`` = row_number() - 1 over (partition_by, order_by).

    ``order_by`` must be a total order within each partition (end it with a
    unique column) for the numbers to be deterministic.  ``count_out`` also
    adds the size of each partition (``count(*) over (partition_by)``).
    """
    pcols = list(partition_by)
    sort_exprs = [F.col(c).asc_nulls_first() for c in pcols] + [_as_col(c) for c in order_by]
    ranged = (
        df.repartitionByRange(*sort_exprs)
        .sortWithinPartitions(*sort_exprs)
        .withColumn("_rn_mid", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged)
    ranged = ranged.withColumn("_rn_task", F.shiftright("_rn_mid", 33)).withColumn(
        "_rn_loc", F.col("_rn_mid").bitwiseAND(F.lit(_LOW_BITS))
    )
    # one row per (task, partition value): at most tasks + groups rows
    blocks = ranged.groupBy("_rn_task", *pcols).agg(
        F.count(F.lit(1)).alias("_rn_cnt"), F.min("_rn_loc").alias("_rn_first")
    )
    before = Window.partitionBy(*pcols).orderBy("_rn_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn(
        "_rn_before", F.coalesce(F.sum("_rn_cnt").over(before), F.lit(0)).cast("bigint")
    ).withColumn("_rn_total", F.sum("_rn_cnt").over(Window.partitionBy(*pcols)).cast("bigint"))
    b = blocks.alias("_rn_b")
    r = ranged.alias("_rn_r")
    cond = [F.col("_rn_r._rn_task") == F.col("_rn_b._rn_task")] + [
        F.col(f"_rn_r.{c}").eqNullSafe(F.col(f"_rn_b.{c}")) for c in pcols
    ]
    joined = r.join(b, reduce(lambda x, y: x & y, cond))
    extra = [F.col("_rn_b._rn_total").alias(count_out)] if count_out else []
    return joined.select(
        *[F.col(f"_rn_r.{c}") for c in df.columns],
        (F.col("_rn_b._rn_before") + F.col("_rn_r._rn_loc") - F.col("_rn_b._rn_first"))
        .cast("bigint")
        .alias(out),
        *extra,
    )


def with_previous(df: DataFrame, unit_cols: Sequence[str], order_by: Sequence[str | Column],
                  value_cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``lag(value) OVER (PARTITION BY unit ORDER BY order_by)`` for each
    value column, without putting one unit's rows into one task.

    Rows are range-partitioned and sorted by (unit, order) once; each task
    shifts its own rows by one.  Only a task's first row looks further back:
    the last row of the range ranked before it is carried over (one row a
    task)."""
    units, values = list(unit_cols), list(value_cols)
    keys = [F.col(c).asc_nulls_first() for c in units] + [_as_col(c) for c in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_lag_rk", F.spark_partition_id().cast("bigint"))
    kept = ranged.columns
    out = T.StructType([*ranged.schema.fields, *[T.StructField(prefix + v, df.schema[v].dataType) for v in values],
                        T.StructField("_lag_edge", T.IntegerType())])

    def shift(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        before, held = None, None  # the last row seen; a batch held back until it is known to be the last

        def finish(batch, last):
            edge = [0] * batch.num_rows
            if batch_first[0]:
                edge[0] |= 1
                batch_first[0] = False
            if last:
                edge[-1] |= 2
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge, pa.int32())], names=[*batch.schema.names, "_lag_edge"])

        batch_first = [True]
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield finish(held, False)
            same = None
            for u in units:
                now = batch.column(u)
                head = before[u] if before else pa.nulls(1, now.type)
                past = pa.concat_arrays([head, now.slice(0, batch.num_rows - 1)])
                equal = pc.or_kleene(pc.fill_null(pc.equal(now, past), False), pc.and_(pc.is_null(now), pc.is_null(past)))
                same = equal if same is None else pc.and_(same, equal)
            columns = []
            for v in values:
                now = batch.column(v)
                head = before[v] if before else pa.nulls(1, now.type)
                past = pa.concat_arrays([head, now.slice(0, batch.num_rows - 1)])
                columns.append(past if same is None else pc.if_else(same, past, pa.nulls(batch.num_rows, now.type)))
            before = {c: batch.column(c).slice(batch.num_rows - 1, 1) for c in {*units, *values}}
            held = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *[prefix + v for v in values]])
        if held is not None:
            yield finish(held, True)

    shifted = materialize(ranged.mapInArrow(shift, out))
    # the last row of each task, and the task that follows it: one row a task
    lasts = shifted.where(F.col("_lag_edge").bitwiseAND(F.lit(2)) > 0)
    following = F.lead("_lag_rk").over(Window.orderBy("_lag_rk"))
    carried = lasts.select(following.alias("_lag_rk"), *[F.col(u).alias(f"_lag_u{i}") for i, u in enumerate(units)],
                           *[F.col(v).alias(f"_lag_v{i}") for i, v in enumerate(values)])
    first = F.col("_lag_edge").bitwiseAND(F.lit(1)) > 0
    same = reduce(lambda x, y: x & y, [F.col(u).eqNullSafe(F.col(f"_lag_u{i}")) for i, u in enumerate(units)], first)
    joined = shifted.join(F.broadcast(carried.where("_lag_rk is not null").withColumn("_lag_found", F.lit(True))), "_lag_rk", "left")
    same = same & F.coalesce("_lag_found", F.lit(False))
    return joined.select(*df.columns, *[F.when(same, F.col(f"_lag_v{i}")).otherwise(F.col(prefix + v)).alias(prefix + v)
                                        for i, v in enumerate(values)])
