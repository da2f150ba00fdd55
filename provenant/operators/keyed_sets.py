"""Keyed-set digests (#21) of a table, for sets of any size.

Sets of up to ``GROUP_IN_ROW`` names are digested by the aggregate of
``functions.digests``.  A larger set is never gathered: its rows pass one task
in name order, which holds the hash state and the name before; a name that
stands next to itself is a repetition (#22) and the set has no digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions.digests import ID_DIGEST_BYTES, keyed_set_digest

GROUP_IN_ROW = 10_000


def keyed_set_digests(df: DataFrame, set_cols: Sequence[str], prefix: str, name: str | Column, value: str | Column,
                      n_bytes: int = ID_DIGEST_BYTES, in_row: int = GROUP_IN_ROW) -> DataFrame:
    """``(*set_cols, n_items, set_digest)`` with SHA-256; null where a name
    repeats.  A null value adds nothing; rows with a null name count as
    members, but not as repetitions."""
    g = list(set_cols)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(*g, as_col(name).cast("string").alias("_name"), as_col(value).cast("string").alias("_value"))
    small = lambda part: part.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_items"), keyed_set_digest(prefix, "_name", "_value", n_bytes).alias("set_digest"))
    # at most rows / in_row sets are large
    large = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > in_row).select(*g).persist()
    try:
        chosen = large.collect()
    finally:
        large.unpersist(blocking=False)
    if not chosen:
        return small(rows)
    big = F.broadcast(df.sparkSession.createDataFrame(chosen, large.schema))
    marked = rows.join(big.withColumn("_big", F.lit(True)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(g)], "_big"),
                       [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(g)], "left").select(*rows.columns, "_big")
    return small(marked.where("_big is null").drop("_big")).unionByName(_streamed(marked.where("_big").drop("_big"), g, prefix, n_bytes))


def _streamed(rows: DataFrame, g: list[str], prefix: str, n_bytes: int) -> DataFrame:
    rows = rows.repartition(*g).sortWithinPartitions(*g, F.col("_name").asc_nulls_first(), F.col("_value").asc_nulls_first())
    schema = T.StructType([*(rows.schema[c] for c in g), T.StructField("n_items", T.LongType()), T.StructField("set_digest", T.StringType())])

    def run(batches):
        import hashlib

        import pyarrow as pa

        key, state, before, n, unique, out, kinds = None, None, None, 0, True, [], None

        def close():
            if state is not None:
                out.append((*key, n, state.hexdigest()[:2 * n_bytes] if unique else None))

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in g]
            cols = [batch.column(c).to_pylist() for c in (*g, "_name", "_value")]
            for *k, nm, v in zip(*cols):
                if state is None or k != key:
                    close()
                    key, state, before, n, unique = k, hashlib.sha256(prefix.encode()), None, 0, True
                n += 1
                unique = unique and (nm is None or nm != before)
                before = nm
                state.update(((nm or "") + (v or "")).encode())
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*kinds, pa.int64(), pa.string()])],
                                             names=[*g, "n_items", "set_digest"])

    return rows.mapInArrow(run, schema)
