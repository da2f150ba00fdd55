"""Joins whose big side may hold a hot key (one path listed by a third of
all entries, one base name shared by a third of all files).

``hot_split_join`` joins ``big`` to ``dim`` (at most one row per key, and
rows of bounded width -- digests, ids, states; never file contents) and
splits the keys first: a key is *hot* when it holds more than
``max(MIN_HOT_ROWS, total / MAX_HOT_KEYS)`` rows of ``big``.  There can be at most
``MAX_HOT_KEYS`` such keys (their rows add up to at most ``total``), so the
hot keys and their ``dim`` rows are a proven-bounded broadcast; hot rows of
``big`` are joined through it without a shuffle, the rest by an ordinary
shuffle join in which no key holds more than ``total / MAX_HOT_KEYS`` rows.
Counting keys is a partial (map-side combined) aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 100_000
# a key is never hot below this many rows: one task handles them easily
MIN_HOT_ROWS = 10_000


def _hot_rows(big: DataFrame, key: str, max_hot: int):
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull()).persist()
    try:
        total, biggest = counts.agg(F.sum("_n"), F.max("_n")).first()
        threshold = max(MIN_HOT_ROWS, (total or 0) // max_hot)
        hot = counts.where(F.col("_n") > threshold).select(key)
        rows = [] if (biggest or 0) <= threshold else hot.limit(max_hot + 1).collect()
    finally:
        counts.unpersist(blocking=False)
    if len(rows) > max_hot:  # cannot happen: the counts add up to total
        raise AssertionError("hot-key bound violated")
    return rows, hot.schema


def hot_keys(big: DataFrame, key: str, max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """Keys of ``big`` holding more than ``max(MIN_HOT_ROWS, total /
    max_hot)`` rows (at most ``max_hot`` of them); computed eagerly so the
    bound is checked."""
    rows, schema = _hot_rows(big, key, max_hot)
    return big.sparkSession.createDataFrame(rows, schema)


def hot_split_join(big: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                   max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """``big.join(dim, key, how)`` for ``how`` in inner / left / left_semi /
    left_anti, with hot keys of ``big`` joined by broadcast."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    rows, schema = _hot_rows(big, key, max_hot)
    if not rows:
        return big.join(dim, key, how)
    hot_b = F.broadcast(big.sparkSession.createDataFrame(rows, schema))
    big_hot = big.join(hot_b, key, "left_semi")
    big_cold = big.join(hot_b, key, "left_anti")
    dim_hot = F.broadcast(dim.join(hot_b, key, "left_semi"))
    return big_hot.join(dim_hot, key, how).unionByName(big_cold.join(dim, key, how))
