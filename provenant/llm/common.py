"""Shared helpers of the training-data operators.

``text_slices`` keeps the memory of a Python task bounded: Arrow batches are
cut so that one slice holds at most ``max_bytes`` of text (a longer single
text makes a slice of its own).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.session import ensure_checkpoint_dir, ship_package

SLICE_BYTES = 1 << 20
#: Texts are long rows, and a batch is held by the JVM and by its Python worker:
#: limits of batches (rows, bytes), set where the session has Spark's own default
BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(2 << 20)),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package for the workers, and smaller batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for setting, (default, ours) in BATCH_LIMITS.items():
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into row ranges holding at most ``max_bytes`` of ``column``."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            start, before = 0, 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
                yield batch.slice(start, stop - start)
                before = int(ends[stop - 1])
                start = stop
    finally:
        release_memory()


def release_memory() -> None:
    """Give freed memory back: Spark keeps idle Python workers between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows (one aggregate)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser, fixed constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
