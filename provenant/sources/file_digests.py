"""Content digests of files of any size (#18 for files, used by #28/#30).

``binaryFile`` holds a whole file in one row, which caps file size and
memory.  Here files are read by the executors in pieces (``pyarrow.fs``
reaches local, HDFS and object stores by URI):

* ``sha256`` -- a sequential hash: each file is streamed through one task in
  1 MiB pieces (memory stays bounded; SHA-256 has no parallel form);
* ``blake3`` -- the reference's digest, which *is* parallel: a file is cut
  into segments of a power-of-two number of 1 KiB chunks, each segment's
  subtree value is computed by some task, and the segment values are merged
  with ``groupBy`` (aligned blocks per level) into the exact BLAKE3 root.  A
  single huge file is spread over the whole cluster; the segments of many
  small files are compressed together, ``_BATCH_BYTES`` at a time.

Paths without scheme belong to the session's default file system.
Missing files come back with ``exists = false`` and a null digest; empty
files are digested too (file sources skip them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.session import materialize
from provenant.sources.files import dealt
from provenant.sources.filesystems import default_root, open_path

SEGMENT_BYTES = 64 << 20  # 64 MiB = 2**16 BLAKE3 chunks per segment
_READ_BYTES = 1 << 20
#: bytes of segments compressed in one vectorised pass
_BATCH_BYTES = 4 << 20


def stat_files(paths: DataFrame) -> DataFrame:
    """``(path, exists, size)`` for each asked path, stat'ed on the executors."""
    root = default_root(paths.sparkSession)

    def stat(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        for pdf in batches:
            ex, sz = [], []
            for p in pdf["path"]:
                fs, local = open_path(p, root)
                info = fs.get_file_info(local)
                ok = info.type == pafs.FileType.File
                ex.append(ok)
                sz.append(info.size if ok else None)
            yield pd.DataFrame({"path": pdf["path"], "exists": ex, "size": pd.array(sz, dtype="Int64")})

    return paths.select("path").mapInPandas(stat, "path string, exists boolean, size bigint")


def _sha256_files(stats: DataFrame) -> DataFrame:
    root = default_root(stats.sparkSession)

    def digest(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            out = []
            for p, ok in zip(pdf["path"], pdf["exists"]):
                if not ok:
                    out.append(None)
                    continue
                fs, local = open_path(p, root)
                h = hashlib.sha256()
                with fs.open_input_stream(local) as f:
                    while True:
                        piece = f.read(_READ_BYTES)
                        if not piece:
                            break
                        h.update(piece)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "exists": pdf["exists"], "size": pdf["size"],
                                "data_digest": pd.Series(out, dtype=object)})

    return stats.mapInPandas(digest, "path string, exists boolean, size bigint, data_digest string")


def _segment_nodes(read: list[tuple[bytes, int, bool]]) -> list[str]:
    """Node value (hex) of each segment ``(bytes, start, whole file)``."""
    import numpy as np

    from provenant.functions.blake3 import CHUNK_LEN, _hex, chunk_cvs, merge_cvs

    chunks, counters, roots, counts = [], [], [], []
    for data, start, whole in read:
        n = max(1, -(-len(data) // CHUNK_LEN))
        chunks += [data[i * CHUNK_LEN:(i + 1) * CHUNK_LEN] for i in range(n)]
        counters.append(np.arange(n, dtype=np.uint64) + np.uint64(start // CHUNK_LEN))
        roots += [whole and n == 1] * n
        counts.append(n)
    cvs = chunk_cvs(chunks, np.concatenate(counters), np.array(roots))
    groups = np.split(cvs, np.cumsum(counts)[:-1], axis=1)
    return _hex(merge_cvs(groups, np.array([whole for _, _, whole in read])))


def _blake3_files(stats: DataFrame, segment_bytes: int) -> DataFrame:
    from provenant.operators.records import blake3_tree_merge

    root = default_root(stats.sparkSession)
    n_seg = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(segment_bytes))).cast("bigint")
    segs = dealt(stats.where(F.col("exists")).select(
        "path", "size", n_seg.alias("_m"), F.explode(F.sequence(F.lit(0).cast("bigint"), n_seg - 1)).alias("_idx")
    ).withColumn("_bytes", F.least(F.col("size"), F.lit(segment_bytes))), "_bytes", "path", "_idx")

    def segment_values(batches):
        import pandas as pd

        for pdf in batches:
            cvs, held, size = [], [], 0
            for p, idx, m, n in zip(pdf["path"], pdf["_idx"], pdf["_m"], pdf["size"]):
                start = int(idx) * segment_bytes
                length = max(0, min(segment_bytes, int(n) - start))
                data = b""
                if length:
                    fs, local = open_path(p, root)
                    with fs.open_input_file(local) as f:
                        data = f.read_at(length, start)
                held.append((data, start, int(m) == 1))
                size += length
                if size >= _BATCH_BYTES:
                    cvs += _segment_nodes(held)
                    held, size = [], 0
            if held:
                cvs += _segment_nodes(held)
            yield pd.DataFrame({"path": pdf["path"], "_idx": pdf["_idx"], "_m": pdf["_m"], "_n": pdf["size"],
                                "_cv": pd.Series(cvs, dtype=object)})

    nodes = segs.mapInPandas(segment_values, "path string, _idx bigint, _m bigint, _n bigint, _cv string")
    roots = blake3_tree_merge(nodes, ["path"])
    return stats.join(roots.select("path", F.col("_cv").alias("data_digest")), "path", "left").select(
        "path", "exists", "size", "data_digest")


def file_digests(paths: DataFrame, algorithm: str = "sha256", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``(path, exists, size, data_digest)`` for each asked ``path``, stored
    once: whatever is built from it, every file is read one time."""
    if segment_bytes < 1024 or segment_bytes & (segment_bytes - 1):
        raise ValueError("segment_bytes must be a power of two of at least 1024")
    if algorithm not in ("sha256", "blake3"):
        raise ValueError(f"unknown digest algorithm {algorithm!r}")
    asked = paths.select("path").distinct()
    # names are short: their bytes do not tell what a task has to read
    stats = materialize(stat_files(asked.repartition(4 * paths.sparkSession.sparkContext.defaultParallelism)))
    if algorithm == "sha256":
        return materialize(_sha256_files(dealt(stats, "size")))
    return materialize(_blake3_files(stats, segment_bytes))
