"""Paths as Spark means them, opened inside tasks.

A path without scheme belongs to the session's default file system
(``fs.defaultFS``), which on a cluster is rarely the local one.  The driver
asks the session for it; tasks open paths with it through ``pyarrow.fs``.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

LOCAL = "file://"
_CACHE: dict[str, tuple] = {}


def default_root(spark: SparkSession) -> str:
    """The default file system, as ``scheme://authority``."""
    try:
        found = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    except Exception:  # Spark Connect: no Hadoop configuration on this side
        found = spark.conf.get("spark.hadoop.fs.defaultFS", None)
    return (found or LOCAL).rstrip("/") if (found or "").rstrip("/") not in ("", "file:") else LOCAL


def open_path(path: str, root: str):
    """``(file system, path inside it)`` for a path or URI."""
    import pyarrow.fs as pafs

    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?$", path)
    if found is None:
        if root == LOCAL:
            return pafs.LocalFileSystem(), path
        return open_path(root + "/" + path.lstrip("/"), root)
    scheme, authority, rest = found.groups()
    if scheme == "file":
        return pafs.LocalFileSystem(), rest or "/"
    base = f"{scheme}://{authority or ''}"
    if base not in _CACHE:
        _CACHE[base] = pafs.FileSystem.from_uri(base + "/")
    fs, top = _CACHE[base]
    return fs, top.rstrip("/") + (rest or "/")
