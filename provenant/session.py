"""Session helpers: building a local session for tests/bench, and lineage cuts.

On a cluster the session comes from the caller.  The only thing the library
needs from it is a *shared* checkpoint directory (``spark.checkpoint.dir``);
we read it from the session and only fall back to a private scratch folder
when it is unset (local tests and benches).
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "provenant") -> SparkSession:
    """A local session configured like a small cluster (AQE on, UI off)."""
    cpus = str(cpus)
    if shuffle_partitions is None:
        shuffle_partitions = 8 if cpus == "*" else int(cpus)
    parts = shuffle_partitions
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``provenant`` importable in the Python workers (UDFs refer to
    its functions): zip the package once and add it to the session's Python
    files.  A no-op when already done for this application."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = str(id(spark))
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="provenant-pkg-"), "provenant.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    try:
        spark.sparkContext.addPyFile(out)
    except Exception:  # Spark Connect
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    Clusters name a shared folder in ``spark.checkpoint.dir``; that setting
    wins.  Only when nothing is configured (local tests) a fresh scratch
    folder is made.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc is not None:
            sc.setCheckpointDir(conf_dir)
            return sc.getCheckpointDir() or conf_dir
        return conf_dir
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="provenant-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir() or scratch
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss.

    The frame is persisted first so the checkpoint write reads the cached
    blocks instead of computing the plan a second time; the cache is
    released once the checkpoint files exist.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist(blocking=False)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint
    folder and reading it back (one job; columnar, compressed).  Unlike
    :func:`cut_lineage` the output partitioning is not kept."""
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
