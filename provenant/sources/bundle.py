"""Evidence bundle (#9): selected contents gathered flat by base name.

Equal base names collide (the reference stops with an error); the plan
lists them.  The bundle itself is a dataset ``(file_name, content)`` plus
its manifest, a Record over the bundled files in include order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.digests import content_digest
from provenant.functions.paths import file_name
from provenant.operators.records import build_records
from provenant.operators.skew import hot_split_join
from provenant.session import materialize
from provenant.sources.file_digests import file_digests
from provenant.sources.files import read_contents
from provenant.sources.records import write_records


def bundle_plan(includes: DataFrame, contents: DataFrame) -> dict[str, DataFrame]:
    """``includes(entry_pos, file)``, ``contents(path, content)`` ->
    ``selected``, ``collisions`` (base names used more than once) and
    ``manifest`` (entries of the bundle's Record: the base name as file)."""
    return plan_by_digests(includes, contents.select(F.col("path").alias("file"), content_digest("content").alias("data_digest")))


def plan_by_digests(includes: DataFrame, digests: DataFrame) -> dict[str, DataFrame]:
    """The plan from ``digests(file, data_digest)``: narrow rows only."""
    sel = hot_split_join(includes, digests, "file", "left").withColumn("file_name", file_name("file"))
    # a listed file that is not there fails the bundle
    gone = F.raise_error(F.concat(F.lit("missing file: "), F.col("file"))).cast("string")
    sel = sel.withColumn("data_digest", F.when(F.col("data_digest").isNull(), gone).otherwise(F.col("data_digest")))
    counts = sel.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_files"))
    collisions = counts.where(F.col("n_files") > 1)
    # a base name shared by a third of all files is a hot key: split it off
    manifest = hot_split_join(sel, collisions.select("file_name"), "file_name", "left_anti").select(
        "entry_pos", "file_name", "data_digest", F.col("file").alias("source_file"))
    return {"selected": sel, "collisions": collisions, "manifest": manifest}


def _refuse_collisions(plan: dict[str, DataFrame]) -> None:
    if not plan["collisions"].isEmpty():
        raise ValueError("bundle has equal base names; see bundle_plan(...)['collisions']")


def write_bundle(includes: DataFrame, contents: DataFrame, out_dir: str, strict: bool = True) -> DataFrame:
    """Write ``(file_name, content)`` of the bundle to ``out_dir`` from a table
    of contents; returns the manifest.  ``strict``: any collision fails before
    writing.  For files on disk use :func:`write_bundle_files`."""
    plan = bundle_plan(includes, contents)
    if strict:
        _refuse_collisions(plan)
    keep = plan["manifest"].select(F.col("source_file").alias("path"), "file_name")
    contents.join(keep, "path").select("file_name", "content").write.mode("overwrite").parquet(out_dir)
    return plan["manifest"]


def write_bundle_files(includes: DataFrame, out_dir: str, under: str | None = None, strict: bool = True) -> DataFrame:
    """The bundle of files on disk: digests are taken in pieces, collisions and
    order settled on narrow rows, and only then each file is read by its path,
    by the task that writes it (``file_name, content``): no bytes are shuffled,
    and Spark's task commit leaves no half-written file.  Returns the manifest.
    A file outside the folder ``under`` counts as missing."""
    listed = includes.select("file")
    if under is not None:
        listed = listed.where(F.col("file").startswith(under.rstrip("/") + "/"))
    digests = file_digests(listed.select(F.col("file").alias("path"))).where("exists").select(F.col("path").alias("file"), "data_digest")
    plan = plan_by_digests(includes, digests)
    if strict:
        _refuse_collisions(plan)
    manifest = materialize(plan["manifest"])
    chosen = manifest.select("file_name", F.col("source_file").alias("path"))
    files = read_contents(chosen.repartition(4 * chosen.sparkSession.sparkContext.defaultParallelism), under=under)
    files.select("file_name", "content").write.mode("overwrite").parquet(out_dir)
    return manifest


def write_bundle_record(manifest: DataFrame, out_dir: str, record_id: str = "bundle") -> DataFrame:
    """The bundle's own list, ``<out_dir>/includes`` (a base name a line, in
    include order), and its Record under ``<out_dir>/record``, for files
    written to ``<out_dir>/files``.  Returns ``(record_id, n_entries, digest)``."""
    out = out_dir.rstrip("/")
    manifest.orderBy("entry_pos").select("file_name").write.mode("overwrite").text(f"{out}/includes")
    entries = manifest.select(F.lit(record_id).alias("record_id"), "entry_pos",
                              F.concat(F.lit(f"{out}/files/"), F.col("file_name")).alias("file"), "data_digest")
    records = build_records(entries)
    write_records(entries, records, f"{out}/record")
    return records
