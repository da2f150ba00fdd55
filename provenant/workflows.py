"""End-to-end jobs as a user of the reference runs them: make Records from
includes lists, verify Records against the files present now, compare two
Records, bundle files.  Each is a composition of the DataFrame operators;
nothing here reads data on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import compare as C
from provenant.operators import records as R
from provenant.operators.numbering import number_rows
from provenant.operators.skew import hot_split_join
from provenant.session import materialize
from provenant.sources import bundle as B
from provenant.sources import files as FS
from provenant.sources import records as RS
from provenant.sources.file_digests import file_digests


def record(spark: SparkSession, includes: str, out_dir: str, algorithm: str = "blake3",
           record_id: str | None = None, listing: str = "includes") -> DataFrame:
    """Lists of files -> Records under ``out_dir``: one Record per list, named
    after it, unless ``record_id`` is given.  ``listing`` tells what a list
    is: an ``includes`` file, or a path list of ``lines`` or ``nul``-separated.
    Files are digested in pieces on the executors; a listed file that is
    missing fails the job, and so does a list without files.  Returns
    ``(record_id, n_entries, digest)``."""
    if listing == "includes":
        inc = FS.scan_includes(spark, includes).select("source_file", "entry_pos", "full_path")
    elif listing in ("lines", "nul"):
        inc = FS.scan_path_list(spark, includes, "\n" if listing == "lines" else "\0").where("path != ''")
        folder = F.regexp_replace("source_file", r"/[^/]*$", "")
        inc = inc.select("source_file", "entry_pos", FS.complete_path("path", folder).alias("full_path"))
    else:
        raise ValueError(f"unknown listing {listing!r}: includes, lines or nul")
    rid = F.lit(record_id) if record_id else F.regexp_extract("source_file", r"([^/]+?)(\.[^./]*)?$", 1)
    inc = materialize(inc.select("source_file", rid.alias("record_id"), "entry_pos", F.col("full_path").alias("file")))
    # a list of blanks and comments only leaves no row: its file is still listed
    empty = FS.listed_files(spark, includes).join(inc.select("source_file").distinct(), "source_file", "left_anti").limit(5).collect()
    if empty or inc.isEmpty():
        raise ValueError(f"no files to record in {sorted(r[0] for r in empty) or includes}")
    if record_id:  # several lists make one Record: numbered through
        inc = number_rows(inc.withColumnRenamed("entry_pos", "_pos"), ["source_file", "_pos"], out="entry_pos")
    entries = materialize(R.build_record_entries_from_files(inc.select("record_id", "entry_pos", "file"), strict=True, algorithm=algorithm))
    records = R.build_records(entries, algorithm=algorithm)
    RS.write_records(entries, records, out_dir, digest_algorithm="BLAKE3" if algorithm == "blake3" else "SHA-256")
    return records


def verify(spark: SparkSession, records: str, algorithm: str | None = None) -> dict[str, DataFrame]:
    """Record documents -> per-entry and per-Record verification with
    counts, and the one-line report; all Records in one job.  The digest
    algorithm is the one the Records' metadata name, unless given."""
    scanned = RS.scan_records(spark, records)
    if algorithm is None:
        algorithm = _algorithm(scanned["records"])
    recs = scanned["records"].select(F.col("record_path").alias("record_id"), "digest")
    entries = scanned["entries"].select(F.col("record_path").alias("record_id"), "entry_pos",
                                        F.col("full_path").alias("file"), "data_digest")
    present = file_digests(entries.select(F.col("file").alias("path")), algorithm).select(
        F.col("path").alias("file"), F.col("data_digest").alias("present_digest"))
    j = hot_split_join(entries, present, "file", "left")
    status = (
        F.when(F.col("present_digest").isNull(), F.lit(R.MISSING))
        .when(F.col("present_digest") == F.col("data_digest"), F.lit(R.VERIFIED))
        .otherwise(F.lit(R.FAILED))
    )
    checked = j.select("record_id", "entry_pos", "file", status.alias("status"),
                       F.col("data_digest").alias("expected"), F.col("present_digest").alias("actual"))
    checked = materialize(checked)
    verified = R.verify_record(checked, recs, algorithm=algorithm)
    return {"entries": checked, "records": verified.join(R.verify_summary(checked), "record_id", "left"),
            "report": R.report_verify_compact(verified)}


def _algorithm(records: DataFrame) -> str:
    """The one digest algorithm that the Records' metadata name."""
    known = {"BLAKE3": "blake3", "SHA-256": "sha256"}
    named = [r[0] for r in records.select("metadata.digest_algorithm").distinct().limit(3).collect()]
    if len(named) != 1 or named[0] not in known:
        raise ValueError(f"Records name the digest algorithms {named}; verify them apart, with algorithm=")
    return known[named[0]]


def compare(spark: SparkSession, record_1: str, record_2: str) -> dict[str, DataFrame]:
    """Two Records, or two folders of Records -> diff (same / changed /
    undetermined), summary and numbered report rows with labels.  The entries
    of a folder's Records are numbered through, Record by Record."""
    def entries(location: str) -> DataFrame:
        rows = RS.scan_records(spark, location)["entries"].withColumnRenamed("entry_pos", "pos_in_record")
        return number_rows(rows, ["record_path", "pos_in_record"], out="entry_pos")

    diff = C.record_diff(entries(record_1), entries(record_2))
    return {"diff": diff, "summary": C.diff_summary(diff), "report": C.diff_labels(C.diff_report_rows(diff))}


def bundle(spark: SparkSession, includes: str, contents: str, out_dir: str) -> DataFrame:
    """Files listed in includes file(s), found under ``contents``, gathered
    flat by base name into a dataset under ``out_dir/files``, with the
    bundle's own list and Record beside it; equal base names and missing
    files fail.  Returns the manifest."""
    inc = FS.scan_includes(spark, includes).select("entry_pos", F.col("full_path").alias("file"))
    out = out_dir.rstrip("/")
    manifest = B.write_bundle_files(inc, out + "/files", under=contents)
    B.write_bundle_record(manifest, out)
    return manifest
