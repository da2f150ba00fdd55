"""Registered queries for sources and sinks (#1-#9).

File-based readers need files: each query first writes data Spark derives
from the driver's tables into a fresh folder under the session's checkpoint
directory (a shared folder on a cluster), then scans it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from provenant.functions.paths import file_name
from provenant.operators import records as R
from provenant.operators import study as ST
from provenant.operators.skew import hot_split_join
from provenant.plans.fixtures import (
    SQL_RECORD_ENTRIES,
    SQL_SNAPSHOT_ALL,
    contents_then,
    record_includes,
    snapshot_all,
    sql_file_name,
    sql_rollup,
    table,
)
from provenant.plans.registry import register
from provenant.plans.study_fixtures import markers, study_model
from provenant.plans.study_sql import STUDY_CTE
from provenant.session import ensure_checkpoint_dir
from provenant.sources import bundle as B
from provenant.sources import design as DS
from provenant.sources import file_digests as FD
from provenant.sources import files as FS
from provenant.sources import records as RS


def scratch_dir(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


_INCLUDES_SQL = r"""
with lines as (
  select doc_id, cast(u.ord - 1 as bigint) as line_no,
         regexp_replace(split_part(u.line, '#', 1), '^\s+|\s+$', '', 'g') as file
  from documents, unnest(string_split(text, chr(10))) with ordinality as u(line, ord))
select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as entry_pos, line_no, file
from lines where file <> ''"""


@register("includes_scan", _INCLUDES_SQL)
def q_includes_scan(spark, sf_dir):
    """#2: every line of every document parsed as an includes line."""
    d = table(spark, sf_dir, "documents")
    return FS.includes_from_text(d, "text", "doc_id")


@register("path_list_lines", f"select file as path from ({SQL_SNAPSHOT_ALL})")
def q_path_list_lines(spark, sf_dir):
    """#3: a newline-separated path list written and read back."""
    out = scratch_dir(spark, "paths-nl")
    snapshot_all(spark, sf_dir).select("file").write.text(out)
    return FS.scan_path_list(spark, out, "\n").select("path")


@register("path_list_nul", f"select file as path from ({SQL_SNAPSHOT_ALL})")
def q_path_list_nul(spark, sf_dir):
    """#4: a NUL-separated path list written and read back."""
    out = scratch_dir(spark, "paths-nul")
    snapshot_all(spark, sf_dir).select("file").write.option("lineSep", "\u0000").text(out)
    return FS.scan_path_list(spark, out, "\u0000").select("path")


def _document_files(spark, sf_dir) -> str:
    """One file per document, ``task=<task>/<folder>/doc_id=<id>.txt``; a
    doc_id that comes again in a task goes on in its file."""
    out = scratch_dir(spark, "contents")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").sortWithinPartitions("doc_id")
    name = F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    FS.write_files(docs.select(name.alias("name"), "text"), out, "name", "text", spread=True)
    return out


_DOC_ID = r"/doc_id=(-?\d+|null)\.txt$"


def _doc_id_of(path):
    found = F.regexp_extract(path, _DOC_ID, 1)
    return F.when(found != "null", found).cast("bigint").alias("doc_id")


_DOC_FILE_SQL = """select doc_id, cast(strlen(text) + 1 as bigint) as length,
  sha256(text || chr(10)) as data_digest from documents"""


@register("content_scan", _DOC_FILE_SQL)
def q_content_scan(spark, sf_dir):
    """#1: one file per document written, then every byte of each file
    scanned and digested."""
    out = _document_files(spark, sf_dir)
    found = FS.scan_contents(spark, out, glob="*.txt")
    return found.select(
        _doc_id_of("path"),
        "length",
        F.sha2("content", 256).alias("data_digest"),
    )


def _records_round_trip(spark, sf_dir, **sizes):
    includes = record_includes(spark, sf_dir).withColumn("file", F.concat(F.lit("/data/"), "file"))
    contents = contents_then(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/"), "path"))
    entries = R.build_record_entries(includes, contents)
    out = _local(scratch_dir(spark, "records"))
    RS.write_records(entries, R.build_records(entries), out, generated_at_utc="2026-01-01T00:00:00Z", **sizes)
    return RS.scan_records(spark, out)


_ROLL = sql_rollup(f"({SQL_RECORD_ENTRIES})", "record_id", "entry_pos", "data_digest", None)


@register("record_sink", f"with {_ROLL} select record_id, n_entries, digest from roll")
def q_record_sink(spark, sf_dir):
    """#8: Records written as JSON documents (one folder each), read back."""
    return _records_round_trip(spark, sf_dir)["records"].select("record_id", "n_entries", "digest")


@register("record_scan", f"""select record_id, row_number() over (partition by record_id order by entry_pos) - 1
  as entry_pos, {sql_file_name('file')} as file_name, data_digest, true as digest_ok
from ({SQL_RECORD_ENTRIES})""")
def q_record_scan(spark, sf_dir):
    """#5: Record documents to entries; paths completed with the Record's
    folder, digests checked."""
    rt = _records_round_trip(spark, sf_dir)
    rec = rt["records"].select("record_path", "record_id")
    return hot_split_join(rt["entries"], rec, "record_path").select(
        "record_id", "entry_pos", file_name("full_path").alias("file_name"), "data_digest", "digest_ok")


@register("record_parts", """select record_id, row_number() over (partition by record_id order by entry_pos) - 1
  as entry_pos, '/data/' || file as full_path, data_digest,
  cast(count(*) over (partition by record_id) as bigint) as n_entries
from (""" + SQL_RECORD_ENTRIES + ")")
def q_record_parts(spark, sf_dir):
    """#5/#8 for Records of any size: Records of more than eight entries kept
    as a head and parts of seven, read back with full paths, in order."""
    rt = _records_round_trip(spark, sf_dir, inline_entries=8, part_entries=7)
    rec = rt["records"].select("record_path", "record_id", "n_entries")
    return hot_split_join(rt["entries"], rec, "record_path").select("record_id", "entry_pos", "full_path", "data_digest", "n_entries")


@register("design_scan", """select cast(p_partkey as varchar) as p_partkey, p_brand as brand,
  cast(p_size as varchar) as size, p_type as type from part""")
def q_design_scan(spark, sf_dir):
    """#6: a design CSV (from ``part``) read back: needed columns only, as strings."""
    out = scratch_dir(spark, "design")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
        F.col("p_size").alias("size"), "p_name")
    DS.write_design(p, out)
    return DS.scan_design(spark, out, ["p_partkey", "brand", "size", "type"]).drop("variation_pos")


_BUNDLE = f"""with b as ({SQL_SNAPSHOT_ALL}),
sel as (select entry_pos, file, sha256(content) as data_digest, {sql_file_name('file')} as file_name from b),
counts as (select file_name, count(*) as n_files from sel group by file_name)"""


def _bundle(spark, sf_dir):
    b = snapshot_all(spark, sf_dir)
    return B.bundle_plan(b.select("entry_pos", "file"), b.select(F.col("file").alias("path"), "content"))


@register("bundle_manifest", f"""{_BUNDLE}
select entry_pos, file_name, data_digest, file as source_file from sel
where file_name not in (select file_name from counts where n_files > 1)""")
def q_bundle_manifest(spark, sf_dir):
    """#9: the bundle's entries (files whose base name is unique)."""
    return _bundle(spark, sf_dir)["manifest"]


@register("bundle_collisions", f"{_BUNDLE} select file_name, n_files from counts where n_files > 1")
def q_bundle_collisions(spark, sf_dir):
    """#9: base names that would collide in the flat bundle."""
    return _bundle(spark, sf_dir)["collisions"]


@register("status_scan", f"{STUDY_CTE} select vs_id, marker from markers")
def q_status_scan(spark, sf_dir):
    """#7: the study's status markers written as empty ``status.<state>``
    files in per-VarStep folders by the executors, then found again in the
    run folder, listed by the executors."""
    m = study_model(spark, sf_dir)
    run = scratch_dir(spark, "run")
    vs = ST.varsteps(m["links"])
    FS.write_status_markers(markers(vs), run)
    return FS.scan_status(spark, run)


def _file_digests(spark, sf_dir, algorithm, segment_bytes):
    out = _document_files(spark, sf_dir)
    listed = FS.list_files(spark, out, glob="*.txt").where("size > 0")
    got = FD.file_digests(listed.select("path"), algorithm, segment_bytes)
    return got.select(
        _doc_id_of("path"),
        F.col("size").alias("length"),
        "data_digest",
    )


@register("file_digests", _DOC_FILE_SQL)
def q_file_digests(spark, sf_dir):
    """#18 for files of any size: one file per document, each streamed
    through SHA-256 in pieces on the executors (no whole-file rows)."""
    return _file_digests(spark, sf_dir, "sha256", FD.SEGMENT_BYTES)


@register("file_digests_blake3")
def q_file_digests_blake3(spark, sf_dir):
    """#18 with BLAKE3 for files of any size: files cut into 4 KiB segments
    digested by different tasks and merged through the BLAKE3 tree (exact;
    checked against whole-file BLAKE3 in the tests).  No SQL engine here
    has BLAKE3: rows only."""
    return _file_digests(spark, sf_dir, "blake3", 4096)
