"""Record source and sink (#5, #8), for Records of any size.

Layout of one Record document::

    {"metadata": {"record_format": 1, "generated_by": ..., "library_version": ...,
                  "digest_algorithm": ..., "generated_at_utc": ..., "meta_digest": ...},
     "record_entries": [{"file": "...", "data_digest": "<64 hex>"}, ...],
     "digest": "<64 hex>"}

Relative entry paths are relative to the folder holding the Record.

A document is one JSON value, read by one task into one row.  A Record of more
than ``INLINE_ENTRIES`` entries is therefore kept in parts: its document (the
head) has ``n_entries`` and ``part_entries`` in place of ``record_entries``,
and beside it lie the parts, ``part=<k>/``, each a file of JSON lines with the
entries of positions ``k * part_entries`` up to the next part::

    out/record_id=run/part-....json                 the head
    out/record_id=run/part=0/part-....txt           {"entry_pos": 0, "file": ..., "data_digest": ...}

Parts are written before heads, so a Record whose head is there is whole; a
scan counts the entries against the head, so a lost or doubled part fails.
Parts are many small files: tasks write, list and read them (see
:mod:`provenant.sources.files`), and the driver names none.
"""

from __future__ import annotations

import datetime as _dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant import __version__
from provenant.functions.digests import metadata_digest
from provenant.functions.paths import join_dir, path_relativize, path_resolve
from provenant.operators.numbering import number_rows
from provenant.session import materialize
from provenant.sources.files import dealt, list_files, read_contents, read_lines, write_files

RECORD_SCHEMA = (
    "metadata struct<record_format:bigint, generated_by:string, library_version:string, "
    "digest_algorithm:string, generated_at_utc:string, meta_digest:string>, "
    "record_entries array<struct<file:string, data_digest:string>>, digest string, "
    "n_entries bigint, part_entries bigint"
)
_UNSAFE = re.compile("[\x00-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
PART_SCHEMA = "entry_pos bigint, file string, data_digest string"
RECORD_FORMAT = 1
HEX64 = r"^[0-9a-fA-F]{64}$"
#: a Record of up to this many entries is one JSON document
INLINE_ENTRIES = 100_000
#: entries of one part of a larger Record (about 15 MB of JSON)
PART_ENTRIES = 100_000
_PART_FILE = r"/part=[0-9]+/[^/]*$"


def scan_records(spark: SparkSession, location: str, strict: bool = True) -> dict[str, DataFrame]:
    """#5: Record documents to ``records`` and ``entries`` frames.

    ``entries``: ``(record_path, entry_pos, file, data_digest, full_path)``;
    a relative ``file`` gets the Record's folder as base, and '..' is resolved,
    so ``full_path`` joins with listed contents.  ``record_path`` is the
    document, or the folder of a Record kept in parts.  Every digest, the
    Record's own included, must be exactly 64 hex characters (an entry without
    ``data_digest`` -- an older layout -- fails too), and a document must have
    entries; ``strict`` fails the job, otherwise the column ``digest_ok`` tells.
    ``strict`` also counts the entries of Records kept in parts.
    """
    files = list_files(spark, location).where("size > 0")
    is_part = F.col("path").rlike(_PART_FILE)
    docs = read_contents(dealt(files.where(~is_part), "size").select("path"))
    text = F.col("content").cast("string")
    # a document may be an array of Records
    many = F.from_json(text, f"array<struct<{RECORD_SCHEMA}>>")
    raw = docs.select("path", F.explode(F.when(text.rlike(r"^\s*\["), many).otherwise(F.array(F.from_json(text, RECORD_SCHEMA)))).alias("r"))
    raw = (
        raw.select("path", "r.*")
        .withColumnRenamed("path", "record_path")
        .withColumn("record_dir", F.regexp_replace("record_path", r"/[^/]*$", ""))
        .withColumn("record_path", F.when(F.col("part_entries").isNull(), F.col("record_path")).otherwise(F.col("record_dir")))
    )
    raw = materialize(raw)  # each document is read once
    parts = files.where(is_part)
    lines = None
    if not parts.isEmpty():
        parts = dealt(parts, "size").select("path", F.regexp_replace("path", _PART_FILE, "").alias("record_path"))
        read = read_lines(parts).select("record_path", F.from_json("value", PART_SCHEMA).alias("p"))
        lines = materialize(read.select("record_path", F.col("record_path").alias("record_dir"), "p.entry_pos",
                                        F.struct("p.file", "p.data_digest").alias("e")))
    inline = raw.where("part_entries is null").select(
        "record_path", "record_dir", F.posexplode("record_entries").alias("entry_pos", "e"))
    ent = inline.withColumn("entry_pos", F.col("entry_pos").cast("bigint"))
    if lines is None:
        lines = ent.limit(0)
    ent = ent.unionByName(lines)

    ok = F.coalesce(F.col("e.data_digest").rlike(HEX64), F.lit(False))
    digest = F.lower(F.col("e.data_digest"))
    own = F.col("digest")
    n = F.coalesce(F.size(F.col("record_entries")).cast("bigint"), F.lit(-1))
    n = F.when(F.col("part_entries").isNull(), F.when(n >= 0, n)).otherwise(F.col("n_entries"))
    if strict:
        # inside the values, so that column pruning cannot drop the check
        bad = lambda what: F.raise_error(F.concat(F.lit(f"bad {what} in "), F.col("record_path")))
        digest = F.when(ok, digest).otherwise(bad("data_digest").cast("string"))
        own = F.when(F.coalesce(own.rlike(HEX64), F.lit(False)), own).otherwise(bad("digest").cast("string"))
        n = F.coalesce(n, bad("record_entries").cast("bigint"))
    records = raw.select(
        "record_path",
        "record_dir",
        F.regexp_extract(F.concat("record_dir", F.lit("/")), r"record_id=([^/]+)/", 1).alias("record_id"),
        n.alias("n_entries"),
        own.alias("digest"),
        "metadata",
        "part_entries",
    )
    if strict:
        _check_parts(records, lines)
    file = F.col("e.file")
    entries = ent.select(
        "record_path",
        "entry_pos",
        file.alias("file"),
        digest.alias("data_digest"),
        path_resolve(F.when(file.startswith("/"), file).otherwise(join_dir(F.col("record_dir"), file))).alias("full_path"),
        ok.alias("digest_ok"),
    )
    return {"records": records.drop("part_entries"), "entries": entries}


def _check_parts(records: DataFrame, lines: DataFrame) -> None:
    """The parts of a Record hold each position from 0 to its last once, as
    far as counts per part tell (one small row a part)."""
    heads = records.where("part_entries is not null").select("record_path", "n_entries", "part_entries")
    if heads.isEmpty():
        return
    size = heads.select(F.col("record_path"), "n_entries", "part_entries")
    per_part = lines.join(F.broadcast(size), "record_path").groupBy(
        "record_path", F.floor(F.col("entry_pos") / F.col("part_entries")).alias("part")).agg(
        F.count("*").alias("c"), F.min("entry_pos").alias("low"), F.max("entry_pos").alias("high"))
    found = per_part.groupBy("record_path").agg(
        F.sum("c").alias("found"), F.count_if(F.col("c") != F.col("high") - F.col("low") + 1).alias("uneven"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    wrong = heads.join(found, "record_path", "left").where(
        F.col("found").isNull() | (F.col("found") != F.col("n_entries")) | (F.col("uneven") > 0)
        | (F.col("low") != 0) | (F.col("high") != F.col("n_entries") - 1)).select("record_path").limit(5).collect()
    if wrong:
        raise ValueError(f"bad parts: entries lost or doubled in {sorted(r[0] for r in wrong)}")


def _record_metadata(generated_by: str, digest_algorithm: str, generated_at_utc: str | None) -> Column:
    when = generated_at_utc or _dt.datetime.now(_dt.timezone.utc).isoformat()
    return F.struct(
        F.lit(RECORD_FORMAT).cast("bigint").alias("record_format"),
        F.lit(generated_by).alias("generated_by"),
        F.lit(__version__).alias("library_version"),
        F.lit(digest_algorithm).alias("digest_algorithm"),
        F.lit(when).alias("generated_at_utc"),
        metadata_digest(F.lit(RECORD_FORMAT), F.lit(generated_by), F.lit(__version__), F.lit(digest_algorithm),
                        F.lit(when)).alias("meta_digest"),
    )


def _rebased(entries: DataFrame, out_dir: str) -> DataFrame:
    folder = F.concat(F.lit(out_dir.rstrip("/") + "/record_id="), F.col("record_id"))
    return entries.withColumn("file", path_relativize(F.col("file"), folder))


def record_documents(entries: DataFrame, records: DataFrame, out_dir: str,
                     generated_by: str = "provenant", digest_algorithm: str = "SHA-256",
                     generated_at_utc: str | None = None) -> DataFrame:
    """One row per Record in the JSON layout, entry paths re-based on the
    Record's own folder ``<out_dir>/record_id=<id>``.  A Record is one
    document, so its entries are gathered into one row: larger Records than
    ``INLINE_ENTRIES`` are for :func:`write_records`, which keeps them in parts."""
    lists = _rebased(entries, out_dir).groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("entry_pos", "file", "data_digest"))).alias("_es")
    )
    return lists.join(records.select("record_id", "digest"), "record_id").select(
        "record_id",
        _record_metadata(generated_by, digest_algorithm, generated_at_utc).alias("metadata"),
        F.transform("_es", lambda x: F.struct(x["file"].alias("file"), x["data_digest"].alias("data_digest")))
        .alias("record_entries"),
        "digest",
    )


def write_records(entries: DataFrame, records: DataFrame, out_dir: str, generated_by: str = "provenant",
                  digest_algorithm: str = "SHA-256", generated_at_utc: str | None = None,
                  inline_entries: int = INLINE_ENTRIES, part_entries: int = PART_ENTRIES) -> None:
    """#8: write Records, one folder each: a document, or for more than
    ``inline_entries`` entries a head and its parts (see the module's text).

    Parts are dealt to tasks by (Record, part), so the entries of one huge
    Record are sorted and written by many tasks, ``part_entries`` at a time."""
    about = dict(generated_by=generated_by, digest_algorithm=digest_algorithm, generated_at_utc=generated_at_utc)
    # at most total / inline_entries Records
    large = records.where(F.col("n_entries") > inline_entries).select("record_id").persist()
    try:
        if large.isEmpty():
            docs = record_documents(entries, records, out_dir, **about)
            docs.write.mode("overwrite").partitionBy("record_id").json(out_dir)
            return
        big = F.broadcast(large)
        own = _dense_positions(entries.join(big, "record_id", "left_semi"))
        part = F.floor(F.col("entry_pos") / part_entries)
        lines = _rebased(own, out_dir).select(
            "record_id", part.alias("part"), "entry_pos",
            F.to_json(F.struct("entry_pos", "file", "data_digest")).alias("value"))
        # Spark clears the folder; the tasks that hold the parts write them
        entries.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(out_dir)
        lines = lines.repartition("record_id", "part").sortWithinPartitions("record_id", "part", "entry_pos")
        name = F.concat(F.lit("record_id="), _folder_name("record_id"), F.lit("/part="), F.col("part"), F.lit("/part-00000.txt"))
        write_files(lines.select(name.alias("name"), "value"), out_dir, "name", "value")
        docs = record_documents(entries.join(big, "record_id", "left_anti"), records, out_dir, **about)
        docs.write.mode("append").partitionBy("record_id").json(out_dir)
        heads = records.join(big, "record_id", "left_semi").select(
            "record_id", _record_metadata(**about).alias("metadata"), "digest", "n_entries", F.lit(part_entries).cast("bigint").alias("part_entries"))
        heads.write.mode("append").partitionBy("record_id").json(out_dir)
    finally:
        large.unpersist(blocking=False)


def _folder_name(column: str):
    """A value as the folder name that ``partitionBy`` gives it."""

    def escape(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__")

    return F.pandas_udf(escape, "string")(column)


def _dense_positions(entries: DataFrame) -> DataFrame:
    """Positions 0, 1, ... in each Record, as a document's order gives them."""
    ends = entries.groupBy("record_id").agg(F.count("*").alias("c"), F.min("entry_pos").alias("low"), F.max("entry_pos").alias("high"),
                                            F.sum(F.col("entry_pos").cast("decimal(38,0)")).alias("s"))
    gaps = (F.col("low") != 0) | (F.col("high") != F.col("c") - 1) | (2 * F.col("s") != F.col("c").cast("decimal(19,0)") * (F.col("c") - 1))
    if ends.where(gaps).isEmpty():
        return entries
    return number_rows(entries, ["entry_pos"], ["record_id"], out="_at").withColumn("entry_pos", F.col("_at")).drop("_at")
