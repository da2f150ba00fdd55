"""Inputs derived from the driver's tables, as Spark plans.

Every registered query reads the given parquet tables (or what Spark derives
from them), so its work grows with the data.  The derivations are the ones in
FIXTURES.md: two snapshots of ``documents`` (+ ``benchmark``) for compare and
verify, Records per ``documents.source``, a design from ``part``, status
markers from VarStep ids and a transition log from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.digests import content_digest

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def snapshot_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot 1: every document as ``docs/<source>/<doc_id>.txt``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("entry_pos"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.col("text").alias("content"),
    )


def snapshot_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot 2: some documents removed, moved, renamed or edited, plus
    the benchmark passages as new files."""
    return _second(spark, sf_dir, table(spark, sf_dir, "documents").where(F.col("doc_id") % 13 != 0))


def snapshot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot 2 without removals: every document and benchmark passage."""
    return _second(spark, sf_dir, table(spark, sf_dir, "documents"))


def _second(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    docs = d.select(
        (F.col("doc_id") * 2).alias("entry_pos"),  # even; new files are odd
        F.concat(
            F.when(F.col("doc_id") % 5 == 0, F.lit("moved/")).otherwise(F.lit("docs/")),
            "source",
            F.lit("/"),
            F.when(F.col("doc_id") % 11 == 0, F.lit("renamed_")).otherwise(F.lit("")),
            F.col("doc_id").cast("string"),
            F.lit(".txt"),
        ).alias("file"),
        F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("content"),
    )
    bench = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") * 2 + 1).alias("entry_pos"),
        F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("file"),
        F.col("text").alias("content"),
    )
    return docs.unionByName(bench)


def hashed(snapshot: DataFrame) -> DataFrame:
    """Entries with their content digest; the content column is dropped."""
    return snapshot.select("entry_pos", "file", content_digest("content").alias("data_digest"))


def entries_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(snapshot_a(spark, sf_dir))


def entries_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(snapshot_b(spark, sf_dir))


# --- SQL text of the same derivations (DuckDB dialect, for the oracle) -----

SQL_SNAPSHOT_A = """
    select doc_id as entry_pos,
           concat('docs/', source, '/', cast(doc_id as varchar), '.txt') as file,
           text as content
    from documents"""

SQL_SNAPSHOT_B = """
    select doc_id * 2 as entry_pos,
           concat(case when doc_id % 5 = 0 then 'moved/' else 'docs/' end, source, '/',
                  case when doc_id % 11 = 0 then 'renamed_' else '' end,
                  cast(doc_id as varchar), '.txt') as file,
           case when doc_id % 7 = 0 then concat(text, ' edited') else text end as content
    from documents where doc_id % 13 <> 0
    union all
    select item_id * 2 + 1, concat('bench/', cast(item_id as varchar), '.txt'), text
    from benchmark"""

SQL_SNAPSHOT_ALL = SQL_SNAPSHOT_B.replace(" where doc_id % 13 <> 0", "")

SQL_ENTRIES_A = f"select entry_pos, file, sha256(content) as data_digest from ({SQL_SNAPSHOT_A})"
SQL_ENTRIES_B = f"select entry_pos, file, sha256(content) as data_digest from ({SQL_SNAPSHOT_B})"


def sql_file_name(expr: str) -> str:
    """DuckDB text of :func:`provenant.functions.paths.file_name`."""
    last = f"list_filter(string_split({expr}, '/'), lambda x: x <> '' and x <> '.')[-1]"
    return f"(case when {last} <> '..' then {last} end)"


# --- Records per documents.source (FIXTURES B) -----------------------------

def record_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, entry_pos, file)``: one Record per source, doc_id order."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("record_id"),
        F.col("doc_id").alias("entry_pos"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
    )


def contents_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` when the Records were made (snapshot 1)."""
    return snapshot_a(spark, sf_dir).select(F.col("file").alias("path"), "content")


def contents_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` present now (snapshot 2)."""
    return snapshot_b(spark, sf_dir).select(F.col("file").alias("path"), "content")


SQL_RECORD_ENTRIES = """
    select source as record_id, doc_id as entry_pos,
           concat('docs/', source, '/', cast(doc_id as varchar), '.txt') as file,
           sha256(text) as data_digest
    from documents"""

SQL_PRESENT_NOW = f"select file, sha256(content) as present_digest from ({SQL_SNAPSHOT_B})"


def sql_rollup(source: str, group: str, order: str, digest: str, fanout: int | None, name: str = "roll",
               levels: int = 3) -> str:
    """DuckDB CTE text ``<name>(group, n_entries, digest)`` for the tree
    roll-up of :func:`provenant.operators.records.rollup_digest` (exact for
    groups up to ``fanout ** levels`` entries); without a fan-out the flat rule."""
    if fanout is None:
        return (f"{name} as (select {group}, count(*) as n_entries, case when count({digest}) = count(*) "
                f"then sha256(unhex(string_agg({digest}, '' order by {order}))) end as digest from {source} group by {group})")
    f = fanout
    parts = [
        f"{name}_0 as (select {group} as g, {digest} as d, "
        f"row_number() over (partition by {group} order by {order}) - 1 as i, "
        f"count(*) over (partition by {group}) as n from {source})"
    ]
    finals = []
    for lv in range(1, levels + 1):
        prev = f"{name}_{lv - 1}"
        where = "" if lv == 1 else f" where n > {f ** (lv - 1)}"
        parts.append(
            f"{name}_{lv} as (select g, i // {f} as i, any_value(n) as n, "
            f"case when count(d) = count(*) then sha256(unhex(string_agg(d, '' order by i))) end as d "
            f"from {prev}{where} group by g, i // {f})"
        )
        finals.append(f"select g, n, d from {name}_{lv} where n <= {f ** lv}")
    parts.append(f"{name} as (select g as {group}, n as n_entries, d as digest from ("
                 + " union all ".join(finals) + "))")
    return ",\n".join(parts)
