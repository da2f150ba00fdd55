"""Records (#23, #28-#35): build, roll up, verify and report.

Tables:

* includes  ``(record_id, entry_pos, file)`` -- what a Record lists, in order;
* contents  ``(path, content)``               -- the bytes present now (a
  ``binaryFile`` scan or any table with a STRING/BINARY column);
* entries   ``(record_id, entry_pos, file, data_digest)``;
* records   ``(record_id, n_entries, digest)``.

Contents are reduced to ``(path, digest)`` *before* any join, so shuffles
carry 64-character digests, never file bytes.  A path listed by very many
Records is a hot join key on the includes side only (the digest side has
one row per path): such keys are split off and joined by a bounded
broadcast (:mod:`provenant.operators.skew`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions.digests import compact_hex, content_digest
from provenant.operators.numbering import number_rows
from provenant.operators.skew import hot_split_join
from provenant.session import cut_lineage

# Groups up to this size are rolled up in one expression, larger ones by a
# stream over their sorted entries; both give the same value.
GROUP_IN_ROW = 1024

VERIFIED, FAILED, MISSING = "VERIFIED", "FAILED", "MISSING"


def present_digests(contents: DataFrame, path_col: str = "path", content_col: str = "content",
                    algorithm: str = "sha256") -> DataFrame:
    """``(file, present_digest)``: contents reduced to digests at the scan."""
    return contents.select(
        F.col(path_col).alias("file"),
        content_digest(content_col, algorithm=algorithm).alias("present_digest"),
    )


def build_record_entries(includes: DataFrame, contents: DataFrame, strict: bool = True,
                         algorithm: str = "sha256") -> DataFrame:
    """#28 entries: digest each listed file; order and repeats kept.

    ``strict``: a listed file that is not present fails the job (the
    reference's behaviour); otherwise its digest is null.
    """
    j = hot_split_join(includes, present_digests(contents, algorithm=algorithm), "file", "left")
    digest = F.col("present_digest")
    if strict:
        digest = F.when(digest.isNull(), F.raise_error(F.concat(F.lit("missing file: "), F.col("file")))).otherwise(
            digest
        )
    return j.select("record_id", "entry_pos", "file", digest.alias("data_digest"))


def build_record_entries_from_files(includes: DataFrame, strict: bool = True, algorithm: str = "sha256",
                                    path_col: str = "file") -> DataFrame:
    """#28 entries for files of any size: the listed files are digested in
    pieces on the executors (see :mod:`provenant.sources.file_digests`)
    instead of being loaded whole.  ``path_col`` holds the usable path."""
    from provenant.sources.file_digests import file_digests

    found = file_digests(includes.select(F.col(path_col).alias("path")), algorithm)
    j = hot_split_join(includes, found.select(F.col("path").alias(path_col), "data_digest"), path_col, "left")
    digest = F.col("data_digest")
    if strict:
        digest = F.when(digest.isNull(), F.raise_error(F.concat(F.lit("missing file: "), F.col(path_col)))).otherwise(
            digest)
    return j.select("record_id", "entry_pos", "file", digest.alias("data_digest"))


def _flat_rollup(entries: DataFrame, group_cols: list[str], order_col: str, digest_col: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(digest_col).alias("d"))))
    return entries.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count(digest_col).alias("_n_digests"),
        F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["d"]), "")), 256).alias("digest"),
    )


def _streamed_rollup(entries: DataFrame, g: list[str], order_col: str, digest_col: str) -> DataFrame:
    """The same value for groups of any size: a group's entries pass one task
    in order, which holds only the hash state."""
    rows = entries.select(*g, order_col, digest_col).repartition(*g).sortWithinPartitions(
        *g, order_col, F.col(digest_col).asc_nulls_last())
    schema = T.StructType([*(rows.schema[c] for c in g), T.StructField("n_entries", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches):
        import hashlib

        import pyarrow as pa

        key, state, n, whole, out = None, None, 0, True, []

        def close():
            if state is not None:
                out.append((*key, n, state.hexdigest() if whole else None))

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in g]
            cols = [batch.column(c).to_pylist() for c in g]
            for *k, d in zip(*cols, batch.column(digest_col).to_pylist()):
                if state is None or k != key:
                    close()
                    key, state, n, whole = k, hashlib.sha256(), 0, True
                n += 1
                if d is None:
                    whole = False
                else:
                    state.update(bytes.fromhex(d))
        close()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [*kinds, pa.int64(), pa.string()])], names=[*g, "n_entries", "digest"])

    return rows.mapInArrow(run, schema)


def rollup_digest(entries: DataFrame, group_cols: Sequence[str] = ("record_id",),
                  order_col: str = "entry_pos", digest_col: str = "data_digest",
                  fanout: int | None = None) -> DataFrame:
    """#23: one digest per group over its child digests in ``order_col`` order.

    SHA-256 of the concatenated raw digests, for groups of every size.  Only
    if a ``fanout`` is asked for, the digest is a tree: the rule applied to
    consecutive blocks of ``fanout`` entries, then to blocks of those digests,
    up to one root (groups of at most ``fanout`` entries have the flat value).
    A null child digest makes the group's digest null.
    Returns ``(*group_cols, n_entries, digest)``.
    """
    g = list(group_cols)
    sizes = entries.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    max_n = sizes.agg(F.max("_n")).first()[0] or 0
    if max_n <= (fanout or GROUP_IN_ROW):
        flat = _flat_rollup(entries, g, order_col, digest_col)
        return flat.select(*g, "n_entries", F.when(F.col("_n_digests") == F.col("n_entries"), F.col("digest")).alias("digest"))
    if fanout is None:
        return _streamed_rollup(entries, g, order_col, digest_col)

    ranked = number_rows(entries.select(*g, order_col, digest_col), [F.col(order_col)], g, out="_idx", count_out="_n")
    levels, cap = 1, fanout
    while cap < max_n:
        cap, levels = cap * fanout, levels + 1

    def level(todo: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col("_idx").alias("o"), F.col("_d").alias("d"))))
        return (
            todo.groupBy(*g, F.floor(F.col("_idx") / fanout).alias("_blk"))
            .agg(
                F.any_value("_n").alias("_n"),
                F.any_value("_m").alias("_m_prev"),
                F.count("_d").alias("_cnt_d"),
                F.count(F.lit(1)).alias("_cnt"),
                F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["d"]), "")), 256).alias("_d"),
            )
            .select(
                *g,
                F.col("_blk").alias("_idx"),
                F.when(F.col("_cnt_d") == F.col("_cnt"), F.col("_d")).alias("_d"),
                "_n",
                F.ceil(F.col("_m_prev") / fanout).alias("_m"),
            )
        )

    nodes = level(ranked.select(*g, "_idx", F.col(digest_col).alias("_d"), "_n", F.col("_n").alias("_m")))
    finals = []
    for _ in range(levels - 1):
        finals.append(nodes.where(F.col("_m") <= 1))
        nodes = level(nodes.where(F.col("_m") > 1))
    finals.append(nodes.where(F.col("_m") <= 1))
    out = finals[0]
    for f in finals[1:]:
        out = out.unionByName(f)
    return out.select(*g, F.col("_n").alias("n_entries"), F.col("_d").alias("digest"))


DIGESTS_PER_CHUNK = 32  # 32-byte digests per 1024-byte BLAKE3 chunk
MERGE_BLOCK = 1024      # tree nodes merged per group and level (10 binary levels)


def rollup_digest_blake3(entries: DataFrame, group_cols: Sequence[str] = ("record_id",),
                         order_col: str = "entry_pos", digest_col: str = "data_digest") -> DataFrame:
    """#23 with BLAKE3, exactly the reference's roll-up for any size.

    BLAKE3 is itself a tree over 1024-byte chunks, so the digest of the
    concatenated child digests is built by Spark: chunk values per 32
    consecutive entries (``groupBy``), then aligned blocks of nodes merged
    level by level until one root per group.  No group ever holds more than
    32 digests or ``MERGE_BLOCK`` nodes.  A null child digest gives null.
    """
    from provenant.functions.blake3 import chunk_cv_udf

    g = list(group_cols)
    ranked = number_rows(entries.select(*g, order_col, digest_col), [F.col(order_col)], g,
                         out="_idx", count_out="_n")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_idx").alias("o"), F.col(digest_col).alias("d"))))
    chunks = ranked.groupBy(*g, F.floor(F.col("_idx") / DIGESTS_PER_CHUNK).alias("_blk")).agg(
        F.any_value("_n").alias("_n"),
        (F.count(digest_col) == F.count(F.lit(1))).alias("_full"),
        F.unhex(F.array_join(F.transform(ordered, lambda x: x["d"]), "")).alias("_bytes"),
    )
    n_chunks = F.ceil(F.col("_n") / DIGESTS_PER_CHUNK)
    nodes = chunks.select(
        *g,
        F.col("_blk").alias("_idx"),
        n_chunks.alias("_m"),
        F.col("_n"),
        chunk_cv_udf(F.when(F.col("_full"), F.col("_bytes")), F.col("_blk"), n_chunks == 1).alias("_cv"),
    )
    out = blake3_tree_merge(nodes, g)
    return out.select(*g, F.col("_n").alias("n_entries"), F.col("_cv").alias("digest"))


def blake3_tree_merge(nodes: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Merge BLAKE3 tree nodes to one root per group.

    ``nodes``: ``(*group_cols, _idx, _m, _n, _cv)`` -- node position, number
    of nodes of the group at this level, a carried value, node value (hex).
    Aligned blocks of ``MERGE_BLOCK`` nodes are merged per level (the
    left-balanced tree of the BLAKE3 specification); groups already at one
    node pass through.  Returns ``(*group_cols, _n, _cv)``.
    """
    from provenant.functions.blake3 import merge_udf

    g = list(group_cols)
    nodes = cut_lineage(nodes)
    max_m = nodes.agg(F.max("_m")).first()[0] or 1
    finals = [nodes.where(F.col("_m") <= 1)]
    todo = nodes.where(F.col("_m") > 1)
    while max_m > 1:
        ordered = F.array_sort(F.collect_list(F.struct(F.col("_idx").alias("o"), F.col("_cv").alias("c"))))
        merged = todo.groupBy(*g, F.floor(F.col("_idx") / MERGE_BLOCK).alias("_blk")).agg(
            F.any_value("_m").alias("_m_prev"), F.any_value("_n").alias("_n"),
            F.transform(ordered, lambda x: x["c"]).alias("_cvs"),
        )
        final = F.col("_m_prev") <= MERGE_BLOCK
        todo = merged.select(
            *g, F.col("_blk").alias("_idx"), F.ceil(F.col("_m_prev") / MERGE_BLOCK).alias("_m"), "_n",
            merge_udf(F.col("_cvs"), final).alias("_cv"),
        )
        max_m = -(-max_m // MERGE_BLOCK)
        if max_m > 1:
            todo = cut_lineage(todo)
            finals.append(todo.where(F.col("_m") <= 1))
            todo = todo.where(F.col("_m") > 1)
        else:
            finals.append(todo)
    out = finals[0].select(*g, "_n", "_cv")
    for f in finals[1:]:
        out = out.unionByName(f.select(*g, "_n", "_cv"))
    return out


def rollup(entries: DataFrame, group_cols: Sequence[str] = ("record_id",), order_col: str = "entry_pos",
           digest_col: str = "data_digest", algorithm: str = "sha256", fanout: int | None = None) -> DataFrame:
    """Roll-up with the Record's digest algorithm (see the two functions)."""
    if algorithm == "blake3":
        return rollup_digest_blake3(entries, group_cols, order_col, digest_col)
    return rollup_digest(entries, group_cols, order_col, digest_col, fanout)


def build_records(entries: DataFrame, fanout: int | None = None, algorithm: str = "sha256") -> DataFrame:
    """#28: ``(record_id, n_entries, digest)`` from hashed entries."""
    return rollup(entries, ("record_id",), "entry_pos", "data_digest", algorithm, fanout)


def recalculate_record(entries: DataFrame, contents: DataFrame, strict: bool = False,
                       algorithm: str = "sha256") -> DataFrame:
    """#29 entries: the paths of an old Record, digested again from ``contents``."""
    includes = entries.select("record_id", "entry_pos", "file")
    return build_record_entries(includes, contents, strict=strict, algorithm=algorithm)


def verify_entries(entries: DataFrame, contents: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """#30: stored digest vs. the present one, per entry.

    ``status`` is VERIFIED / FAILED, or MISSING where the file is absent
    (the reference stops there; here the rest of the job goes on).
    """
    j = hot_split_join(entries, present_digests(contents, algorithm=algorithm), "file", "left")
    status = (
        F.when(F.col("present_digest").isNull(), F.lit(MISSING))
        .when(F.col("present_digest") == F.col("data_digest"), F.lit(VERIFIED))
        .otherwise(F.lit(FAILED))
    )
    return j.select(
        "record_id", "entry_pos", "file", status.alias("status"),
        F.col("data_digest").alias("expected"), F.col("present_digest").alias("actual"),
    )


def verify_record(checked: DataFrame, records: DataFrame, fanout: int | None = None,
                  algorithm: str = "sha256") -> DataFrame:
    """#31: roll up the *present* digests and compare with the stored Record
    digest.  A Record with a missing entry cannot be rolled up: MISSING."""
    new = rollup(checked, ("record_id",), "entry_pos", "actual", algorithm, fanout)
    j = records.select("record_id", F.col("digest").alias("expected")).join(
        new.select("record_id", F.col("digest").alias("actual")), "record_id", "left"
    )
    status = (
        F.when(F.col("actual").isNull(), F.lit(MISSING))
        .when(F.col("actual") == F.col("expected"), F.lit(VERIFIED))
        .otherwise(F.lit(FAILED))
    )
    return j.select("record_id", status.alias("status"), "expected", "actual")


def verify_summary(checked: DataFrame) -> DataFrame:
    """#32: per Record the verified, failed, missing and total entry counts."""
    return checked.groupBy("record_id").agg(
        F.count_if(F.col("status") == VERIFIED).alias("n_verified"),
        F.count_if(F.col("status") == FAILED).alias("n_failed"),
        F.count_if(F.col("status") == MISSING).alias("n_missing"),
        F.count(F.lit(1)).alias("n_total"),
    )


def verify_many(checked: DataFrame, records: DataFrame, fanout: int | None = None,
                algorithm: str = "sha256") -> DataFrame:
    """#33: all Records in one job, one line each: status plus counts."""
    return verify_record(checked, records, fanout, algorithm).join(verify_summary(checked), "record_id", "left")


def report_verify_compact(verified_records: DataFrame, label: Column | str = "record_id") -> DataFrame:
    """#34: one line per Record: label cut/padded to 32, then
    ``VERIFIED <compact 32>`` or ``FAILED   <compact 14> -> <compact 14>``."""
    lab = F.col(label) if isinstance(label, str) else label
    lab32 = F.rpad(F.substring(lab, 1, 32), 32, " ")
    ok = F.concat(F.lit("VERIFIED "), F.rpad(compact_hex("actual", 32), 32, " "))
    bad = F.concat(
        F.lit("FAILED   "),
        F.rpad(compact_hex("expected", 14), 14, " "),
        F.lit(" -> "),
        F.rpad(F.coalesce(compact_hex("actual", 14), F.lit("")), 14, " "),
    )
    text = F.concat(lab32, F.lit(" "), F.when(F.col("status") == VERIFIED, ok).otherwise(bad))
    return verified_records.select("record_id", "status", text.alias("line"))


def verify_report_rows(checked: DataFrame, verified_records: DataFrame) -> DataFrame:
    """#35: per entry in Record order: file, status, expected, actual,
    beside the Record's own status, expected and actual."""
    rows = number_rows(checked, [F.col("entry_pos")], ["record_id"], out="row_num")
    rec = verified_records.select(
        "record_id",
        F.col("status").alias("record_status"),
        F.col("expected").alias("record_expected"),
        F.col("actual").alias("record_actual"),
    )
    return hot_split_join(rows, rec, "record_id", "left").select(
        "record_id", "row_num", "file", "status", "expected", "actual",
        "record_status", "record_expected", "record_actual",
    )
