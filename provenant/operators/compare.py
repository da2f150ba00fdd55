"""Record comparison (#36-#46): tiered unique-key matching and the diff.

Entries are DataFrames with at least ``entry_pos`` (unique per side),
``file`` (compact path string) and ``data_digest``.  A *tier* is a name and a
key expression over those columns.  Each tier sees only the entries earlier
tiers left unmatched; a pair matches only when its key occurs exactly once on
both sides (1:n, n:m and 1:0 stay unmatched).  Entries whose key is null are
set aside for that tier without an attempt.

Scale notes
-----------
* Uniqueness is found with one ``groupBy(key)`` per tier computing both
  sides' counts and smallest positions: a partial (map-side) aggregate, so a
  key that holds a third of all rows collapses to one buffer per task before
  the shuffle; raw rows are never shuffled by key.
* Both sides live in one frame hash-partitioned once by ``(side,
  entry_pos)`` (uniformly spread); every later join is on that pair, so the
  remaining entries keep their partitioning across tiers and only the
  matched positions move.
* Positions must be unique on each side; repeated ones raise (entries of
  several Records are numbered through by ``workflows.compare``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.paths import file_name
from provenant.operators.numbering import number_rows
from provenant.session import cut_lineage

POS = "entry_pos"
SAME, CHANGED, UNDET_1, UNDET_2 = "same", "changed", "undetermined_1", "undetermined_2"
CLASSES = (SAME, CHANGED, UNDET_1, UNDET_2)

# Tier names as the reference prints them in key labels.
HASH_TIER = "Hash"
FILENAME_TIER = "FileName"

_ATTEMPT = "array<struct<tier:string,key:string>>"


def digest_tier() -> tuple[str, Column]:
    """#38: key = the entry's data digest."""
    return (HASH_TIER, F.col("data_digest"))


def filename_tier() -> tuple[str, Column]:
    """#39: key = base name of the entry's path."""
    return (FILENAME_TIER, file_name("file"))


def default_tiers() -> list[tuple[str, Column]]:
    """Digest first, then file name (the reference's compare)."""
    return [digest_tier(), filename_tier()]


def _prepare(a: DataFrame, b: DataFrame) -> DataFrame:
    # Both sides in one frame, hash-partitioned once by (side, entry_pos) and
    # materialised with a reliable checkpoint (partitioning kept): every tier
    # reads the entries several times, and recomputing them could mean
    # re-reading and re-digesting all contents.  A position names one entry of
    # its side: that is counted here, on rows that lie together already.
    both = a.select(F.lit(1).alias("side"), POS, "file", "data_digest").unionByName(
        b.select(F.lit(2).alias("side"), POS, "file", "data_digest"))
    stored = cut_lineage(
        both.repartition("side", POS)
        .withColumn("attempts", F.array().cast(_ATTEMPT))
        .withColumn("tier_keys", F.array().cast("array<string>"))
    )
    repeated = stored.groupBy("side", POS).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(POS).isNull())
    wrong = repeated.limit(1).collect()
    if wrong:
        raise ValueError(f"entry_pos must name one entry of its side; side {wrong[0]['side']} has {wrong[0]['n']} "
                         f"entries at {wrong[0][POS]}")
    return stored


def group_by_key(entries: DataFrame, key: Column) -> DataFrame:
    """#36: entries grouped by a key; the null-key row counts the ungrouped."""
    return (
        entries.withColumn("group_key", key.cast("string"))
        .groupBy("group_key")
        .agg(F.count(F.lit(1)).alias("n_entries"), F.min(POS).alias("first_pos"))
        .withColumn("grouped", F.col("group_key").isNotNull())
    )


def match_tiers(a: DataFrame, b: DataFrame,
                tiers: Sequence[tuple[str, Column]] | None = None) -> dict[str, DataFrame]:
    """#40: run the tier chain.

    Returns ``matched`` (one row per matched pair, with ``tier``,
    ``tier_idx``, ``match_key``, both sides' fields and side 1's attempt
    trail) and ``rest_1`` / ``rest_2`` (unmatched entries with their own
    trails and per-tier keys).

    Per tier, one aggregation over the key gives both sides' counts and
    smallest positions (map-side combined); a key is a match when it occurs
    once on each side.  The matched positions are joined back on
    ``(side, entry_pos)``, the partitioning the entries already have.
    """
    tiers = list(tiers) if tiers is not None else default_tiers()
    rest = _prepare(a, b)
    matched_parts = []
    side = F.col("side")
    for idx, (name, key) in enumerate(tiers):
        keyed = rest.withColumn("_key", key.cast("string"))
        stats = (
            keyed.where(F.col("_key").isNotNull())
            .groupBy("_key")
            .agg(
                F.count_if(side == 1).alias("_na"),
                F.count_if(side == 2).alias("_nb"),
                F.min(F.when(side == 1, F.col(POS))).alias("_pa"),
                F.min(F.when(side == 2, F.col(POS))).alias("_pb"),
            )
            .where((F.col("_na") == 1) & (F.col("_nb") == 1))
        )
        hits = stats.select(F.lit(1).alias("side"), F.col("_pa").alias(POS), F.col("_pb").alias("_partner")) \
            .unionByName(stats.select(F.lit(2).alias("side"), F.col("_pb").alias(POS), F.col("_pa").alias("_partner")))
        tagged = keyed.join(hits, ["side", POS], "left")
        attempt = F.struct(F.lit(name).alias("tier"), F.col("_key").alias("key"))

        side2 = tagged.where(side == 2).select(
            F.col(POS).alias("_partner"),
            F.col("file").alias("file_2"),
            F.col("data_digest").alias("digest_2"),
        )
        m = tagged.where((side == 1) & F.col("_partner").isNotNull()).join(side2, "_partner").select(
            F.lit(name).alias("tier"),
            F.lit(idx).alias("tier_idx"),
            F.col("_key").alias("match_key"),
            F.col(POS).alias("entry_pos_1"),
            F.col("file").alias("file_1"),
            F.col("data_digest").alias("digest_1"),
            F.col("_partner").alias("entry_pos_2"),
            "file_2",
            "digest_2",
            F.array_append("attempts", attempt).alias("attempts"),
        )
        matched_parts.append(m)
        rest = tagged.where(F.col("_partner").isNull()).select(
            "side",
            POS,
            "file",
            "data_digest",
            F.when(F.col("_key").isNotNull(), F.array_append("attempts", attempt))
            .otherwise(F.col("attempts"))
            .alias("attempts"),
            F.array_append("tier_keys", F.col("_key")).alias("tier_keys"),
        )
        if idx + 1 < len(tiers):
            rest = cut_lineage(rest)

    matched = matched_parts[0]
    for m in matched_parts[1:]:
        matched = matched.unionByName(m)
    cols = [POS, "file", "data_digest", "attempts", "tier_keys"]
    return {"matched": matched, "rest_1": rest.where(side == 1).select(*cols),
            "rest_2": rest.where(side == 2).select(*cols), "n_tiers": len(tiers)}


def unique_match(a: DataFrame, b: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """#37: pairs whose key occurs exactly once on each side."""
    return match_tiers(a, b, [(name, key)])["matched"]


def _last_attempt(col: str) -> tuple[Column, Column]:
    last = F.try_element_at(F.col(col), F.lit(-1))
    return last["tier"], last["key"]


def record_diff(a: DataFrame, b: DataFrame,
                tiers: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """#42: every entry of both sides in exactly one class:
    same / changed (matched; digests equal or not), undetermined_1 /
    undetermined_2 (left unmatched on side 1 / side 2)."""
    res = match_tiers(a, b, tiers)
    n_tiers = res["n_tiers"]
    m = res["matched"].withColumn(
        "class",
        F.when(F.col("digest_1").eqNullSafe(F.col("digest_2")), F.lit(SAME)).otherwise(F.lit(CHANGED)),
    ).withColumn("tier_keys", F.array_repeat(F.lit(None).cast("string"), n_tiers))

    def rest(df: DataFrame, cls: str, side: int) -> DataFrame:
        tier, key = _last_attempt("attempts")
        other = 2 if side == 1 else 1
        return df.select(
            F.lit(cls).alias("class"),
            tier.alias("tier"),
            F.lit(None).cast("int").alias("tier_idx"),
            key.alias("match_key"),
            F.col(POS).alias(f"entry_pos_{side}"),
            F.col("file").alias(f"file_{side}"),
            F.col("data_digest").alias(f"digest_{side}"),
            F.lit(None).cast("bigint").alias(f"entry_pos_{other}"),
            F.lit(None).cast("string").alias(f"file_{other}"),
            F.lit(None).cast("string").alias(f"digest_{other}"),
            "attempts",
            "tier_keys",
        )

    cols = ["class", "tier", "tier_idx", "match_key", "entry_pos_1", "file_1", "digest_1",
            "entry_pos_2", "file_2", "digest_2", "attempts", "tier_keys"]
    return (
        m.select(*cols)
        .unionByName(rest(res["rest_1"], UNDET_1, 1).select(*cols))
        .unionByName(rest(res["rest_2"], UNDET_2, 2).select(*cols))
    )


def attempts_text(col: str = "attempts") -> Column:
    """#41 as text: ``tier:key`` joined by ' > '."""
    return F.array_join(F.transform(F.col(col), lambda x: F.concat(x["tier"], F.lit(":"), x["key"])), " > ")


def diff_summary(diff: DataFrame) -> DataFrame:
    """#43: the four class counts and their total (one row)."""
    return diff.agg(
        F.count_if(F.col("class") == SAME).alias("same"),
        F.count_if(F.col("class") == CHANGED).alias("changed"),
        F.count_if(F.col("class") == UNDET_1).alias("undetermined_1"),
        F.count_if(F.col("class") == UNDET_2).alias("undetermined_2"),
        F.count(F.lit(1)).alias("total"),
    )


def diff_report_rows(diff: DataFrame) -> DataFrame:
    """#44: number rows per class from 0.  Matched rows in (tier, key) order;
    unmatched rows by their keys from the last tier back to the first
    (nulls last), then by entry position.  Works for any number of tiers."""
    matched = F.col("tier_idx").isNotNull()
    keys_back = F.transform(F.reverse(F.col("tier_keys")),
                            lambda k: F.struct(k.isNull().alias("none"), k.alias("key")))
    sort_cols = [
        F.coalesce(F.col("tier_idx"), F.lit(0)).asc(),
        F.when(matched, F.array(F.struct(F.lit(False).alias("none"), F.col("match_key").alias("key"))))
        .otherwise(keys_back).asc(),
        F.coalesce(F.col("entry_pos_1"), F.col("entry_pos_2")).asc(),
    ]
    return number_rows(diff, sort_cols, partition_by=["class"], out="row_num")


def diff_labels(rows: DataFrame) -> DataFrame:
    """#45: per report row the key label (last attempt), both paths and the
    digest label (``d`` or ``d1 -> d2``)."""
    return rows.select(
        "class",
        "row_num",
        F.format_string("[%04d]", F.col("row_num")).alias("number_label"),
        F.when(F.col("match_key").isNotNull(),
               F.concat(F.lit("("), F.col("tier"), F.lit(")  "), F.col("match_key"))).alias("key_label"),
        F.col("file_1").alias("path_1"),
        F.col("file_2").alias("path_2"),
        F.when(F.col("class") == CHANGED, F.concat_ws(" -> ", "digest_1", "digest_2"))
        .otherwise(F.coalesce(F.col("digest_1"), F.col("digest_2")))
        .alias("digest_label"),
    )


def renames(diff: DataFrame) -> DataFrame:
    """#46: entries with equal content found under another path."""
    return diff.where((F.col("class") == SAME) & (F.col("file_1") != F.col("file_2"))).select(
        "tier", "match_key", "entry_pos_1", "file_1", "entry_pos_2", "file_2", F.col("digest_1").alias("data_digest")
    )
