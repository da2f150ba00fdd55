"""Design source (#6): a CSV with a header, only the needed columns, all
strings, plus ``variation_pos`` (row order in the file, from 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators.numbering import number_rows
from provenant.sources.files import strip_scheme


def scan_design(spark: SparkSession, location: str, variables: list[str]) -> DataFrame:
    """Read the design; a needed column that is missing is an error."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(location)
    missing = sorted(set(variables) - set(raw.columns))
    if missing:
        raise ValueError(f"design has no column(s) {missing}")
    cols = sorted(set(variables))
    rows = raw.select(
        *[F.col(c).cast("string").alias(c) for c in cols],
        strip_scheme(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    numbered = number_rows(rows, ["_file", "_blk", "_mid"], out="variation_pos")
    return numbered.select("variation_pos", *cols)


def write_design(design: DataFrame, out_dir: str) -> None:
    """Write a design as header CSV (one file per task)."""
    design.write.mode("overwrite").option("header", "true").csv(out_dir)
