"""Sensor CSV files: every column but the timestamp is a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.privacy import pseudonym
from pulseframe.operators.validation import ValidationError, require_columns


def read(
    spark: SparkSession, path: str, timestamp_col: str | None = "timestamp", signal_cols: list[str] | None = None, fs: float = 1.0
) -> DataFrame:
    """Rows with DOUBLE signals (blank or unparsable becomes NULL), record id and file name."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    if not raw.columns:
        raise ValidationError(f"no CSV header under {path}")
    signals = signal_cols or [c for c in raw.columns if c != timestamp_col]
    require_columns(raw, signals)
    name = F.col("_metadata.file_name")
    keep = [F.col(timestamp_col)] if timestamp_col in raw.columns else []
    return raw.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("record_id"), name.alias("filename"), F.lit(fs).alias("fs"), *keep,
        *[F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c) for c in signals],
    )


def describe(df: DataFrame, patient_id: Column, salt: str) -> DataFrame:
    """Metadata per file: pseudonym, row count."""
    return df.groupBy("record_id", "filename").agg(F.count(F.lit(1)).alias("row_count")).select(
        "*", pseudonym(patient_id, salt).alias("patient_pseudonym"), F.lit("CSV").alias("source_format"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValidationError("CSV file contains no data rows.")
    return df
