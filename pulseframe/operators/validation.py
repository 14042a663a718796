"""Table-level validation: schema, sampling rate, signal ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import quality


class ValidationError(Exception):
    """A table does not have what an operator needs."""


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail before any job runs when a required column is absent (trimmed, any case)."""
    present = {c.strip().lower() for c in df.columns}
    absent = [c for c in required if c.strip().lower() not in present]
    if absent:
        raise ValidationError(f"Schema violation: missing required columns: {absent}")
    return df


def missing_columns(present: Column, required: Column) -> Column:
    """Table form of the same rule for a column holding each source's header."""
    have = F.transform(present, lambda c: F.lower(F.trim(c)))
    return F.filter(required, lambda c: ~F.array_contains(have, F.lower(F.trim(c))))


def fs_mismatch(actual: Column, expected: Column, tolerance: float = C.FS_TOLERANCE) -> Column:
    return F.abs(actual - expected) > tolerance


def signal_ranges(df: DataFrame, key: list[str], value: str, kind: str, allow_nan: bool = False) -> DataFrame:
    """One verdict per signal from counts and extremes; NaN and NULL both count as missing."""
    v = F.col(value)
    nan = v.isNull() | F.isnan(v)
    inf = F.abs(v) == float("inf")
    g = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inf).alias("n_inf"), F.count_if(nan).alias("n_nan"),
        F.min(F.when(~nan, v)).alias("low"), F.max(F.when(~nan, v)).alias("high"),
    )
    message = quality.signal_range(kind, F.col("n"), F.col("n_inf"), F.col("n_nan"), F.col("low"), F.col("high"), allow_nan)
    return g.withColumn("message", message).withColumn("ok", F.col("message") == "Valid signal")
