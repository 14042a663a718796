"""Parquet tables with early column pruning and UTC timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import configure


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``folder/name.parquet``; zone-less timestamps become UTC instants."""
    configure(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
