"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import scratch

GAP = r"[\x20\x09-\x0D]+"  # what separates words
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back with its exact size known."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, in order; NULL and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
