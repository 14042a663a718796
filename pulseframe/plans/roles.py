"""The driver tables in their physiological roles (see README)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.series import indexed, time_chunk
from pulseframe.sources.tables import table

ORDER = ["ts", "event_id"]


def r(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Device samples: user = patient or device, value = sample, 'error' = missing sample."""
    return table(spark, folder, "events", *(columns or ("event_id", "ts", "user_id", "event_type", "value")))


def signal(spark: SparkSession, folder: str, total: str | None = None) -> DataFrame:
    df = events(spark, folder).withColumnRenamed("value", "v")
    return indexed(df, ["user_id"], ORDER, time_chunk("ts"), total=total)


def missing(df: DataFrame) -> Column:
    return F.when(F.col("event_type") != "error", F.col("v"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth and a fixed score formula with deliberate ties."""
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars")
    truth = table(spark, folder, "labels", "doc_id", "quality", "toxic")
    p = (F.col("n_chars") % 1000) / 1000.0
    return truth.join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("y"), "toxic",
        p.alias("p"), F.when(p > 0.5, 1).otherwise(0).alias("yhat"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x")
    )
