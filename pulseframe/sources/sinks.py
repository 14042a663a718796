"""Writers: feature tables, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import scratch


def write_features(df: DataFrame, path: str, split: str = "split") -> None:
    """Feature rows partitioned by split, so that training reads only its own files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: reused results survive lost executors."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """One row with every section of an evaluation report as nested JSON.

    Sections are aggregates (one row per metric set, attribute or group).
    """
    rows = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    lists = rows.groupBy("section").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("item")), ","), F.lit("]")).alias("items"))
    body = lists.groupBy().agg(F.sort_array(F.collect_list(F.concat(F.lit('"'), "section", F.lit('": '), "items"))).alias("parts"))
    return body.select(F.concat(F.lit("{"), F.array_join("parts", ", "), F.lit("}")).alias("report"))


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.col("report").alias("value")).write.mode("overwrite").text(path)
