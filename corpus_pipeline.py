"""Five stages from raw documents to packed token sequences.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads
it, so a lost executor costs its own tasks only. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import line_dedup, mixing, packing, quality, simhash
from pulseframe.llm.common import read
from pulseframe.session import cleared, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    rules = quality.learn(quality.labelled(docs, read(spark, sf_dir, "labels")))
    return docs.where(quality.kept_texts(F.col("text"), rules))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which nothing is left goes too."""
    done = line_dedup.remove_repeats(docs)
    done = done.where((F.col("removed_lines") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    size = F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id."""
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken in several epochs is repeated."""
    return mixing.mix(docs, mixing.document_levels(), weights=mixing.WEIGHTS).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]
ORACLE_SQL = None  # fingerprints and tokenizers are not in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        with cleared(spark):  # what the stage has written for itself
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
