"""File integrity: size, SHA-256, comparison with an expected manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.sources.files import listing, locate, pieces


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sums = []
        for path in b["path"]:
            h = hashlib.sha256()
            for piece in pieces(path):
                h.update(piece)
            sums.append(h.hexdigest())
        yield b.assign(sha256=sums)


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file, length, sha256. A file streams through its task, so its size does not matter."""
    files = listing(spark, folder, pattern)
    # one file is one unit of work: spread them evenly before the expensive part
    files = files.repartition(F.col("path"))
    hashed = files.mapInPandas(_digest, "path string, length long, sha256 string")
    return hashed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256")


def verify(actual: DataFrame, expected: DataFrame, folder: str) -> DataFrame:
    """Status per file of ``expected(file, expected_sha256)``; the digest compares in any case.

    Spark's file listing leaves out empty files, so names without a digest are looked up.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for name in b["file"]:
                fs, inner = locate(f"{folder}/{name}")
                info = fs.get_file_info(inner)
                found.append("EMPTY" if info.is_file and info.size == 0 else "MISSING")
            yield b.assign(status=found)

    joined = expected.select("file", "expected_sha256").join(actual, "file", "left")
    known = joined.where(F.col("sha256").isNotNull()).withColumn(
        "status",
        F.when(F.col("expected_sha256").isNull() | (F.lower("expected_sha256") == F.col("sha256")), "OK").otherwise("MISMATCH"),
    ).select("file", "length", "sha256", "status")
    absent = joined.where(F.col("sha256").isNull()).select("file").mapInPandas(probe, "file string, status string")
    return known.unionByName(absent, allowMissingColumns=True)
