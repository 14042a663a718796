"""Byte access to a shared file system from inside tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI as Spark reports it (``file:/a`` or ``scheme://...``)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def pieces(path: str) -> Iterator[bytes]:
    """A file in bounded pieces."""
    fs, inner = locate(path)
    with fs.open_input_stream(inner) as f:
        while piece := f.read(PIECE):
            yield piece


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of matching files; their content is not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
        .load(folder).select("path", "length")
    )


LISTED = 10_000  # files that a listing task gives back at once


def _entries(folder: str) -> Iterator[tuple[str, str, int]]:
    """(path, name, length) of the files of a folder, one after the other where the file system allows it."""
    fs, inner = locate(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(inner) as found:
            for e in found:
                if e.is_file():
                    yield f"{folder}/{e.name}", e.name, e.stat().st_size
        return
    for info in fs.get_file_info(pafs.FileSelector(inner)):
        if info.is_file:
            yield f"{folder}/{info.base_name}", info.base_name, info.size


def listing_by_tasks(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """What ``listing`` gives, for folders of very many files: the driver holds the names of folders only.

    A folder that ends in ``/*`` stands for its sub-folders, each listed by a task of its own.
    Hidden and empty files are left out, as Spark does. Other wildcards are left to Spark.
    """
    folder = folder.rstrip("/")
    if any(c in folder.removesuffix("/*") for c in "*?[{"):
        return listing(spark, folder, pattern)
    inside = [folder]
    if folder.endswith("/*"):
        fs, inner = locate(folder[:-2])
        inside = [f"{folder[:-2]}/{d.base_name}" for d in fs.get_file_info(pafs.FileSelector(inner)) if d.type == pafs.FileType.Directory and d.base_name[0] not in "_."]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for b in batches:
            for one in b["folder"]:
                for path, name, length in _entries(one):
                    if length and name[0] not in "_." and fnmatchcase(name, pattern):
                        rows.append((path, length))
                        if len(rows) >= LISTED:
                            yield pd.DataFrame(rows, columns=["path", "length"])
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["path", "length"])

    return spark.createDataFrame([(f,) for f in inside], "folder string").mapInPandas(listed, "path string, length long")


def stem(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
