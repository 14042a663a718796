"""WFDB records: headers, format-212 signals, beat annotations.

Headers are parsed with column expressions. A signal file is cut into ranges of some 64 MB
before it is read, so one long recording is decoded by many tasks, each opens its file once
per range, and samples are scaled where they are decoded: gains travel to the ranges, samples
to nobody. An annotation file (two bytes per beat, variable-length entries) is streamed
through one task in whole arrays. Folders are listed by tasks: the driver never holds the names
of all files. A folder that ends in ``/*`` stands for its sub-folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.privacy import pseudonym, scrub
from pulseframe.sources.files import listing_by_tasks, locate, pieces, stem

# Fixed values of the format
FRAME_BYTES = 3
DEFAULT_BASELINE = 1024
DEFAULT_CHANNELS = [("MLII", 200.0, 1024), ("V5", 200.0, 1024)]  # where the header names fewer than two
RANGE_FRAMES = 22_000_000
PIECE_BLOCKS = 1024
BATCH_BEATS = 1 << 16
SKIP, AUX, END = 59, 63, 0


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with demographics and an array of channel descriptions."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "value": [b"".join(pieces(p)).decode("utf-8", "replace") for p in b["path"]]})

    raw = listing_by_tasks(spark, folder, "*.hea").select("path").repartition(_tasks(spark), "path").mapInPandas(texts, "path string, value string")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    df = raw.select(stem("path").alias("record_id"), lines.alias("lines"))
    head = F.split(F.get("lines", F.lit(0)), r"\s+")
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    comments = F.transform(F.filter(rest, lambda s: s.startswith("#")), lambda s: F.trim(F.regexp_replace(s, "^#+", "")))
    fields = F.filter(F.transform(F.filter(rest, lambda s: ~s.startswith("#")), lambda s: F.split(s, r"\s+")), lambda t: F.size(t) >= 9)
    df = df.select("record_id", head.alias("h"), comments.alias("comments"), fields.alias("fields"))
    person = r"^\d+\s+[MmFf](\s|$)"
    who = F.try_element_at(F.filter("comments", lambda s: s.rlike(person)), F.lit(-1))
    others = F.filter("comments", lambda s: ~s.rlike(person))

    def word(i: int) -> Column:  # a broken header gives NULLs and ends among the rejects
        return F.get("h", F.lit(i))

    return df.select(
        "record_id", word(0).alias("record_name"), word(1).try_cast("int").alias("n_channels"),
        word(2).try_cast("double").alias("fs"), F.coalesce(word(3).try_cast("long"), F.lit(0)).alias("n_samples"),
        F.regexp_extract(who, r"^(\d+)", 1).try_cast("int").alias("age"),
        F.upper(F.regexp_extract(who, r"^\d+\s+([MmFf])", 1)).alias("sex"),
        F.when(F.size(others) > 0, F.concat_ws(", ", others)).alias("medications"),
        F.transform("fields", _channel).alias("channels"),
    )


def _channel(t: Column) -> Column:
    base = F.regexp_extract(t[2], r"\((-?\d+)\)", 1)
    units = F.regexp_extract(t[2], r"/(\S+)", 1)
    return F.struct(
        t[0].alias("filename"), t[1].try_cast("int").alias("format"),
        F.regexp_extract(t[2], r"^([-+0-9.eE]+)", 1).try_cast("double").alias("gain"),
        F.when(base != "", base.try_cast("int")).otherwise(DEFAULT_BASELINE).alias("baseline"),
        F.when(units != "", units).otherwise("mV").alias("units"), t[3].try_cast("int").alias("adc_res"), t[8].alias("desc"),
    )


def decode_212(data: bytes) -> np.ndarray:
    """Frames of three bytes to an (n, 2) array of 12-bit signed samples."""
    b = np.frombuffer(data[: len(data) // FRAME_BYTES * FRAME_BYTES], dtype=np.uint8).reshape(-1, FRAME_BYTES).astype(np.int32)
    low, mid, high = b.T
    both = np.stack([low | (mid & 0x0F) << 8, high | (mid & 0xF0) << 4], axis=1)
    return np.where(both >= 2048, both - 4096, both)


def frame_pieces(path: str, start: int, frames: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, samples) of a range, some blocks at a time, from one open file."""
    fs, inner = locate(path)
    with fs.open_input_file(inner) as f:
        f.seek(start * FRAME_BYTES)
        for at in range(start, start + frames, block * PIECE_BLOCKS):
            n = min(block * PIECE_BLOCKS, start + frames - at)
            yield at, decode_212(f.read(n * FRAME_BYTES))


def ranges(spark: SparkSession, folder: str, block: int, max_samples: int | None = None) -> DataFrame:
    """path, record_id, start, frames: whole blocks, up to about ``RANGE_FRAMES`` frames each."""
    frames = F.floor(F.col("length") / FRAME_BYTES)
    if max_samples:
        frames = F.least(frames, F.lit(max_samples))
    step = max(1, RANGE_FRAMES // block) * block
    files = listing_by_tasks(spark, folder, "*.dat").withColumn("total", frames).where("total > 0")
    cut = files.select("path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / step))).alias("range_idx"))
    start = F.col("range_idx") * step
    return cut.select("path", stem("path").alias("record_id"), start.alias("start"), F.least(F.lit(step), F.col("total") - start).alias("frames"))


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that name files: such rows are few bytes for the work they stand for, so the number is not left to their size."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _blocks(parts: DataFrame, columns: str, block: int, row: Callable[[pd.Series, int, np.ndarray], tuple]) -> DataFrame:
    """Decode ranges into one row per (channel, block); short ranges share a batch, so that a small file costs no batch of its own."""
    names = [c.split()[0] for c in columns.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in batches:
            for part in b.itertuples(index=False):
                for first, samples in frame_pieces(part.path, part.start, part.frames, block):
                    for at in range(0, len(samples), block):
                        start = first + at
                        rows += [(part.record_id, start // block, start, *row(part, ch, samples[at : at + block, ch])) for ch in (0, 1)]
                    held += len(samples)
                    if held >= block * PIECE_BLOCKS or len(rows) >= 2 * PIECE_BLOCKS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return parts.repartition(_tasks(parts.sparkSession), "path", "start").mapInPandas(decode, columns)


def read_raw(spark: SparkSession, folder: str, block: int = 1800, max_samples: int | None = None) -> DataFrame:
    """Blocks of raw samples: record_id, channel, block_idx, start, raw ARRAY<INT>."""
    columns = "record_id string, block_idx long, start long, channel int, raw array<int>"
    return _blocks(ranges(spark, folder, block, max_samples), columns, block, lambda _, ch, x: (ch, x))


def read_signals(spark: SparkSession, folder: str, block: int = 1800, max_samples: int | None = None) -> DataFrame:
    """Blocks in physical units, one row per (record, channel, block); records without a header are left out."""
    def channel(i: int) -> Column:
        name, gain, baseline = DEFAULT_CHANNELS[i]
        c = F.get("channels", F.lit(i))
        return F.struct(
            F.coalesce(c["desc"], F.lit(name)).alias("name"), F.coalesce(c["gain"], F.lit(gain)).alias("gain"), F.coalesce(c["baseline"], F.lit(baseline)).alias("baseline"))

    gains = read_headers(spark, folder).where("fs IS NOT NULL").select("record_id", "fs", *[channel(i)[f].alias(f"{f}{i}") for i in (0, 1) for f in ("name", "gain", "baseline")])
    parts = ranges(spark, folder, block, max_samples).join(gains, "record_id")
    columns = "record_id string, block_idx long, start long, channel string, fs double, samples array<double>"

    def scaled(part: pd.Series, ch: int, x: np.ndarray) -> tuple:
        name, gain, baseline = (part.name0, part.gain0, part.baseline0) if ch == 0 else (part.name1, part.gain1, part.baseline1)
        return name, part.fs, (x - baseline) / gain

    return _blocks(parts, columns, block, scaled)


def annotations(data: Iterator[bytes], max_samples: int | None = None, long_first: str = "high") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs (samples, codes) of beats in a stream of annotation bytes.

    Between the rare special words (skip, note, end) positions are running sums. The long skip
    stores its high half first in the published layout; ``long_first='low'`` reads it as one
    little-endian number.
    """
    rest, at, over = b"", 0, 0  # over: words of a note that reach into the next piece
    for piece in data:
        rest += piece
        words = np.frombuffer(rest[: len(rest) // 2 * 2], "<u2").astype(np.int64)
        code, delta = words >> 10, words & 0x3FF
        special = np.flatnonzero((code == END) | (code == SKIP) | (code == AUX))
        i = min(over, len(words))
        over -= i
        while i < len(words):
            k = np.searchsorted(special, i)
            k = int(special[k]) if k < len(special) else len(words)
            if k > i:
                times = at + np.cumsum(delta[i:k])
                if max_samples and (late := np.flatnonzero(times >= max_samples)).size:
                    if late[0]:
                        yield times[: late[0]], code[i : i + late[0]]
                    return
                yield times, code[i:k]
                at, i = int(times[-1]), k
            if k == len(words):
                break
            if code[k] == END:
                return
            if code[k] == SKIP:
                if k + 2 >= len(words):
                    break  # its two words are in the next piece
                a, b = int(words[k + 1]), int(words[k + 2])
                jump = (a << 16 | b) if long_first == "high" else (b << 16 | a)
                at += jump - (1 << 32) if jump >= 1 << 31 else jump
                i = k + 3
            else:
                i = k + 1 + (int(delta[k]) + 1) // 2
                if i > len(words):
                    i, over = len(words), i - len(words)
        rest = rest[2 * i :]


def read_beats(spark: SparkSession, folder: str, max_samples: int | None = None, long_first: str = "high") -> DataFrame:
    """record_id, sample_idx, code."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, held = [], 0
        for b in batches:
            for path in b["path"]:
                for at, code in annotations(pieces(path), max_samples, long_first):
                    runs.append((path, at, code))
                    held += len(at)
                    if held >= BATCH_BEATS:
                        yield together(runs)
                        runs, held = [], 0
        if runs:
            yield together(runs)

    def together(runs: list[tuple[str, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        paths, at, code = zip(*runs)
        return pd.DataFrame({"path": np.repeat(np.array(paths, object), [len(a) for a in at]), "sample_idx": np.concatenate(at), "code": np.concatenate(code).astype(np.int32)})

    files = listing_by_tasks(spark, folder, "*.atr").repartition(_tasks(spark), "path")
    beats = files.select("path").mapInPandas(parse, "path string, sample_idx long, code int")
    return beats.select(stem("path").alias("record_id"), "sample_idx", "code")


def read_records(spark: SparkSession, folder: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): complete records de-identified, with their number of annotations (NULL
    without an annotation file); rejects say what is wrong."""
    heads = read_headers(spark, folder)
    data = listing_by_tasks(spark, folder, "*.dat").select(
        stem("path").alias("record_id"), F.floor(F.col("length") / FRAME_BYTES).alias("frames"))
    noted = listing_by_tasks(spark, folder, "*.atr").select(stem("path").alias("record_id"), F.lit(0).alias("n"))
    beats = noted.unionByName(read_beats(spark, folder).select("record_id", F.lit(1).alias("n"))).groupBy("record_id").agg(F.sum("n").alias("n_beats"))
    both = heads.join(data, "record_id", "full_outer").join(beats, "record_id", "left")
    ok = F.col("fs").isNotNull() & F.col("frames").isNotNull()
    records = both.where(ok).select(
        "record_id", pseudonym(F.col("record_id"), salt).alias("patient_pseudonym"), "fs", "frames", "n_channels", "n_beats", "age", "sex",
        scrub(F.col("medications")).alias("medications"), F.lit("WFDB_212").alias("source_format"))
    rejects = both.where(~ok).select(
        "record_id",
        F.when(F.col("record_name").isNull(), "WFDB header file not found").when(F.col("fs").isNull(), "WFDB header not readable").otherwise("WFDB binary data file not found").alias("reason"))
    return records, rejects


def read_blocks(spark: SparkSession, folder: str, salt: str, block: int = 1800, max_samples: int | None = None) -> DataFrame:
    """Whole records in pieces: one row per (record, block) with all channels, the annotations that fall in it, and the de-identified header.

    Signals and annotations meet on (record, block), so a long recording is joined in as many
    tasks as it has blocks. An annotation behind the last sample stays with the last block.
    Incomplete records are left out (see ``read_records``).
    """
    records, _ = read_records(spark, folder, salt)
    parts = read_signals(spark, folder, block, max_samples).groupBy("record_id", "block_idx", "start").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "samples")))).alias("signals"), F.max(F.size("samples")).alias("n"))
    ends = listing_by_tasks(spark, folder, "*.dat").select(stem("path").alias("record_id"), F.floor(F.col("length") / FRAME_BYTES).alias("total"))
    total = F.least("total", F.lit(max_samples)) if max_samples else F.col("total")
    last = F.floor((total - 1) / block)
    beats = read_beats(spark, folder, max_samples).join(ends, "record_id")
    beats = beats.withColumn("block_idx", F.greatest(F.least(F.floor(F.col("sample_idx") / block), last), F.lit(0)))
    noted = beats.groupBy("record_id", "block_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "code"))).alias("beats"))
    joined = parts.join(noted, ["record_id", "block_idx"], "left").join(records.drop("frames"), "record_id")
    none = F.array().cast("array<struct<sample_idx:bigint,code:int>>")
    return joined.withColumn("beats", F.coalesce("beats", none))
