"""Repeated runs of lines, found by prefix doubling over line-ID sequences, and their removal.

Every text is its sequence of line IDs. A line is deleted when it lies in a run of lines with
at least ``min_words`` words that also starts at an earlier place (an earlier document, by id,
or earlier in the same text); the first copy of everything stays. For each place the run that
counts is the longest one with an earlier copy, so a run that two documents share is found
whole, also inside longer runs that other documents share.

Method. Only lines that occur twice can be in such a run, so the sequences are cut down to
stretches of such lines with enough words. Prefix doubling ranks the blocks of 1, 2, 4, ...
lines from each place as a suffix array's construction does: a block's key is the rank of its
first half and that of its second, a range sort of the distinct keys gives the new ranks, and
equal ranks are equal blocks. Blocks that occur once are dropped, as no longer one repeats
either. The longest-common-prefix intervals are then refined from the longest blocks down: an
interval holds places that share their first m lines; the rank of the next block splits it.
All but the first place of a part have an earlier copy of m + block lines and go on in that
part; the first places of all parts go on in the old interval. A part keeps its first place as
a partner, so no interval ever loses the place that others must find, and there are at most
two rows per place.

Scale: one pass over the text makes rows of a few numbers; counting lines and splitting
intervals are aggregates with map-side combine, so a line that fills a third of all rows costs
one row per task there, and the joins back to places may be split by AQE. Rounds are the
logarithm of the longest run; each is written to the shared folder. Windows run inside one
text only. Texts meet the deleted stretches in one join.

Defined results: NULL texts stay NULL, empty and unrepeated texts stay as they are; lines are
split at ``\\n`` and compared exactly; a text that loses all its lines becomes empty; rows
that repeat id and text are one document and get the same result; NULL ids sort last; an
empty table gives no rows; other columns pass, results replace columns of their name. Lines
are told apart by two 64-bit hashes, blocks exactly.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.binding import let
from pulseframe.llm.common import written

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def lines_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, key, pos, x, y, w): a row per line with its ID (two hashes) and number of words."""
    content = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(content).alias("key"), F.split(content, "\n", -1).alias("lines"))
    rows = split.select("doc", "key", F.posexplode("lines").alias("pos", "line"))
    return rows.select("doc", "key", "pos", F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"), F.regexp_count("line", F.lit(WORD)).alias("w"))


def places(lines: DataFrame, min_words: int) -> DataFrame:
    """Places in stretches of repeated lines; ``id`` counts them up in document order.

    ``left`` is the number of lines from here to the end of the stretch, ``sum_w`` the words
    from its start up to here. Places of one stretch have consecutive ids.
    """
    repeated = lines.groupBy("x", "y").count().where("count > 1").select("x", "y")
    active = lines.join(repeated, ["x", "y"], "left_semi").dropDuplicates(["doc", "key", "pos"])
    text = Window.partitionBy("doc", "key").orderBy("pos")
    stretch = Window.partitionBy("doc", "key", "stretch")
    rows = active.withColumn("stretch", F.col("pos") - F.row_number().over(text))
    rows = rows.withColumns({"all_w": F.sum("w").over(stretch), "all_n": F.count("*").over(stretch)}).where(F.col("all_w") >= min_words)
    along = stretch.orderBy("pos")
    rows = rows.withColumns({"sum_w": F.sum("w").over(along), "left": (F.col("all_n") - F.row_number().over(along) + 1).cast("long")})
    order = [F.col("doc").asc_nulls_last(), F.col("key")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    return rows.select(F.monotonically_increasing_id().alias("id"), "doc", "key", "stretch", "pos", "x", "y", "w", "sum_w", "left")


def _ranked(blocks: DataFrame) -> DataFrame:
    """(id, left, rank) of the ``blocks`` (id, left, a, b) whose key (a, b) occurs twice; ranks follow the order of the keys."""
    keys = blocks.groupBy("a", "b").count().where("count > 1").select("a", "b")
    keys = keys.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
    return written(blocks.join(written(keys, "ranks"), ["a", "b"]).select("id", "left", "rank"), "ranked")


def block_ranks(at: DataFrame, levels: int) -> list[DataFrame]:
    """Per j (id, left, rank): the rank of the block of 2^j lines from each place, where it repeats and does not pass the stretch's end."""
    ranks = [_ranked(at.select("id", "left", F.col("x").alias("a"), F.col("y").alias("b")))]
    for j in range(1, levels + 1):
        half = 1 << (j - 1)
        second = ranks[-1].select((F.col("id") - half).alias("id"), F.col("rank").alias("b"))
        first = ranks[-1].where(F.col("left") >= 2 * half).select("id", "left", F.col("rank").alias("a"))
        ranks.append(_ranked(first.join(second, "id")))
    return ranks


def earlier_runs(at: DataFrame) -> DataFrame | None:
    """(id, m): the longest run from each place that an earlier place starts too, in lines."""
    longest = at.agg(F.max("left")).first()[0]
    if longest is None:
        return None
    levels = floor(log2(longest))
    ranks = block_ranks(at, levels)
    entries = at.select("id", "left", F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("seeks"))
    for j in range(levels, -1, -1):
        size = 1 << j
        test, rest = entries.where(F.col("left") - F.col("m") >= size), entries.where(F.col("left") - F.col("m") < size)
        block = ranks[j].select(F.col("id").alias("at"), F.col("rank").alias("name"))
        named = test.withColumn("at", F.col("id") + F.col("m")).join(block, "at", "left")
        parts = named.where("name IS NOT NULL").groupBy("f", "name").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("f", "name", "first")
        split = named.join(parts, ["f", "name"], "left")
        stay = F.struct("id", "left", "f", "m", "seeks")
        part, deeper = F.xxhash64("f", "name", F.lit(j)).alias("f"), (F.col("m") + size).alias("m")
        go = F.struct("id", "left", part, deeper, F.lit(True).alias("seeks"))
        partner = F.struct("id", "left", part, deeper, F.lit(False).alias("seeks"))
        out = F.when(F.col("first").isNull(), F.array(stay)).when(F.col("id") == F.col("first"), F.array(stay, partner)).otherwise(F.array(go))
        entries = rest.union(split.select(F.explode(out).alias("e")).select("e.*"))
        entries = written(entries, "intervals")
    return entries.where("seeks AND m > 0").select("id", "m")


def deleted_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame | None:
    """(doc, key, pos, w) of every line to delete."""
    at = written(places(lines, min_words), "places")
    runs = earlier_runs(at)
    if runs is None:
        return None
    ends = at.select((F.col("id")).alias("end"), F.col("sum_w").alias("end_w"))
    runs = runs.withColumn("end", F.col("id") + F.col("m") - 1).join(ends, "end")
    marked = at.join(runs, "id", "left")
    enough = F.when(F.col("end_w") - F.col("sum_w") + F.col("w") >= min_words, F.col("end"))
    reach = F.max(enough).over(Window.partitionBy("doc", "key", "stretch").orderBy("id"))
    return marked.select("doc", "key", "pos", "w", "id", reach.alias("reach")).where("reach >= id").select("doc", "key", "pos", "w")


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines of ``gone``, a sorted array of stretches (first, size)."""
    def build(lines: Column) -> Column:
        def kept(k: Column) -> Column:
            before = F.get(gone, k - 1)
            start = F.coalesce(before["first"] + before["size"], F.lit(0))
            end = F.coalesce(F.get(gone, k)["first"], F.size(lines))
            return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), kept)), "\n")

    return let(F.split(text, "\n", -1), build)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies cut out of ``text``, and ``removed_lines``, ``removed_words``, ``removed`` (stretches of original lines)."""
    kept = [c for c in docs.columns if c not in ("removed_lines", "removed_words", "removed")]
    empty = "array<struct<first:int,size:int>>"
    gone = deleted_lines(written(lines_of(docs, text, doc_id), "lines"), min_words)
    if gone is None:
        return docs.select(*kept, F.lit(0).cast("long").alias("removed_lines"), F.lit(0).cast("long").alias("removed_words"), F.array().cast(empty).alias("removed"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc", "key").orderBy("pos"))
    stretches = gone.withColumn("island", island).groupBy("doc", "key", "island")
    stretches = stretches.agg(F.min("pos").alias("first"), F.count("*").cast("int").alias("size"), F.sum("w").alias("w"))
    per_doc = stretches.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("first", "size"))).alias("_gone"), F.sum("size").alias("_lines"), F.sum("w").alias("_words"),
    )
    per_doc = written(per_doc, "removed")
    rows = docs.select(F.struct(*kept).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    # always by shuffle: the table of stretches grows with the corpus, so no plan rests on its being small
    rows = rows.join(per_doc.hint("merge"), rows["id"].eqNullSafe(per_doc["_doc"]) & (rows["text_key"] == per_doc["_key"]), "left")
    cut = F.when(F.col("_gone").isNull(), F.col("row")[text]).otherwise(_without(F.col("row")[text], F.col("_gone")))
    return rows.select(
        *[cut.alias(c) if c == text else F.col("row")[c].alias(c) for c in kept],
        F.coalesce("_lines", F.lit(0)).cast("long").alias("removed_lines"), F.coalesce("_words", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("_gone", F.array().cast(empty)).alias("removed"),
    )
