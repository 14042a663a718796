"""Merkle manifest of a dataset with a proof for every row, by a butterfly exchange.

A row's leaf is the SHA-256 of its columns, each written with its length. Per group the leaves
ascend by the order column; every ``fanout`` neighbours become their digest until one is left,
the group's subroot, and the subroots, ordered by group, give the root in the same way.

1. Leaves are ranked by one range sort over (group, order, leaf, row number): a group that
   holds a third of all rows, or rows that are all equal, are cut into as many ranges as any
   others. Ranks come from the place in a range and from counts per (range, group).
2. An aligned block of ``fanout ** levels`` leaves is reduced to one digest in one task.
3. Butterfly: in round r the blocks of an aligned group of ``fanout`` subtrees of r levels swap
   their subtree roots, block with block of the same place; each then hashes the ancestor for
   itself. So after the last round every block holds the root and the siblings of all its
   ancestors, and nothing has to be sent down. If the last subtree of a group has fewer blocks
   than its partners, its blocks serve several of them in turn.
4. Leaves meet the path of their block once more and leave with their whole proof.

Texts stay where they are read; a leaf travels as its digest and the few columns given. Each
round is written to the shared folder, so a lost executor costs its own tasks. What reaches
the driver is one number, the most blocks of a group.

Defined results: a NULL column is ``-`` in its leaf, another ``bytes:value`` of its UTF-8 text;
NULL groups and NULL order values come first; rows with equal order value ascend by leaf; equal
rows have leaves of their own; a group of one row has its leaf as subroot; an empty table
gives no rows; further columns pass through unless a result has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pulseframe.llm.common import written

FANOUT = 3
LEVELS = 7  # of a block: 2187 leaves at fanout 3
PATH = "array<struct<left:string,right:string>>"
IN_RANGE = 1 << 33  # monotonically_increasing_id counts from this times the partition
RESULTS = ("leaf", "subroot", "root", "proof")


def leaf_of(*columns: str | Column) -> Column:
    """Hex SHA-256 of the columns, each ``-`` or its byte count, a colon and its text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings' digests of a proof, from the leaf upwards, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (a number of the group), ``at`` (place in the group, from 0) and ``n`` (its rows).

    ``order`` must tell all rows of a group apart where their places matter.
    """
    sort = [group, *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed, "ranked")
    keyed = placed.withColumn("_part", F.shiftright("_m", 33))
    runs = keyed.groupBy("_part", F.col(group).alias("_g")).agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "_g", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"), F.min("_first").over(whole).alias("tree"))
    joined = keyed.alias("k").join(runs.alias("r"), (F.col("k._part") == F.col("r._part")) & F.col(f"k.{group}").eqNullSafe(F.col("r._g")))
    return joined.select("k.*", "tree", (F.col("_before") + F.col("_m") - F.col("_first")).alias("at"), "n").drop("_m", "_part")


def _up(digests: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(digests[i : i + fanout]).encode()).hexdigest() for i in range(0, len(digests), fanout)]


def _levels(leaves: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """All levels of a block's subtree; a block that is the whole tree ends at one node, another at ``levels``."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= levels:
        out.append(_up(out[-1], fanout))
    return out


def _swap(state: DataFrame, r: int, fanout: int) -> DataFrame:
    """One round: every block that has partners learns their subtree roots and hashes the ancestor."""
    width = F.lit(fanout**r).cast("long")
    node = F.floor(F.col("block") / width)
    base = node * width
    size = lambda m: F.least(width, F.col("blocks") - m * width)  # noqa: E731  blocks under a node
    family = node - node % fanout
    partner = F.explode(F.filter(F.sequence(family, family + fanout - 1), lambda m: (m != node) & (m * width < F.col("blocks"))))
    sent = state.where(F.col("blocks") > width).select("tree", "blocks", "digest", node.alias("node"), (F.col("block") - base).alias("place"), size(node).alias("own"), partner.alias("partner"))
    # the block at place p of a node of ``own`` blocks serves the partner's places p, p + own, p + 2 own, ...
    last = F.least(width, F.col("blocks") - F.col("partner") * width) - 1
    served = sent.where(F.col("place") <= last).withColumn("to", F.explode(F.sequence("place", last, "own")))
    came = served.groupBy("tree", (F.col("partner") * width + F.col("to")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("came"))
    met = state.join(came, ["tree", "block"], "left").withColumn("came", F.coalesce("came", F.array().cast("array<struct<node:bigint,digest:string>>")))
    side = lambda keep: F.array_join(F.transform(F.filter("came", keep), lambda c: c["digest"]), "")
    step = F.struct(side(lambda c: c["node"] < node).alias("left"), side(lambda c: c["node"] > node).alias("right"))
    climbs = F.col("blocks") > width
    met = met.withColumn("step", step)
    digest = F.sha2(F.concat("step.left", "digest", "step.right"), 256)
    return met.select("tree", "block", "blocks", F.when(climbs, digest).otherwise(F.col("digest")).alias("digest"), F.when(climbs, F.array_append("path", F.col("step"))).otherwise(F.col("path")).alias("path"))


def block_paths(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, block, digest, path): the tree's root and the siblings above each block, from ``ranked`` rows with ``leaf``."""
    size = fanout**levels

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        n = group.column("n")[0].as_py()
        top = _levels(group.column("leaf").to_pylist(), fanout, levels, n <= size)[-1][0]
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "blocks": [-(-n // size)], "digest": [top]})

    keyed = leaves.select("tree", "at", "n", "leaf", F.floor(F.col("at") / size).alias("block"))
    state = keyed.groupBy("tree", "block").applyInArrow(reduce, "tree long, block long, blocks long, digest string")
    state = written(state.withColumn("path", F.array().cast(PATH)), "blocks")
    most, r = state.agg(F.max("blocks")).first()[0] or 0, 0
    while fanout**r < most:
        state = written(_swap(state, r, fanout), "blocks")
        r += 1
    return state.select("tree", "block", "digest", "path")


def tree_proofs(leaves: DataFrame, paths: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (tree, at, n, leaf, row) as (row, leaf, tree, digest, path): the siblings inside the block, then ``paths``."""
    size = fanout**levels
    schema = StructType([leaves.schema["row"], *[StructField(f.name, f.dataType) for f in paths.select("tree", "digest", "path").schema.fields], leaves.schema["leaf"]])
    names = ["row", "tree", "digest", "path", "leaf"]
    pairs = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def prove(group: pa.Table, above: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        below = _levels(group.column("leaf").to_pylist(), fanout, levels, len(group) and group.column("n")[0].as_py() <= size)
        rest, out = above.column("path")[0].as_py(), []
        for i in range(len(group)):
            steps, k = [], i
            for level in below[:-1]:
                first = k - k % fanout
                steps.append({"left": "".join(level[first:k]), "right": "".join(level[k + 1 : first + fanout])})
                k //= fanout
            out.append(steps + rest)
        same = lambda c: pa.array(above.column(c).to_pylist() * len(group))
        return pa.table([group.column("row"), same("tree"), same("digest"), pa.array(out, pairs), group.column("leaf")], names=names)

    keyed = leaves.select("tree", F.floor(F.col("at") / size).alias("block"), "at", "n", "leaf", "row")
    return keyed.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(prove, schema)


def manifest(rows: DataFrame, leaf: Column, group: str, order: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``leaf``, ``subroot`` of their group, ``root`` and ``proof``: (left, right) siblings from leaf to root."""
    kept = [c for c in rows.columns if c not in RESULTS]
    leaves = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), leaf.alias("leaf"), F.struct(*kept).alias("row"))
    leaves = written(leaves.withColumn("line", F.monotonically_increasing_id()), "leaves")
    leaves = written(ranked(leaves, "group", ["order", "leaf", "line"]), "places")
    paths = written(block_paths(leaves, fanout, levels), "paths")
    tops = leaves.groupBy("tree", "group").agg(F.lit(1).alias("one")).join(paths.where("block = 0").select("tree", "digest"), "tree")
    tops = ranked(tops.select(F.lit(0).alias("all"), "group", F.col("digest").alias("leaf"), F.struct("tree").alias("row")), "all", ["group"])
    tops = written(tops, "subroots")
    upper = tree_proofs(tops, written(block_paths(tops, fanout, levels), "top-paths"), fanout, levels)
    upper = written(upper.select("row.tree", F.col("digest").alias("root"), F.col("path").alias("top")), "upper")
    # the part of the path above a group is the group's own: it goes to the blocks, not to each row
    whole = paths.join(upper, "tree").select("tree", "block", F.struct("digest", "root").alias("digest"), F.concat("path", "top").alias("path"))
    proved = tree_proofs(leaves, whole, fanout, levels)
    return proved.select("row.*", "leaf", F.col("digest.digest").alias("subroot"), F.col("digest.root").alias("root"), F.col("path").alias("proof"))
