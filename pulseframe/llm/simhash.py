"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits exactly when some value lies within h bits of
both. So each distinct fingerprint emits every variant within h bits, variants are shuffled,
and fingerprints that meet on a variant are linked: members of one meeting point are pairwise
within 2h bits, so each needs a link only to the smallest one there, never to all others.

What is shuffled is not each of the 2 081 variants (h = 2) but the fingerprint once per
*leading bits* its variants have (1 + b + b(b-1)/2 copies for b leading bits); the task that
owns these bits generates the variants that carry them, sorts them and finds the meeting
points with numpy. b follows from the number of distinct fingerprints, so that a task's share
stays near ``variants_per_task`` at any size; a task walks its share in slices of further
leading bits, so memory is bounded when fingerprints are uneven too. Links leave a task as a
spanning forest of what it has seen. Components then come from alternating large-star and
small-star rounds over the links, each round written to the shared folder.

That is ``near_duplicates``, exact at its radius. ``similar`` finds texts whose shingle sets are
alike to a given degree: they differ in many more bits, so pairs as near as that are looked for in
lanes of a longer signature, filtered on the whole of it and confirmed by the exact similarity
of their shingle sets. A lane is short enough for a simpler way: of some parts of its bits all
but four are equal in two blocks within 4 bits, so the blocks are sorted under a few dozen masks
instead of by their hundreds of variants.

Scale: exact copies and equal fingerprints collapse before anything is emitted (a group that
holds a third of all rows is one fingerprint); no pair list of a group exists anywhere.

Defined results: words are separated by ASCII white space, A-Z lower-cased; a text with fewer
words than a shingle is one shingle; NULL and blank texts have fingerprint zero and are
linked like any other; ``component_id`` is the smallest non-NULL id of the component (NULL if
all are NULL); repeated rows stay repeated; an empty table gives no rows; further columns
pass through unless a result has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import written

SEED = 42
VARIANTS_PER_TASK = 16_000_000
SLICE = 2_000_000  # variants that a task sorts at once
SPLIT_BITS = 6
UNEVEN = 8  # a share above this many times the planned one is split further
SMALL_SHARE = 10_000  # fingerprints that are never worth a split


def fingerprint(text: str | None, size: int = 5) -> int:
    """Signed 64-bit SimHash over word shingles; bit set where over half the hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(size)])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = 5, column: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of ``text`` as a long."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.withColumn(column, simhash(F.col(text)))


@cache
def _masks(width: int, flips: int) -> np.ndarray:
    """Every mask of ``width`` bits with at most ``flips`` of them set."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(width), k)], dtype=np.uint64)


def _ball(width: int, flips: int) -> int:
    return sum(comb(width, k) for k in range(flips + 1))


def _variants(value: np.ndarray, owner: np.ndarray, left: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices (variant, owner) of all variants of the low ``width`` bits with at most ``left`` flips.

    Equal variants are always in one slice; a slice has about SLICE rows at most.
    """
    total = sum(int((left == f).sum()) * _ball(width, f) for f in np.unique(left))
    if total > SLICE and width > SPLIT_BITS:
        rest = np.uint64(width - SPLIT_BITS)
        head, tail = value >> rest, value & np.uint64((1 << int(rest)) - 1)
        for s in range(1 << SPLIT_BITS):
            flips = np.bitwise_count(head ^ np.uint64(s)).astype(left.dtype)
            near = flips <= left
            if near.any():
                yield from _variants(tail[near], owner[near], left[near] - flips[near], int(rest))
        return
    keys, owners = [], []
    for f in np.unique(left):
        masks, at = _masks(width, int(f)), left == f
        keys.append((value[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(owner[at], len(masks)))
    yield np.concatenate(keys), np.concatenate(owners)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, by smallest member, of the links a-b."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _sorted(key: np.ndarray, owner: np.ndarray, width: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Both in order of the key of ``width`` bits, then of the owner, a number of ``room`` bits."""
    if width + room <= 64:  # key and owner in one word sort fastest
        both = np.sort(key << np.uint64(room) | owner.astype(np.uint64))
        return both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)
    order = np.lexsort((owner, key))
    return key[order], owner[order]


def _runs(value: np.ndarray, left: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (owners in order of variant, first owner of each one's variant, start flag), variants met by one owner left out."""
    room = max(1, (len(value) - 1).bit_length())
    for key, owner in _variants(value, np.arange(len(value)), left, width):
        key, owner = _sorted(key, owner, width, room)
        same = key[1:] == key[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        start = np.concatenate([[True], ~same])[kept]
        owner = owner[kept]
        if len(owner):
            yield owner, np.repeat(owner[start], np.diff(np.append(np.flatnonzero(start), len(owner)))), start


def meet(fps: np.ndarray, prefix: int, bits: int, half: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (forest) of fingerprints that meet on a variant with these ``bits`` leading bits."""
    value, left, low = _within(fps, prefix, bits, half, width)
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for owner, first, _ in _runs(value, left, low):
        far = owner != first
        if far.any():
            x, y = fps[owner[far]], fps[first[far]]
            near = np.bitwise_count(x ^ y) <= 2 * half  # holds by the triangle inequality
            a, b = _forest(np.concatenate([a, x[near]]), np.concatenate([b, y[near]]))
    return a, b


def _masks_of_parts(n: int, width: int, apart: int) -> list[int]:
    """Masks of ``width`` bits, so that values within ``apart`` bits of each other are equal under one of them at least.

    The bits are cut into parts of which ``apart`` can differ; each choice of the others is a
    mask. More parts leave more bits in a mask: as many as keep ``n`` values apart.
    """
    parts = apart + 1
    while parts < width and n >> (width * (parts - apart) // parts) > BUCKET:
        parts += 1
    edge = [width * i // parts for i in range(parts + 1)]
    return [sum(c) for c in combinations([(1 << hi) - (1 << lo) for lo, hi in zip(edge, edge[1:])], parts - apart)]


def _buckets(blocks: np.ndarray, half: int, width: int, part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, start flag) by mask: rows that are equal under it follow each other, in order; rows alone are left out. ``part`` of ``parts`` takes its share of the masks."""
    room = max(1, (len(blocks) - 1).bit_length())
    if not len(blocks):
        return
    for mask in _masks_of_parts(len(blocks), width, 2 * half)[part::parts]:
        key, row = _sorted(blocks & np.uint64(mask), np.arange(len(blocks)), width, room)
        same = key[1:] == key[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if kept.any():
            yield row[kept], np.concatenate([[True], ~same])[kept]


def _pairs_inside(row: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one bucket, by their distance in it."""
    bucket = np.cumsum(start)
    at, d = np.arange(len(row)), 0
    while True:
        d += 1
        at = at[: np.searchsorted(at, len(row) - d)]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            return
        yield row[at], row[at + d]


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """Each of the packed pairs once, in order."""
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *pairs]))
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


class _Pairs:
    """Pairs of rows, each kept once; less than 2^31 rows."""

    def __init__(self) -> None:
        self.parts, self.held = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.minimum(a, b) << 32 | np.maximum(a, b))
            self.held += len(a)
            if self.held > SLICE:
                self.parts = [_distinct(self.parts)]
                self.held = len(self.parts[0]) // 2  # merged again when it has grown by as much again

    def all(self) -> np.ndarray:
        every = _distinct(self.parts)
        return np.stack([every >> 32, every & 0xFFFFFFFF], 1)


def candidates(blocks: np.ndarray, part: int, parts: int, half: int, width: int) -> np.ndarray:
    """Pairs of rows whose blocks are within ``2 * half`` bits: all of small buckets, of crowded ones each row with the first one and with the one before it."""
    found = _Pairs()

    def near(a: np.ndarray, b: np.ndarray) -> None:
        close = np.bitwise_count(blocks[a] ^ blocks[b]) <= 2 * half
        found.add(a[close], b[close])

    for row, start in _buckets(blocks, half, width, part, max(1, parts)):
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(row)))
        few = np.repeat(size <= CROWD, size)
        for a, b in _pairs_inside(row[few], start[few]):
            near(a, b)
        if not few.all():
            crowd, begins = row[~few], start[~few]
            first = np.repeat(crowd[begins], size[size > CROWD])
            near(first[~begins], crowd[~begins])
            near(crowd[:-1][~begins[1:]], crowd[1:][~begins[1:]])
    return found.all()


def unlinked(blocks: np.ndarray, group: np.ndarray, part: int, parts: int, half: int, width: int, sigs: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of different groups whose blocks are within ``2 * half`` bits, and the rows with a crowd of such partners.

    Pairs of a crowd are left out without ``sigs``; with them no pair is left out that is within
    ``limit`` bits.
    """
    found, crowd, seen = _Pairs(), [np.zeros(0, np.int64)], set()

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(sigs[a] ^ sigs[b]).sum(1, dtype=np.int64) <= limit

    for row, start in _buckets(blocks, half, width, part, max(1, parts)):
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(row)))
        few = np.repeat(size <= CROWD, size)
        for a, b in _pairs_inside(row[few], start[few]):
            close = np.bitwise_count(blocks[a] ^ blocks[b]) <= 2 * half
            a, b = a[close], b[close]
            other = group[a] != group[b]
            a, b = a[other], b[other]
            if sigs is not None:
                close = alike(a, b)
                a, b = a[close], b[close]
            found.add(a, b)
        many = np.flatnonzero(size > CROWD)
        for i in many:
            rows = row[at[i] : at[i] + size[i]]
            names, kind, counts = np.unique(group[rows], return_inverse=True, return_counts=True)
            if len(names) == 1 or (mark := xxhash.xxh3_128_digest(rows.tobytes())) in seen:  # the same rows meet under many masks
                continue
            seen.add(mark)
            values, largest = blocks[rows], counts.argmax()
            # each pair of two groups has a row outside the largest one
            for x in np.flatnonzero(kind != largest):
                # of two rows outside it the one that comes first has the pair
                other = np.flatnonzero((np.bitwise_count(values ^ values[x]) <= 2 * half) & (kind != kind[x]) & ((kind == largest) | (rows > rows[x])))
                partners, own = rows[other], np.full(len(other), rows[x])
                if sigs is not None:
                    close = alike(partners, own)
                    found.add(partners[close], own[close])
                elif len(other) > CROWD:
                    crowd.append(np.append(partners, rows[x]))
                else:
                    found.add(partners, own)
    return found.all(), np.unique(np.concatenate(crowd))


def _within(fps: np.ndarray, prefix: int, bits: int, half: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bits below the prefix, the flips left for them, and their number."""
    low = width - bits
    left = half - np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)).astype(np.int64) if bits else np.full(len(fps), half)
    return fps & np.uint64((1 << low) - 1), left, low


def _prefixes(fp: Column, total: int, width: int, flips: int) -> Column:
    """The leading ``width`` of ``total`` bits that variants of ``fp`` can have."""
    masks = F.array(*[F.lit(int(m)).cast("long") for m in _masks(width, flips)])
    return F.transform(masks, lambda m: F.shiftrightunsigned(fp, total - width).bitwiseXOR(m))


def shares(fps: DataFrame, half: int, width: int, variants_per_task: int) -> DataFrame:
    """(lane, bits, prefix, fp, ...): each fingerprint once per share that some of its variants fall in.

    ``fps`` has ``lane`` (fingerprints of different lanes never meet) and ``fp``.
    """
    n = fps.groupBy("lane").count().agg(F.max("count")).first()[0] or 0
    bits = min(width - 8, 24, max(SPLIT_BITS if width == 64 else 0, ceil(log2(max(1, n * _ball(width, half) / variants_per_task)))))
    planned = max(1, n * _ball(bits, half) >> bits)
    entries = fps.select("*", F.lit(bits).alias("bits"), F.explode(_prefixes(F.col("fp"), width, bits, half)).alias("prefix"))
    while bits + SPLIT_BITS <= width - 4:  # shares that crowded fingerprints overfill are split by further bits
        hot = entries.where(F.col("bits") == bits).groupBy("lane", "prefix").count().where(F.col("count") > UNEVEN * planned + SMALL_SHARE)
        hot = written(hot.select("lane", "prefix", F.lit(bits).alias("bits"), F.lit(True).alias("hot")), "hot")
        if hot.isEmpty():
            break
        marked = entries.join(hot, ["lane", "bits", "prefix"], "left")
        wider = bits + SPLIT_BITS
        near = F.filter(_prefixes(F.col("fp"), width, wider, half), lambda p: F.shiftright(p, SPLIT_BITS) == F.col("prefix"))
        keys = F.when(F.col("hot"), near).otherwise(F.array("prefix"))
        entries = marked.select(*fps.columns, F.when(F.col("hot"), wider).otherwise(F.col("bits")).alias("bits"), F.explode(keys).alias("prefix"))
        bits = wider
    return entries


def links(fps: DataFrame, radius: int = 4, variants_per_task: int = VARIANTS_PER_TASK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits (even)."""
    half = radius // 2

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        values = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = meet(values, key[1].as_py(), key[0].as_py(), half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    entries = shares(fps.select(F.lit(0).alias("lane"), "fp"), half, 64, variants_per_task)
    return entries.groupBy("bits", "prefix").applyInArrow(joined, "a long, b long")


def _hooked(edges: DataFrame) -> DataFrame:
    """Fewer links of the same components: each node's to its least neighbour, and those between such neighbours.

    In a dense group almost all nodes share a few least neighbours, so what is left of its
    links is about one a node.
    """
    ends = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    for side in ("u", "v"):
        edges = edges.join(least.select(F.col("u").alias(side), F.col("m").alias(f"m_{side}")), side)
    between = edges.select(F.greatest("m_u", "m_v").alias("u"), F.least("m_u", "m_v").alias("v"))
    return between.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b); the root is the smallest node reachable."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = _hooked(written(edges, "links"))
    state = None
    while True:
        edges = written(edges, "links")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, radius: int = 4) -> DataFrame:
    """``docs`` without their text, each with ``fp`` (long), ``component_id`` and ``fp_root``, the component's smallest fingerprint."""
    kept = [c for c in docs.columns if c not in (text, "fp", "component_id", "fp_root")]
    rows = written(with_fingerprint(docs.select(*kept, text), text, size).select(*kept, "fp"), "fingerprints")
    per_fp = rows.groupBy("fp").agg(F.min(doc_id).alias("first_id"))
    roots = components(links(per_fp.select("fp"), radius))
    rooted = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select("fp", F.col("root").alias("fp_root"), "component_id")
    return rows.join(named, "fp", "left").select(*kept, "fp", "component_id", "fp_root")


# --- signatures of many bits, for a similarity of word shingles ----------------------
SIGNATURE_BITS = 1024
LANES = 25
LANE_BITS = 40
SIMILARITY = 0.8
LANE_VARIANTS = 2_500_000_000  # nodes of a lane in one task, times the variants a node stands for: 3 million nodes
LANE_TASKS = 48  # tasks that the lanes are dealt to where a lane is not cut by its values
FEW_NODES = 5_000  # that are one task a lane
CUT_BITS = 8  # of a part of a lane that is cut by its values
BUCKET = 2  # rows that are equal under a mask, on average
FIRST_LANES = 6  # that link dense families before all lanes are searched
RELATED = 0.6  # similarity of the texts of a family, of which all pairs are compared
TILE = 2_000_000  # shingles of a block of a family; two blocks meet in a task
CROWD = 16  # rows of a bucket, or partners in it, that are paired without a look at their signatures


def bits_apart(similarity: float, bits: int = SIGNATURE_BITS) -> int:
    """Differing bits that sets of this Jaccard similarity keep within in all but some 3 of 100 000 cases."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + 4 * sqrt(bits * p * (1 - p)))


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, in order; NULL and blank texts have none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    shingles = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    digest = xxhash.xxh64_digest
    every = np.frombuffer(b"".join([digest(s, SEED) for s in map(b" ".join, shingles)]), ">u8").astype(np.uint64)
    every.sort()
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """``SIGNATURE_BITS`` SimHash bits (0/1) over distinct shingle hashes."""
    ones = np.zeros(SIGNATURE_BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096, None] + np.arange(1, SIGNATURE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        bits = np.unpackbits(part.view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += bits[j : j + 255].sum(0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def with_signature(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` with ``node`` (hash of the shingle set), ``sig`` (longs) and ``lanes`` (the ``LANES`` blocks of ``LANE_BITS`` bits)."""
    weights = 1 << np.arange(LANE_BITS, dtype=np.int64)

    @F.pandas_udf("node long, sig array<long>, lanes array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t, size) for t in texts]
        bits = [signature(s) for s in sets]
        return pd.DataFrame({
            "node": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64),
            "sig": [np.packbits(b).view("<i8") for b in bits],
            "lanes": [b[: LANES * LANE_BITS].reshape(LANES, LANE_BITS) @ weights for b in bits],
        })

    return docs.withColumn("_s", sign(F.col(text))).select("*", "_s.*").drop("_s")


def dealt(nodes: DataFrame, lanes: int, per_task: int) -> DataFrame:
    """(lane, part, parts, value, fp, ...): every block of the first ``lanes`` of ``nodes`` once per task (lane, part, value) it belongs to.

    Blocks of a lane within 4 bits meet in one task at least. Up to ``per_task`` nodes a lane is
    a task, or ``parts`` that share its masks (``value`` is NULL). With more a lane is cut: of its
    five parts of ``CUT_BITS`` bits one is equal in such blocks, so a block goes to the tasks of
    its five values, and blocks that meet there differ in the other bits only.
    """
    n = nodes.count()
    rows = nodes.select("*", F.posexplode(F.slice("lanes", 1, lanes)).alias("lane", "fp")).drop("lanes")
    if n <= per_task:
        parts = 1 if n <= FEW_NODES else max(1, LANE_TASKS // lanes)
        rows = rows.select("*", F.lit(parts).alias("parts"), F.lit(None).cast("int").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        return rows.repartition(4 * lanes * parts, "lane", "part", "value")  # few tasks of one size each: kept apart
    parts = LANE_BITS // CUT_BITS
    values = F.array(*[F.shiftright("fp", CUT_BITS * i).bitwiseAND(F.lit((1 << CUT_BITS) - 1)).cast("int") for i in range(parts)])
    return rows.select("*", F.lit(parts).alias("parts"), F.posexplode(values).alias("part", "value"))


def met(nodes: DataFrame, lanes: int, variants_per_task: int, similarity: float, pairing: str = "first") -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, group, sig, lanes) that are within 4 bits in one of the first ``lanes``.

    ``first``: all but those of a crowd, of which a node is paired with the first one and the one
    before it. ``rest``: all pairs of different groups, but of more than ``CROWD`` partners in a
    bucket only the nodes, each as (node, NULL). ``crowded``: the pairs of different groups that
    are within the signature's distance too.
    """
    half, whole = 2, pairing == "crowded"

    def meets(key: tuple, group: pa.Table) -> pa.Table:
        ids, blocks = group.column("node").to_numpy(), group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        part, value, parts, width = key[1].as_py(), key[2].as_py(), group.column("parts")[0].as_py(), LANE_BITS
        if value is not None:  # all are equal in these bits
            low = np.uint64(part * CUT_BITS)
            blocks = (blocks >> (low + np.uint64(CUT_BITS))) << low | blocks & ((np.uint64(1) << low) - np.uint64(1))
            part, parts, width = 0, 1, LANE_BITS - CUT_BITS
        crowd = np.zeros(0, np.int64)
        if pairing == "first":
            pairs = candidates(blocks, part, parts, half, width)
        else:
            sigs = group.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1) if whole else None
            pairs, crowd = unlinked(blocks, group.column("group").to_numpy(), part, parts, half, width, sigs, bits_apart(similarity))
        a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
        partner = pa.array(np.concatenate([np.maximum(a, b), ids[crowd]]), mask=np.arange(len(a) + len(crowd)) >= len(a))
        return pa.table({"a": np.concatenate([np.minimum(a, b), ids[crowd]]), "b": partner})

    columns = {"first": [], "rest": ["group"], "crowded": ["group", "sig"]}[pairing]
    entries = dealt(nodes.select("node", *columns, "lanes"), lanes, variants_per_task // _ball(LANE_BITS, half))
    return entries.groupBy("lane", "part", "value").applyInArrow(meets, "a long, b long")


def near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures are as close as those of sets of this similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    apart = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.where(apart <= bits_apart(similarity)).select("a", "b")


def shingle_sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, grams) of the nodes in ``wanted``; of ``texts`` (text_key, text) only theirs are gathered."""
    @F.pandas_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, size).view(np.int64) for t in texts])

    wanted = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "text_key")
    found = texts.join(wanted.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return wanted.join(found, "text_key").select("node", grams("text").alias("grams"))


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets have at least this Jaccard similarity.

    ``nodes`` has (node, sig, text_key), ``texts`` (text_key, text). The signature is only a
    filter: texts are fetched and their sets compared for the pairs that it leaves.
    """
    pairs = written(near(pairs, nodes, similarity), "near-pairs")
    sets = written(shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, texts, size), "shingles")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("grams").alias(f"grams_{side}")), side)
    pairs = pairs.select("a", "b", F.size("grams_a").alias("n_a"), F.size("grams_b").alias("n_b"), F.size(F.array_intersect("grams_a", "grams_b")).alias("n"))
    return pairs.where(F.try_divide("n", F.col("n_a") + F.col("n_b") - F.col("n")) >= similarity).select("a", "b")


def verified_forest(sigs: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, limit: int, similarity: float) -> np.ndarray:
    """Links (i, j) that connect all rows of ``left`` and ``right`` whose sets are alike; pairs that others connect are passed over."""
    root = np.arange(len(grams))
    sizes = np.array([len(g) for g in grams])
    out = []
    inside = left is right
    for x in left:
        right = left[left > x] if inside else right
        close = right[np.bitwise_count(sigs[right] ^ sigs[x]).sum(1, dtype=np.int64) <= limit]
        # sets of too different sizes cannot be alike
        close = close[np.minimum(sizes[close], sizes[x]) >= similarity * np.maximum(sizes[close], sizes[x])]
        for y in close:
            if root[x] == root[y]:
                continue
            both = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
            if both >= similarity * (sizes[x] + sizes[y] - both):
                root[root == root[y]] = root[x]
                out.append((x, y))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def within_families(families: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float, tile: int) -> DataFrame:
    """Links (a, b) between nodes of one family (node, family) whose shingle sets are alike: all its pairs are tested.

    A family is cut into blocks of some ``tile`` shingles; every two blocks meet in one task,
    which compares signatures, then sets, and gives a forest: at most a link a node and block.
    """
    sets = written(shingle_sets(families, nodes, texts, size), "family-shingles")
    held = families.join(nodes.select("node", "sig"), "node").join(sets, "node")
    blocks = families.join(sets, "node").groupBy("family").agg(F.ceil(F.sum(F.size("grams")) / tile).alias("blocks"))
    held = held.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1))
    held = held.select("family", "node", "sig", "grams", "block", other.alias("other"))

    def link(key: tuple, group: pa.Table) -> pa.Table:
        order = group.column("node").to_numpy().argsort()
        group = group.take(pa.array(order))
        node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
        sigs = group.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        grams = [g.values.to_numpy().view(np.uint64) for g in group.column("grams")]
        limit = bits_apart(similarity)
        low, high = key[1].as_py(), key[2].as_py()  # the same twice where a block meets itself
        place = np.arange(len(node))
        left = place[block == low]
        found = verified_forest(sigs, grams, left, left if low == high else place[block == high], limit, similarity)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    held = held.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    # dealt anew: the joins above have dealt by family, which would bring all its tiles to one task
    tiles = held.repartition("family", "low", "high").groupBy("family", "low", "high")
    return tiles.applyInArrow(link, "a long, b long")


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = SIMILARITY, variants_per_task: int = LANE_VARIANTS, tile: int = TILE) -> DataFrame:
    """``docs`` without their text, each with ``component_id`` and ``root`` of its near-duplicates.

    A fingerprint of 64 bits within 4 bits finds texts that are almost the same; shingle sets of
    similarity 0.8 differ in a seventh of their bits. So a signature of 1024 bits has 25
    lanes of 40 bits, pairs within 4 bits are found in each lane (a pair of similarity 0.8
    meets in a lane with chance 0.26, in one of 25 with 0.999), and pairs that meet are filtered
    on the whole signature and confirmed on their shingle sets.

    Texts that are only half alike meet too, in a large family nearly each with each. So a few
    lanes, with star links in a crowd, come first and form families of related texts (signatures as close
    as at similarity ``RELATED``); all pairs of a family are tested where its blocks meet
    (``within_families``), and what leaves a task are links, about one a text. Then every pair
    of different families that meets in any lane is tested (``alike``), at crowded points on
    the signatures in the task, so no meeting pair is left untested. Two texts with nothing in
    common meet in a lane with chance 9e-8: for far more than 10^8 different texts take wider
    and more lanes.
    """
    kept = [c for c in docs.columns if c not in (text, "component_id", "root", "sig", "lanes", "node", "text_key")]
    rows = with_signature(docs.select(*kept, text), text, size)
    rows = written(rows.select(*kept, "node", "sig", "lanes", F.xxhash64(text).alias("text_key")), "signatures")
    nodes = written(rows.groupBy("node").agg(F.first("sig").alias("sig"), F.first("lanes").alias("lanes"), F.min("text_key").alias("text_key"), F.min(doc_id).alias("first_id")), "nodes")
    texts = docs.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))

    star = written(near(met(nodes, FIRST_LANES, variants_per_task, similarity).distinct(), nodes, RELATED), "related")
    found = components(star)
    families = written(found.select("node", F.col("root").alias("family")).union(found.select("root", "root").distinct()), "families")
    links = written(within_families(families, nodes, texts, size, similarity, tile), "family-links")
    grouped = written(nodes.join(families, "node", "left").select("node", "sig", "lanes", F.coalesce("family", "node").alias("group")), "groups")
    rest = written(met(grouped, LANES, variants_per_task, similarity, "rest").distinct(), "rest")
    crowded = written(grouped.join(rest.where("b IS NULL").select(F.col("a").alias("node")), "node", "left_semi"), "crowded")
    pairs = rest.where("b IS NOT NULL").union(met(crowded, LANES, variants_per_task, similarity, "crowded")).distinct()
    roots = components(links.union(alike(pairs, nodes, texts, size, similarity)))
    rooted = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select("node", "root", "component_id")
    return rows.join(named, "node", "left").select(*kept, "component_id", "root")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest id (NULL ids last)."""
    row = F.xxhash64(*docs.columns)
    narrow = similar(docs.select(F.col(doc_id).alias("_id"), row.alias("_row"), F.col(text).alias("_text")), "_text", "_id", size, similarity)
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    stay = narrow.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.r").alias("_row"), F.col("m.i").alias("_stay"))
    whole = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("_id"), row.alias("_row"))
    whole = whole.groupBy("_row", "_id").agg(F.first("doc").alias("doc"))  # rows equal in all columns are one
    return whole.join(stay, (whole["_row"] == stay["_row"]) & whole["_id"].eqNullSafe(stay["_stay"]), "left_semi").select("doc.*")
