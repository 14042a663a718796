"""Token counts of fields and sections from one encoding of the whole document.

A document is its fields joined by line ends; its sections are the short fields, and the lines
of the long one. Sections part the document: a line end belongs to the section before it.
The whole document is encoded once by a byte-level tokenizer whose pieces' lengths give every
token's span exactly. Spans meet sections in an interval join (both are sorted, so it is a
binary search), and a token that crosses a boundary goes to one section by ``rule``:

* ``start``: the section of its first byte; ``end``: that of its last byte;
* ``most``: the section with most of its bytes, the earliest on a tie.

Scale: no shuffle; each task encodes its own rows. Memory is one Arrow batch and one document.

Defined results: NULL fields are empty sections; every document has one section per short
field and at least one for the text, even when empty; tokens of a document always add up to
its encoding's length; repeated rows are counted each; ids may be NULL; texts that look like
special tokens are ordinary text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

RANKS = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "most")
ROWS = 20_000  # of one output batch


@cache
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer and the number of bytes of each of its tokens."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        sizes[i] = len(piece)
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def allocate(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and tokens that reach into each section from before it.

    ``sizes`` are the tokens' lengths in bytes, ``bounds`` the sections' first bytes.
    """
    end = np.cumsum(sizes)
    start = end - sizes
    first, last = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, end - 1, "right") - 1
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    else:
        owner = first.copy()
        for t in np.flatnonzero(first != last):
            edges = np.concatenate([[start[t]], bounds[first[t] + 1 : last[t] + 1], [end[t]]])
            owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    n = len(bounds)
    # section s is entered in mid-token when a token starts before it and ends in or after it
    reach = np.zeros(n + 1, np.int64)
    crossing = first != last
    np.add.at(reach, first[crossing] + 1, 1)
    np.add.at(reach, last[crossing] + 1, -1)
    return np.bincount(owner, minlength=n), np.cumsum(reach)[:n]


def section_tokens(docs: DataFrame, fields: list[str], text: str = "text", doc_id: str = "doc_id", rule: str = "start", path: str | None = None) -> DataFrame:
    """A row per section: field, number, span in code points, its tokens, tokens it shares with the section before."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_tokenizers.path(RANKS)
    names = [*fields, text]
    schema = StructType([
        StructField("doc_id", docs.schema[doc_id].dataType), StructField("section", IntegerType()), StructField("field", StringType()),
        *[StructField(c, LongType()) for c in ("start", "end", "n_tokens", "n_shared", "doc_tokens")],
    ])
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sizes = encoding(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]

            def flush() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(out[0], pa.int64()))
                done = pa.RecordBatch.from_arrays([ids, *[pa.array(x, k) for x, k in zip(out[1:], kinds)]], schema.names)
                for x in out:
                    x.clear()
                return done

            columns = [batch.column(1 + i).to_pylist() for i in range(len(names))]
            for row, values in enumerate(zip(*columns)):
                parts = [v or "" for v in values[:-1]] + (values[-1] or "").split("\n")
                whole = "\n".join(parts)
                lengths = np.array([len(p) + 1 for p in parts])
                bytes_ = np.array([len(p.encode()) + 1 for p in parts])
                lengths[-1] -= 1
                bytes_[-1] -= 1
                tokens = np.asarray(tokenizer.encode_to_numpy(whole, disallowed_special=())) if whole else np.zeros(0, np.int64)
                bounds = np.cumsum(bytes_) - bytes_
                owned, shared = allocate(sizes[tokens], bounds, rule)
                ends = np.cumsum(lengths)
                n = len(parts)
                out[0] += [row] * n
                out[1] += range(n)
                out[2] += [*names[:-1], *[names[-1]] * (n - len(names) + 1)]
                out[3] += (ends - lengths).tolist()
                out[4] += ends.tolist()
                out[5] += owned.tolist()
                out[6] += shared.tolist()
                out[7] += [len(tokens)] * n
                if len(out[0]) >= ROWS:
                    yield flush()
            if out[0]:
                yield flush()

    return docs.select(F.col(doc_id), *[F.col(c).cast("string") for c in names]).mapInArrow(count, schema)
