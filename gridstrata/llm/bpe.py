"""Byte-level BPE with the tiktoken library and a local rank file.

Each match of the split pattern is encoded on its own, so a text may be cut wherever no match can span the cut. A cut
before an ASCII blank or line feed that follows an ASCII letter, digit or mark is such a place: every alternative of the
pattern is either all white space or has white space in its first place only, and only looks ahead. Long texts are encoded
piece by piece between such places, which bounds the memory of one call; a long text without such a place goes in one call.

Null text is the empty text: no ids, no bytes. Other columns pass through and never reach Python.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Characters of a text that are encoded in one call, about.
PIECE_CHARS = 32_768

_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The library's encoder for a rank file; one per worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text, cut at the first safe boundary after every `size` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _lists(batch: pa.Array, ids_of) -> tuple[pa.Array, list]:
    """The ids of each text as one flat array, as lists of Python numbers would take ten times the memory, and what else
    ids_of(text), a generator of (ids, other), gives for each text's pieces."""
    own, ends, others = [np.empty(0, np.int32)], [0], []
    for t in batch:
        found = [(np.array(ids, np.int32), other) for ids, other in ids_of(t.as_py() or "")]
        own += [ids for ids, _ in found]
        ends.append(ends[-1] + sum(len(ids) for ids, _ in found))
        others.append([other for _, other in found])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own))), others


def encode(text: Column, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> Column:
    """array<int>: the ids of each text, without special tokens."""

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield _lists(batch, lambda text: ((enc.encode_ordinary(piece), None) for piece in pieces(text, piece_chars)))[0]

    return ids(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """binary: the bytes of each list of ids, whether or not they are whole UTF-8 characters; none for null."""

    @arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield pa.array([enc.decode_bytes(x.as_py() or []) for x in batch], pa.binary())

    return raw(ids)


def encode_and_decode(text: Column, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> Column:
    """struct<ids array<int>, decoded binary>: encode(), and decode() of its ids, in one worker with one encoder, so that ids
    don't travel to a second one."""

    @arrow_udf("struct<ids array<int>, decoded binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)

        def coded(text: str) -> Iterator[tuple[list[int], bytes]]:
            for piece in pieces(text, piece_chars):
                ids = enc.encode_ordinary(piece)
                yield ids, enc.decode_bytes(ids)

        for batch in batches:
            ids, raw = _lists(batch, coded)
            yield pa.StructArray.from_arrays([ids, pa.array([b"".join(parts) for parts in raw], pa.binary())], ["ids", "decoded"])

    return both(text)


def with_tokens(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of its texts and what they decode to (columns of those names are replaced)."""
    both = encode_and_decode(F.col(text), rank_file, pattern)
    own = [c for c in docs.columns if c not in (ids, decoded)]
    # own columns travel as one, so that their names don't matter
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), both.alias("both"))
    return wide.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("both.ids").alias(ids), F.col("both.decoded").alias(decoded))
