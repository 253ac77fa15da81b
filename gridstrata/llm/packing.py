"""Best-fit packing of token pieces into sequences, with a swap-based local search.

A document is its ids by the tokenizers library and a closing id 0. Longer documents are cut into pieces of `size` tokens of
which the first may be shorter; a whole piece is a sequence. The rest is packed block by block: best fit of falling
lengths, then a local search between underfull sequences, from the emptiest on: it moves a piece, exchanges one for one, or
one for two, always so that the sum of squared fills rises, until a sequence is empty or no step is left. The stored pieces
(numbers, no texts) are counted and dealt to blocks of about BLOCK by a hash of all that they hold, whichever files they come
from: each block has the mix of lengths of the whole and leaves little free space, and the result is the same for any layout
of files. Pieces that are equal in everything are one row and a count, and are dealt COPIES at a time, so that no key makes
a block of its own.

Tokenization encodes each distinct part of a slice of texts once. Texts are cut by Arrow before each blank or line feed that
follows a printable ASCII or letter character, after line feeds, and between a Latin letter and a mark, where no match of the
byte-level pattern can span the cut; other texts go to the library as they are. Arrow numbers the parts, those that the worker
process doesn't know yet are encoded by the library (words by its model), and numpy gathers the ids of the texts. A process keeps up to CACHE_PARTS parts: those of the older half that are not met again go. Null text is empty: one
id 0. Repeated rows are packed each for itself. Other columns are not read. doc_id is a number, or text that casts to one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm.common import written

SIZE, BLOCK, COPIES, CACHE_PARTS = 2048, 16_384, 16, 600_000
#: White space other than blank and line feed, or a mark of our own; like two white spaces in a row, they have a text encoded whole.
_UNSAFE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: How the byte-level alphabet writes bytes: those that Latin-1 doesn't print as the characters from U+0100 on, in order.
_ALPHABET = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Latin letters, marks that aren't an apostrophe; a part that is a word, a single match of the byte-level pattern.
_LATIN, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?"
_WORD = re.compile(f" ?[{_LATIN}]+")
_TWO = ("  ", " \n", "\n ", "\n\n")
#: Bytes of text of a slice, and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 22, 1 << 13

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.own, self.kept, self.before = tokenizer(path), {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, single matches, which the library's model takes as they are, written in the byte-level alphabet."""
        written = "\0".join(words).encode().decode("latin-1").translate(_ALPHABET).split(chr(_ALPHABET[0]))
        tokens = list(map(self.own.model.tokenize, written)) if words else []
        raw = np.array([t.id for own in tokens for t in own], "<u4").tobytes()
        ends = [0, *accumulate(4 * len(own) for own in tokens)]
        return [raw[a:b] for a, b in pairwise(ends)]

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.kept) > CACHE_PARTS // 2:
            self.before, self.kept = self.kept, {}
        out = list(map(self.kept.get, parts))
        missing = [p for p, found in zip(parts, out, strict=True) if found is None]
        if missing:
            new = list(map(self.before.get, missing))
            rest = [p for p, found in zip(missing, new, strict=True) if found is None]
            words = [p for p in rest if _WORD.fullmatch(p)]
            other = sorted(set(rest).difference(words))
            found = dict(zip(words + other, self._words(words) + self._whole(other), strict=True))
            found.update((p, raw) for p, raw in zip(missing, new, strict=True) if raw is not None)
            self.kept.update(found)
            out = [found[p] if raw is None else raw for p, raw in zip(parts, out, strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        safe = [k for k, t in enumerate(texts) if t and not (any(map(t.__contains__, _TWO)) or _UNSAFE.search(t))]
        out = [np.empty(0, "<u4")] * len(texts)
        if rest := sorted({k for k, t in enumerate(texts) if t} - set(safe)):
            for k, raw in zip(rest, self._whole([texts[k] for k in rest]), strict=True):
                out[k] = np.frombuffer(raw, "<u4")
        if safe:
            cut = pa.array([texts[k] for k in safe], pa.large_string())
            for old, new in (("\n", "\0\n\0"), (" ", "\0 ")):
                cut = pc.replace_substring(cut, old, new)
            cut = pc.split_pattern(pc.replace_substring_regex(cut, f"([{_LATIN}])([{_MARKS}])", "\\1\0\\2"), "\0")
            coded = cut.flatten().dictionary_encode()
            raw = self.parts(coded.dictionary.to_pylist())
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            codes, ids = coded.indices.to_numpy(), np.frombuffer(b"".join(raw), "<u4")
            # where each part's ids start in what is known, and where in the texts
            at, lengths = np.cumsum(size) - size, size[codes]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            flat = ids[np.repeat(at[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
            bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
            for k, a, b in zip(safe, bounds, bounds[1:]):
                out[k] = flat[a:b]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that what a task has seen serves the next."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """PIECES of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        for batch in batches:
            # a slice ends where its texts reach SLICE_BYTES
            end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(batch):
                b = min(a + SLICE_ROWS, max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + SLICE_BYTES))))
                ids, texts = (c.to_pylist() for c in batch.slice(a, b - a).columns)
                a, out = b, []
                for d, own in zip(ids, encode([t or "" for t in texts]), strict=True):
                    n, raw = len(own) + 1, memoryview(own).cast("B") if len(own) else b""
                    first = n - (n - 1) // size * size
                    for k, start in enumerate([0, *range(first, n, size)]):
                        end_ = first if k == 0 else start + size
                        crc = zlib.crc32(raw[4 * start : 4 * end_])
                        out.append((d, k, start, end_ - start, zlib.crc32(bytes(4), crc) if end_ == n else crc))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    names = [x.split()[0] for x in PIECES.split(", ")]
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(read, PIECES)


def best_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Bins of indices: each length, from the largest on, goes where it leaves least free."""
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    some, bins = 0, []  # bit f of some: there is a bin with f free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > n:
            by_free[free - n].append(b)
            some |= 1 << (free - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Local search between underfull bins."""
    full = [b for b in bins if sum(lengths[i] for i in b) == size]
    open_ = sorted((b for b in bins if sum(lengths[i] for i in b) < size), key=lambda b: -sum(lengths[i] for i in b))
    fill = {id(b): sum(lengths[i] for i in b) for b in open_}
    stuck: list[list[int]] = []
    while len(open_) > 1:
        source = open_.pop()
        moved = True
        while source and moved:
            moved = False
            for target in open_:
                step = _step(source, target, lengths, size - fill[id(target)])
                if step:
                    gone, back = step
                    for i in gone:
                        source.remove(i)
                    for i in back:
                        target.remove(i)
                    target += gone
                    source += back
                    gain = sum(lengths[i] for i in gone) - sum(lengths[i] for i in back)
                    fill[id(target)] += gain
                    fill[id(source)] -= gain
                    moved = True
                    if not source:
                        break
            full += [b for b in open_ if fill[id(b)] == size]
            open_ = [b for b in open_ if fill[id(b)] < size]
        if source:
            stuck.append(source)
        open_.sort(key=lambda b: -fill[id(b)])
    return full + open_ + stuck


def _step(source: list[int], target: list[int], lengths: list[int], free: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills the target most: (from source, from target). The target is the fuller, so squares rise."""
    best, out = 0, None
    for i in source:
        a = lengths[i]
        if best < a <= free:
            best, out = a, ([i], [])
        for j in target:
            gain = a - lengths[j]
            if best < gain <= free:
                best, out = gain, ([i], [j])
        if best == free:
            return out
    for x, i in enumerate(source):
        for j in source[x + 1 :]:
            a = lengths[i] + lengths[j]
            if best < a <= free:
                best, out = a, ([i, j], [])
            for k in target:
                gain = a - lengths[k]
                if best < gain <= free:
                    best, out = gain, ([i, j], [k])
            if best == free:
                return out
    for x, j in enumerate(target):
        for k in target[x + 1 :]:
            b = lengths[j] + lengths[k]
            for i in source:
                gain = lengths[i] - b
                if best < gain <= free:
                    best, out = gain, ([i], [j, k])
    return out


def dealt(stored: DataFrame, blocks: int) -> DataFrame:
    """b, n and the columns of PIECES: each distinct piece in n copies, for block b, partitioned by block and in one order."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    rows = stored.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long"), F.lit(COPIES).cast("long"))))
    rows = rows.select(F.pmod(F.xxhash64(*names, "_k"), F.lit(blocks)).alias("b"), F.least(F.lit(COPIES), F.col("_n") - F.col("_k")).cast("int").alias("n"), *names)
    return rows.repartitionById(blocks, F.col("b").cast("int")).sortWithinPartitions("b", *names, "n")


def packed(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """PACKED: every piece with its sequence and place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            number = rows.column("b")[0].as_py() << 36
            rows = rows.take(pa.array(np.repeat(np.arange(len(rows)), rows.column("n").to_numpy()))).drop_columns(["b", "n"])
            lengths = rows.column("length").to_pylist()
            short = [i for i, n in enumerate(lengths) if n < size]
            own = [lengths[i] for i in short]
            bins = [[i] for i, n in enumerate(lengths) if n >= size] + [[short[i] for i in b] for b in improve(best_fit(own, size), own, size)]
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for b in bins:
                at = 0
                for i in b:
                    sequence[i], offset[i] = number, at
                    at += lengths[i]
                number += 1
            out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[0].column(0)[0].as_py() != int(blocks[a]):
                    yield close()
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield close()

    # stored first, so that texts are read once and a repeated task packs the same rows
    stored = written(pieces(docs, tokenizer_file, text, doc_id, size), "pieces")
    return dealt(stored, max(1, round(stored.count() / block))).mapInArrow(pack, PACKED)
