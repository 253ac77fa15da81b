"""Phrase collocations by prefix-free parsing of a corpus.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and at spaces and tabs into words. A piece is parsed
into chunks whose ends depend on content alone: a chunk ends after the last of OVERLAP words whose joint hash is 0 modulo
`spread`, and the next one begins with those same words. As the overlap is one word less than the longest phrase, each
occurrence of a phrase lies within a chunk, and it belongs to the chunk in which it ends beyond the overlap. Equal chunks
make one row of the dictionary, with the frequency they have in the parse; from then on only distinct chunks are read, and
what is counted in them is weighted.

Phrases are counted length by length. An occurrence of n words is a candidate only if both its parts of n - 1 words are
frequent, which a bitmap of FILTER_BITS hashed counts says; its size is fixed, and a full one only lets more through. Hashes
of 64 bits, combined within a task, are what is shuffled; those with less than `least` occurrences can't hold a frequent
phrase. The words themselves are then read once more for what passed, and counted exactly: a clash of hashes costs a row,
never a count.

Scores compare whole numbers, by decimals of 38 digits. A null text is empty, a null language is `und`; repeated rows count
as often as they are there. An empty table, or one without a frequent phrase, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.llm.common import drop, written

MOST_WORDS = 4
OVERLAP = MOST_WORDS - 1
LEAST, SPREAD, TOP = 30, 24, 2000
#: The size of the bitmap of frequent hashes: 8 MB.
FILTER_BITS = 1 << 26
#: Bytes that are hashed at a time.
_BLOCK = 1 << 22
#: Piece ends become line feeds, tabs spaces.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_SPACES = re.compile(rb" {2,}")
#: An odd multiplier, its inverse modulo 2^64, and one more.
_POWER = 0x9E3779B97F4A7C15
_BACK, _MIX = pow(_POWER, -1, 1 << 64), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def joint(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by their first; the last n - 1 places don't have one."""
    out = h.copy()
    for k in range(1, n):
        out[: len(h) - k] = _mixed(out[: len(h) - k] * np.uint64(_POWER) + h[k:])
    return out[: max(len(h) - n + 1, 0)]


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))


_FORTH, _HOME = _powers(_POWER, _BLOCK), _powers(_BACK, _BLOCK)


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of each word of data, whose words are parted by spaces, line feeds and edges."""
    part = np.ones(len(data) + 1, bool)
    np.logical_or(data == 32, data == 10, out=part[:-1])
    inner = np.zeros(len(data) + 1, bool)
    inner[edges] = True
    begin = np.flatnonzero(~part[:-1] & (np.append(True, part[:-2]) | inner[:-1]))
    end = np.flatnonzero(~part[:-1] & (part[1:] | inner[1:])) + 1
    h, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + _BLOCK, side="right")))
        first, n = begin[at], int(end[to - 1] - begin[at])
        forth, home = (_FORTH, _HOME) if n <= _BLOCK else (_powers(_POWER, n), _powers(_BACK, n))
        upto = np.empty(n + 1, np.uint64)
        upto[0] = 0
        values = data[first : first + n].astype(np.uint64)
        values += np.uint64(1)
        values *= forth[:n]
        np.cumsum(values, out=upto[1:])
        # the same word has the same hash wherever it stands
        h[at:to] = _mixed((upto[end[at:to] - first] - upto[begin[at:to] - first]) * home[begin[at:to] - first])
        at = to
    return begin, end, h


def parse(texts: list[str | None], spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The chunks of texts: whose they are, whether they begin a piece, their words joined by spaces."""
    own = [(t or "").encode("utf-8", "surrogatepass").lower().translate(_ENDS) for t in texts]
    own = [_SPACES.sub(b" ", t) if b"  " in t else t for t in own]
    lengths = np.array([len(t) + 1 for t in own])
    joined = b"\n".join(own)
    data = np.frombuffer(joined, np.uint8)
    begin, end, h = _words(data, np.zeros(0, np.int64))
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, bool), []
    pieces = np.cumsum(data == 10, dtype=np.int32)[begin]
    lead = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1]))
    over = np.append(lead[1:], len(begin))
    # the word after each run that triggers, where the run lies within a piece and something follows
    at = np.flatnonzero(joint(h, OVERLAP) % np.uint64(spread) == 0) + OVERLAP
    at = at[at < len(begin)]
    at = at[pieces[at - OVERLAP] == pieces[at]]
    first = np.concatenate([lead, at - OVERLAP])
    order = np.lexsort((np.arange(len(first)) >= len(lead), first))
    first, heads = first[order], order < len(lead)
    last = np.append(first[1:], 0) + OVERLAP
    ends_piece = np.append(heads[1:], True)
    last[ends_piece] = over[np.searchsorted(lead, first[ends_piece], side="right") - 1]
    whose = np.searchsorted(np.cumsum(lengths), begin[first], side="right")
    return whose, heads, [joined[a:b] for a, b in zip(begin[first].tolist(), end[last - 1].tolist(), strict=True)]


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", spread: int = SPREAD) -> DataFrame:
    """lang, head, chunk and f: the distinct chunks of each language, with their frequency in the parse."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, "t"):
                whose, heads, found = parse(rows["t"].to_pylist(), spread)
                yield pa.record_batch([rows["l"].take(pa.array(whose)), pa.array(heads), pa.array(found, pa.binary())], names=["lang", "head", "chunk"])

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(chunks, "lang string, head boolean, chunk binary").groupBy("lang", "head", "chunk").agg(F.count("*").alias("f"))


def _slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes in a column, at least a row each."""
    sizes = np.cumsum([0, *np.diff(_offsets(batch[column]))])
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)


class Chunks:
    """Chunks of a batch as one run of words, with the hashes of their words; those of different languages differ."""

    def __init__(self, rows: pa.RecordBatch):
        offsets = _offsets(rows["chunk"])
        self.data = np.frombuffer(rows["chunk"].buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        self.begin, self.end, h = _words(self.data, edges)
        leads = np.zeros(len(self.data), bool)
        leads[edges[:-1]] = True  # no chunk is empty
        leads = np.flatnonzero(leads[self.begin])
        lengths = np.diff(leads, append=len(self.begin))
        self.chunk, at = np.repeat(np.arange(len(rows)), lengths), np.arange(len(self.begin))
        #: words up to the chunk's end, and words from the chunk's begin
        self.place = at - np.repeat(leads, lengths)
        self.left = np.repeat(lengths, lengths) - self.place
        langs = rows["lang"].dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()[self.chunk]
        self.f = rows["f"].to_numpy()[self.chunk]
        self.own = np.where(rows["head"].to_numpy(zero_copy_only=False), 0, OVERLAP)[self.chunk]
        seeds = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in self.langs], np.uint64)
        self.h = _mixed(h ^ seeds[self.lang])

    def places(self, n: int) -> np.ndarray:
        """Where a run of n words begins that belongs to its chunk."""
        return np.flatnonzero((self.left >= n) & (self.place + n > self.own))


    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The runs of n words that begin at these places."""
        begin, size = self.begin[at], self.end[at + n - 1] - self.begin[at]
        ends = np.append(0, np.cumsum(size))
        data = self.data[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _sums(codes: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
    """Sum of f by code; in whole numbers, as a slice's are far below 2^53."""
    return np.bincount(codes, f, n).astype(np.int64)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _frequent(chunks: Chunks, n: int, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n words that the bitmaps of 1 to len(bits) words let through: where they begin, and their hashes."""
    at, h = chunks.places(n), joint(chunks.h, n)
    for k in range(1, min(n, len(bits)) + 1):
        passed = np.zeros(len(chunks.h), bool)
        if len(chunks.h) >= k:
            passed[: len(chunks.h) - k + 1] = _has(bits[k - 1], joint(chunks.h, k))
        for shift in range(n - k + 1):
            at = at[passed[at + shift]]
    return at, h[at]


def _counted(chunks: DataFrame, n: int, bits) -> DataFrame:
    """h and f: hashes of candidate phrases of n words with at least as many occurrences as any of them has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _bits(bits)
        for batch in batches:
            for rows in _slices(batch, "chunk"):
                part = Chunks(rows)
                at, h = _frequent(part, n, known)
                found = pa.array(h.view(np.int64)).dictionary_encode()
                f = _sums(found.indices.to_numpy(), part.f[at], len(found.dictionary))
                yield pa.record_batch([found.dictionary, pa.array(f)], names=["h", "f"])

    return chunks.mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _bits(broadcasts: list) -> list[np.ndarray]:
    return [np.frombuffer(b.value, np.uint64) for b in broadcasts]


def _bitmap(frequent: DataFrame) -> bytes:
    """FILTER_BITS bits of the hashes, put together by Spark as words of 64: at most 2^20 rows, however many hashes."""
    at = F.col("h").bitwiseAND(FILTER_BITS - 1)
    words = frequent.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & {63} as int))")).alias("b")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.tobytes()


def _exact(chunks: DataFrame, bits) -> DataFrame:
    """lang, n, phrase, f of the phrases of 1 to MOST_WORDS words that the bitmaps let through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _bits(bits)
        for batch in batches:
            for rows in _slices(batch, "chunk"):
                part = Chunks(rows)
                for n in range(1, MOST_WORDS + 1):
                    at, _ = _frequent(part, n, known)
                    found = part.texts(at, n).dictionary_encode()
                    key, langs = found.indices.to_numpy() * len(part.langs) + part.lang[at], pa.array(part.langs, pa.string())
                    f = _sums(key, part.f[at], len(found.dictionary) * len(part.langs))
                    key = np.flatnonzero(f)
                    phrase = found.dictionary.take(pa.array(key // max(len(langs), 1))).cast(pa.large_string()).cast(pa.string())
                    yield pa.record_batch([langs.take(pa.array(key % max(len(langs), 1))), pa.array(np.full(len(key), n, np.int32)), phrase, pa.array(f[key])], names=["lang", "n", "phrase", "f"])

    return chunks.mapInArrow(count, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def frequencies(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, n, phrase, f: all phrases of 1 to MOST_WORDS words with at least `least` occurrences."""
    sc, bits = chunks.sparkSession.sparkContext, []
    for n in range(1, MOST_WORDS + 1):
        bits.append(sc.broadcast(_bitmap(_counted(chunks, n, bits).where(F.col("f") >= least))))
    return _exact(chunks, bits).where(F.col("f") >= least)


def _parts(n_words: Column, phrase: Column) -> Column:
    """Each cut of a phrase after its first k words: k, the first part and the rest."""
    w = F.split(phrase, " ", -1)
    return F.transform(F.sequence(F.lit(1), n_words - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(w, k + 1, n_words - k), " ").alias("rest")))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered: int = 80, spread: int = SPREAD) -> DataFrame:
    """Each language's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the frequencies of the phrase and of the two parts at the cut with the lowest score, floor(2000000 a / (l + r));
    n is the language's number of words. A phrase goes if a longer frequent one that holds it has `covered` percent of its frequency.
    """
    chunks = written(dictionary(docs, text, lang, spread), "chunks")
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("f") * (F.size(F.split(F.decode("chunk", "UTF-8"), " ", -1)) - F.when(F.col("head"), 0).otherwise(OVERLAP))).alias("n"))
    found = written(frequencies(chunks, least), "phrases")

    long = found.where("n >= 2").withColumnRenamed("f", "a")
    cuts = long.select("lang", "n", "phrase", "a", F.explode(_parts(F.col("n"), F.col("phrase"))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")

    w = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    holders = long.where("n >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    tenths = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    kept = best.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (tenths("held", 100) < tenths("a", covered)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = written(ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop(chunks, found)
    return out


SQL = """
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM docs
), grams AS (
  SELECT lang, m AS n, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM pieces CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), counted AS (
  SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE n = 1 GROUP BY lang
), candidates AS (
  SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE n >= 2 AND f >= 30
), cuts AS (
  SELECT c.lang, c.n, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, n)) AS k FROM candidates) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.n], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM (SELECT *, unnest(range(2, n)) AS m FROM candidates))
), holders AS (
  SELECT lang, phrase, max(a) AS held FROM inner_phrases GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN holders h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE h.held IS NULL OR 100 * CAST(h.held AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, s.n AS n, score FROM ranked JOIN sizes s USING (lang) WHERE rank <= 2000
"""
