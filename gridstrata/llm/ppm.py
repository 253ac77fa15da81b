"""Language ID by prediction with partial matching over bytes.

For each language, counts of byte (k+1)-grams for k = 0..ORDER form a variable-order context tree. A context with n
symbols of d kinds gives a seen symbol count/(n+d) and escapes with d/(n+d) (method C); after an escape the next shorter
context predicts among the symbols not excluded, so a context's escape is divided by what the shorter one leaves. The
statistics are frozen: each gram's code length is computed once, for all languages together, and a text's score under a
language is the exact sum of its bytes' code lengths.

The trees are fitted on a bounded sample: at most `sample_docs` labelled rows a language, those with the smallest hashes of
their ids, whole texts; counting is a Spark aggregate and the model's size is bounded by the sample's. Every text is then
scored whole, in windows of bounded memory.

Null text, or text without a letter: `und`, score 0. Ties go to the language that sorts first. Training rows without text or
language are left out; with no training row at all every text is `und`. Only text and language are read; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridstrata.llm.common import smallest_hashes

ORDER = 3
SAMPLE_DOCS = 1200
#: Positions scored at once.
WINDOW = 1 << 21
UNKNOWN = "und"
#: Bytes of context before a text.
START = b"\n" * ORDER


def grams(data: np.ndarray) -> np.ndarray:
    """The (ORDER+1)-gram that ends at each byte from the fourth on, as a number."""
    g = data[ORDER:].astype(np.uint32)
    for k in range(ORDER):
        g |= data[k : len(data) - ORDER + k].astype(np.uint32) << np.uint32(8 * (ORDER - k))
    return g


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n: summed over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                g = [grams(np.frombuffer(START + t.encode(), np.uint8)) for t in texts]
                value, n = np.unique(np.concatenate(g), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": value.astype(np.int64), "n": n})

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Row numbers of 32-bit keys: open tables, each key in the first one where its place is free."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, seed = [], np.arange(len(keys), dtype=np.int32), 2654435769
        while len(left):
            bits = max(4, int(np.ceil(np.log2(len(left)))) + 2)
            row = np.full(1 << bits, -1, np.int32)
            at = self._place(keys[left], seed, bits)
            row[at[::-1]] = left[::-1]
            key = keys[np.maximum(row, 0)]
            self.levels.append((seed, bits, row, key))
            left = left[row[at] != left]
            seed = (seed * 2246822519 + 2) & 0xFFFFFFFF | 1

    @staticmethod
    def _place(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
        return (keys * np.uint32(seed)) >> np.uint32(32 - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key isn't there."""
        out, todo = np.full(len(keys), -1, np.int32), None
        for seed, bits, row, key in self.levels:
            k = keys if todo is None else keys[todo]
            at = self._place(k, seed, bits)
            hit = (key[at] == k) & (row[at] >= 0)
            if todo is None:
                out[hit] = row[at[hit]]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = row[at[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
        return out


class Trees:
    """The frozen context trees of all languages."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        own = []  # by language and order: contexts' grams, their code lengths, contexts, escape lengths
        for lang in self.langs:
            part = counts[counts["lang"] == lang]
            own.append(self._tree(part["gram"].to_numpy(np.uint32), part["n"].to_numpy(np.float64)))
        self.find, self.bits, self.find_context, self.escape = [], [], [], []
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([t[k][0] for t in own]))
            contexts = np.unique(np.concatenate([t[k][2] for t in own]))
            escape = np.zeros((len(contexts), len(own)), np.float32)
            for i, t in enumerate(own):
                escape[np.searchsorted(contexts, t[k][2]), i] = t[k][3]
            self.find_context.append(Lookup(contexts))
            self.escape.append(escape)
            # a gram that this language lacks escapes to its shorter context
            bits = (self.code(keys & np.uint32((1 << 8 * k) - 1), k - 1) if k else np.full((len(keys), len(own)), 8.0, np.float32)) + escape[np.searchsorted(contexts, keys >> np.uint32(8))]
            for i, t in enumerate(own):
                bits[np.searchsorted(keys, t[k][0]), i] = t[k][1]
            self.find.append(Lookup(keys))
            self.bits.append(bits.astype(np.float32))

    @staticmethod
    def _tree(gram: np.ndarray, n: np.ndarray) -> list:
        tree, shorter = [], None
        for k in range(ORDER + 1):
            keys, at = np.unique(gram & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n)
            contexts, first, kinds = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first)
            each = np.repeat(np.arange(len(contexts)), kinds)
            p = count / (total + kinds)[each]
            if shorter is None:
                low = np.full(len(keys), 1 / 256)
            else:
                low = shorter[np.searchsorted(last, keys & np.uint32((1 << 8 * k) - 1))]
            left = np.maximum(1 - np.add.reduceat(low, first), 1e-6)
            tree.append((keys, -np.log2(p), contexts, np.maximum(-np.log2(kinds / (total + kinds) / left), 0)))
            shorter, last = p, keys
        return tree

    def code(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of (k+1)-grams, a column a language."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        row = self.find[k](keys)
        out = self.bits[k][row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            rest = keys[miss]
            context = self.find_context[k](rest >> np.uint32(8))
            out[miss] = self.code(rest & np.uint32((1 << 8 * k) - 1), k - 1) + np.where(context[:, None] >= 0, self.escape[k][context], 0)
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out, at, held = np.zeros((len(texts), len(self.langs))), [], 0
        batch: list[bytes] = []

        def flush() -> None:
            g = np.concatenate([grams(np.frombuffer(b, np.uint8)) for b in batch])
            starts = np.cumsum([0] + [len(b) - ORDER for b in batch[:-1]])
            np.add.at(out, at, np.add.reduceat(self.code(g, ORDER), starts, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            data = START + text.encode()
            for a in range(ORDER, len(data), WINDOW):  # a long text in windows, each with its own context before it
                batch.append(data[a - ORDER : a + WINDOW])
                at.append(i)
                held += len(batch[-1])
                if held >= WINDOW:
                    flush()
                    batch, at, held = [], [], 0
        if batch:
            flush()
        return out


def sample(docs: DataFrame, text: str, lang: str, doc_id: str, sample_docs: int) -> DataFrame:
    """At most sample_docs different rows of each language, by a hash of id and text; hashes are ranked without their texts."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn("_mark", F.xxhash64(doc_id, text))
    chosen = smallest_hashes(rows.select("_mark", lang), lang, "_mark", sample_docs)
    rows = rows.join(F.broadcast(chosen), ["_mark", lang], "left_semi")  # bounded: sample_docs marks a language
    return rows.groupBy("_mark", lang).agg(F.first(text).alias(text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Trees | None:
    counts = gram_counts(sample(docs, text, lang, doc_id, sample_docs), text, lang).toPandas()  # bounded by the sample
    return Trees(counts) if len(counts) else None


def predicted(text: Column, trees: Trees | None, spark) -> Column:
    """struct<lang string, score double, bits array<double>>: the shortest code's language, its share of the total likelihood, and all code lengths."""
    kind = "struct<lang string, score double, bits array<double>>"
    if trees is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("bits"))
    shared = spark.sparkContext.broadcast(trees)  # bounded by the training sample

    @arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            bits = model.lengths([t or "" for t in batch.to_pylist()])
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -60)).sum(axis=1)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(list(bits), pa.list_(pa.float64()))], ["lang", "score", "bits"])

    found = predict(text)
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), found).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("array<double>").alias("bits")))
