"""Hard negatives by a vertical scan of vectors in dimension order (BOND).

Vectors are integers, floor(scale * x). Rows and anchors are dealt to blocks by a hash of their stored row number, and each
pair of blocks is one task: so a pass costs its share of anchors times rows, and no task holds more than a block of each. A
block is columns, one per dimension, with their least and greatest values. An anchor reads the columns in falling order of
its own magnitudes; what the columns not yet read can add at least and at most bounds each row's score, and rows that can't
come in leave the candidate bitmap. What is left when all columns are read has exact scores.

Two passes: the first finds each anchor's first positives of its own label, the second the rows of other labels whose score
lies in a window set by each positive's. Blocks give their own first few, and a ranking over blocks gives the anchor's.

Rows without a label, without a vector, or with a null or non-finite component take no part. Vectors of unequal length are
filled up with zeros. A null vec_id takes part as a candidate and counts as the largest id. Repeated rows are rows of their
own: another row with an anchor's id may be its positive. Scores must fit 64 bits, or the job ends with an error. An empty
table, an anchor without another row of its label, or a positive score below 0, whose window is empty, gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.llm.common import drop, written

BLOCK_ROWS, BLOCK_ANCHORS, STEP = 16384, 2048, 8
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1

_FOUND = pa.schema([("a_row", pa.int64()), ("anchor_id", pa.int64()), ("p_row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("n_row", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
_KNOWN = pa.schema(list(_FOUND)[:5])


class Columns:
    """A block of rows as columns of integers."""

    def __init__(self, rows: pa.Table, dims: int):
        self.row, self.id = (rows[c].to_numpy() for c in ("row", "id"))
        self.label = rows["label"].to_numpy()
        self.x = np.ascontiguousarray(matrix(rows["v"], dims).T)
        wide = int(np.abs(self.x).max(initial=0)) ** 2 * max(dims, 1)
        if wide < 1 << 31:
            self.x = self.x.astype(np.int32)
        self.low, self.high = (f(axis=1, initial=0) for f in (self.x.astype(np.int64).min, self.x.astype(np.int64).max))

    def scan(self, q: np.ndarray, live: np.ndarray, keep: Callable[[np.ndarray, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `live` that `keep`, given what is summed up and the least and most that may come, lets pass; their scores."""
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.low, q * self.high])[:, order]
        least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(0), ends.max(0)))
        narrow = self.x.dtype == np.int32 and int(np.abs(q).max(initial=0)) * int(max(self.high.max(initial=0), -self.low.min(initial=0))) * max(len(q), 1) < 1 << 31
        total, columns = np.zeros(len(live), np.int32 if narrow else np.int64), self.x
        for k, d in enumerate(order, 1):
            column = columns[d] if len(live) == columns.shape[1] else columns[d][live]
            total += column * total.dtype.type(q[d])
            if (k % STEP == 0 or k == len(order)) and len(live):
                pass_on = keep(total, int(least[k]), int(most[k]))
                if not pass_on.all():
                    live, total = live[pass_on], total[pass_on]
        if not len(order):
            live = live[keep(total, 0, 0)]
        return live, total.astype(np.int64)[: len(live)]

    def first(self, live: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first rows by score, then id, then row number."""
        at = np.lexsort((self.row[live], self.id[live], -score))[:most]
        return live[at], score[at]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _at_most(score: np.ndarray, n: int) -> int:
    """The n-th largest."""
    return int(np.partition(score, len(score) - n)[len(score) - n])


def positives(rows: pa.Table, anchors: pa.Table, dims: int, most: int) -> pa.Table:
    """Each anchor's first rows of its label in this block."""
    block, out = Columns(rows, dims), []
    by_label = {k: np.flatnonzero(block.label == k) for k in np.unique(block.label)}

    def keep(total: np.ndarray, least: int, greatest: int) -> np.ndarray:
        # a row stays if it can reach what `most` rows have for sure
        return np.ones(len(total), bool) if len(total) <= most else total >= _at_most(total, most) - (greatest - least)

    for q, row, vec_id, label in zip(matrix(anchors["v"], dims), anchors["row"].to_pylist(), anchors["id"].to_pylist(), anchors["label"].to_pylist(), strict=True):
        live = by_label.get(label, np.zeros(0, np.int64))
        live, score = block.first(*block.scan(q, live[block.row[live] != row], keep), most)
        out += [(row, vec_id, r, i, s) for r, i, s in zip(block.row[live].tolist(), block.id[live].tolist(), score.tolist(), strict=True)]
    return _table(out, _KNOWN)


def negatives(rows: pa.Table, anchors: pa.Table, dims: int, most: int, share: tuple[int, int]) -> pa.Table:
    """For each anchor and positive, the first rows of other labels in this block with a score in the positive's window."""
    block, out = Columns(rows, dims), []
    others = {k: np.flatnonzero(block.label != k) for k in {*anchors["label"].to_pylist()}}
    for q, row, vec_id, label, known in zip(matrix(anchors["v"], dims), anchors["row"].to_pylist(), anchors["id"].to_pylist(), anchors["label"].to_pylist(), anchors["known"].to_pylist(), strict=True):
        windows = [(-(-share[0] * p["score"] // 100), share[1] * p["score"] // 100, p) for p in known]
        windows = [w for w in windows if w[0] <= w[1]]
        if not windows:
            continue

        def keep(total: np.ndarray, least: int, greatest: int, windows=windows) -> np.ndarray:
            passed = np.zeros(len(total), bool)
            for low, high, _ in windows:
                sure = total[(total >= low - least) & (total <= high - greatest)]
                if len(sure) > most:  # so many are in the window at least as high
                    low = max(low, _at_most(sure, most) + least)
                passed |= (total >= low - greatest) & (total <= high - least)
            return passed

        live, score = block.scan(q, others[label], keep)
        for low, high, p in windows:
            inside = (score >= low) & (score <= high)
            at, s = block.first(live[inside], score[inside], most)
            out += [(row, vec_id, p["row"], p["id"], p["score"], r, i, x) for r, i, x in zip(block.row[at].tolist(), block.id[at].tolist(), s.tolist(), strict=True)]
    return _table(out, _FOUND)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{c} long" for c in schema.names)


def _in_blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
    """work over every pair of a block of rows and a block of anchors."""
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    b, a = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    left = rows.select("*", deal(b).alias("b"), across(a).alias("a")).groupBy("b", "a")
    # columns of their own: a cogroup can't tell two sides apart that come from one table
    right = anchors.select(*(F.col(c).alias(c) for c in anchors.columns), across(b).alias("b"), deal(a).alias("a")).groupBy("b", "a")
    return left.cogroup(right).applyInArrow(lambda x, y: work(x, y) if len(x) and len(y) else _table([], schema), _ddl(schema))


def _ranked(df: DataFrame, keys: list[str], kind: str, most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(f"{kind}_score").desc(), f"{kind}_id", f"{kind[0]}_row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mined(rows: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 10, share: tuple[int, int] = (30, 90), vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor (rows where is_anchor holds),
    its first n_positives rows of the same label, and each one's first n_negatives rows of other labels whose scores are
    share percent of the positive's."""
    x = F.col(vector)
    usable = F.col(label).isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = rows.where(F.coalesce(usable, F.lit(False))).select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(scale * e.cast("double")).cast("long")).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("row"),
    )
    kept = written(kept, "vectors")  # the row numbers stay the same however often it is read
    size = kept.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    dims = int(size["dims"] or 0)
    if dims and int(size["top"] or 0) ** 2 * dims >= 1 << 63:
        raise ValueError("scores of these vectors don't fit 64 bits")
    base, anchors = kept.select("row", "id", "label", "v"), kept.where("anchor").select("row", "id", "label", "v")
    found = _in_blocks(base, anchors, size["n"], size["a"], lambda r, a: positives(r, a, dims, n_positives), _KNOWN)
    known = _ranked(found, ["a_row"], "positive", n_positives).groupBy(F.col("a_row").alias("row"))
    known = written(known.agg(F.collect_list(F.struct(F.col("p_row").alias("row"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("known")), "positives")  # n_positives an anchor
    found = _in_blocks(base, anchors.join(known, "row"), size["n"], size["a"], lambda r, a: negatives(r, a, dims, n_negatives, share), _FOUND)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = written(
        _ranked(found, ["a_row", "p_row"], "negative", n_negatives).select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score"), "hard_negatives"
    )
    drop(kept, known)
    return out


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""
