"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of line hashes, range-free but sorted by hash within its partitions, with the number of documents of its
batch that hold the line and, for lines that no earlier run has, the document that keeps it. Batches come in falling order
of doc_id, so the first batch that holds a line also holds its largest doc_id: each batch is anti-joined with the runs (new
lines name their keeper) and semi-joined (known lines add to their count), and its own run goes to level 0. When a level has
FANOUT runs they are merged into one of the next level. Lines are then dropped by what the merged runs say.

A line's key is the line, stripped of ASCII white space at both ends and A-Z lower-cased; its hash is the key's MD5 of 128
bits. Keys of a document count once. Null or empty text is one empty line. Rows that share a doc_id are one document when
documents are counted, and those that share the largest doc_id all keep the line; a null doc_id is smaller than any other.
doc_id is a number. Other columns stay, whatever their names; columns of the names that are added are replaced.

Spark doesn't know the order of a run that it reads back: a merge sorts it once more, by hash and without its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.llm.common import SPACE, shared_dir, written

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FANOUT = 4, 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "h binary, n long, keeper long"


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(k: Column) -> Column:
    return F.unhex(F.md5(k.cast("binary")))


def _is_in(h: Column, run: Column, steps: Column) -> Column:
    """Whether a sorted array, not empty, holds a hash, by halving. steps: the powers of two up to its size, falling."""
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(run, at + step - 1) <= h, F.lit(False)), at + step).otherwise(at))
    return F.coalesce(F.get(run, at - 1) == h, F.lit(False))


def line_table(docs: DataFrame, text: str, doc_id: str, least_chars: int, batches: int) -> DataFrame:
    """b, d, h: batch, doc_id and hash of each distinct key that is long enough; rows that share a doc_id count as one document."""
    ids = docs.select(F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("d"))
    cuts = ids.agg(F.percentile_approx("d", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("d") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    keys = F.filter(F.transform(_lines(F.col(text)), key), lambda k: F.length(k) >= least_chars)
    each = docs.select(F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("d"), F.explode(F.array_distinct(keys)).alias("k"))
    return each.select(batch.alias("b"), "d", _hash(F.col("k")).alias("h")).distinct()


class LineRuns:
    """Levels of sorted runs in the shared folder."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _put(self, run: DataFrame, level: int) -> None:
        """Sorted by hash, in partitions by hash; a full level is merged into the next."""
        path = shared_dir(self.spark, f"run-{level}")
        run.repartition("h").sortWithinPartitions("h").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.read.schema(_RUN).parquet(path))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(merged(full), level + 1)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """batch: d, h. Its documents' ids are below those of all earlier batches."""
        own = batch.groupBy("h").agg(F.count("*").alias("n"), F.max("d").alias("keeper"))
        if known := self.runs():
            seen = merged(known).select("h", F.lit(True).alias("seen"))
            # the anti-join's rows keep their document, the semi-join's rows only add to the count
            own = own.join(seen, "h", "left").select("h", "n", F.when(F.col("seen").isNull(), F.col("keeper")).alias("keeper"))
        self._put(own, 0)

    def all(self) -> DataFrame:
        """h, n, keeper: over all runs."""
        return merged(self.runs())


def merged(runs: list[DataFrame]) -> DataFrame:
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union if len(runs) == 1 else union.groupBy("h").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (columns of those names are replaced)."""
    lines = written(line_table(docs, text, doc_id, least_chars, batches), "lines")
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(lines.where(F.col("b") == b).select("d", "h"))
    common = runs.all().where(F.col("n") >= least_docs).select("h", "keeper")
    # only lines that go are gathered by document; a hot line's rows are split by the adaptive skew join
    gone = lines.join(common, "h").where("d < keeper").groupBy("d").agg(F.sort_array(F.collect_set("h")).alias("gone"))
    gone = gone.withColumn("steps", F.transform(F.sequence(F.floor(F.log2(F.size("gone"))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i)))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    # the document's columns travel as one, so that their names don't matter
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("d"), _lines(F.col(text)).alias("lines"))
    wide = wide.join(gone, "d", "left")
    stays = lambda line: ~_is_in(_hash(key(line)), F.col("gone"), F.col("steps"))
    wide = wide.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    return wide.select(
        *[F.col("row").getField(c).alias(c) for c in own],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


#: DuckDB SQL for doc_id, n_lines, n_dropped, kept_sha256 over documents.
SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', ''), '{_UPPER}', '{_LOWER}') AS k FROM l),
c AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
j AS (SELECT k.doc_id, k.i, k.line, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone FROM k LEFT JOIN c ON k.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
