"""What the operators of this subpackage share: table access, the shared folder, columns with safe names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or own_dir(spark)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def own_dir(spark: SparkSession) -> str:
    """For a session without spark.checkpoint.dir, as in tests: one local folder per application."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = jsc.getCheckpointDir()
    return found.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and is computed once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once what was made of them is written itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI.create(folder))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame) -> Callable[[str], str]:
    """Names for columns of our own, with so many underscores before them that no column of df begins alike."""
    before = "_"
    while any(c.startswith(before) for c in df.columns):
        before += "_"
    return lambda name: before + name


def hashed_share(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def smallest_hashes(marks: DataFrame, group: str, mark: str, most: int) -> DataFrame:
    """Of each group, at most `most` different marks (64-bit hashes of rows), the smallest: a bounded sample of distinct rows.

    An approximate number of a group's different marks first says below which mark `most` of them are to be expected, with 5
    percent and six standard deviations to spare, so only about that many are shuffled and ranked, however large a group is or
    however often its rows repeat. The numbers, one row a group, are broadcast: groups are the classes of a model that holds all
    of them anyway. A null group has no marks.
    """
    spare = 1.05 * most + 6 * most**0.5 + 20
    share = F.pmod(F.col(mark), F.lit(1 << 53)) / (1 << 53)
    sizes = marks.groupBy(group).agg(F.approx_count_distinct(mark, 0.01).alias("_size"))
    low = marks.join(F.broadcast(sizes), group).where(share * F.col("_size") < spare).select(group, mark).distinct()
    order = Window.partitionBy(group).orderBy(share, mark)
    return low.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
