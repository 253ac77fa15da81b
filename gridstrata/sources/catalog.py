"""The catalogue of files as a table, panels as Parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstrata.operators.conform import merge_tables

KEYS = ["experiment", "model", "lat", "lon", "year", "month"]


def panel_scan(spark: SparkSession, path: str, variables: list[str], experiments: list[str], models: list[str] | None = None) -> DataFrame:
    """A1. Keys and chosen variables; what isn't there is left out."""
    df = spark.read.parquet(path)
    df = df.where(F.col("experiment").isin(experiments))
    df = df if models is None else df.where(F.col("model").isin(models))
    return df.select(*[c for c in [*KEYS, *variables] if c in df.columns])


def variables_scan(spark: SparkSession, paths: dict[str, str], experiments: list[str], models: list[str] | None = None) -> DataFrame:
    """A1. As panel_scan for variables stored apart, merged by outer join of KEYS; a path that isn't there is left out, and at least one must be."""
    there = {v: p for v, p in paths.items() if _exists(spark, p)}
    return merge_tables([panel_scan(spark, p, [v], experiments, models) for v, p in there.items()], KEYS)


def models_with_all(catalog: DataFrame, required: list[tuple[str, str]], experiments: list[str]) -> DataFrame:
    """A2. source_id of models that have every (variable, table) in every experiment."""
    wanted = F.struct("variable_id", "table_id").isin([F.struct(F.lit(v), F.lit(t)) for v, t in required]) & F.col("experiment_id").isin(experiments)
    have = catalog.where(wanted).groupBy("source_id").agg(F.count_distinct(F.struct("variable_id", "table_id", "experiment_id")).alias("n"))
    return have.where(F.col("n") == len(set(required)) * len(set(experiments))).select("source_id")


def common_members(catalog: DataFrame) -> DataFrame:
    """A3. Members that are in all (experiment, variable) rows that their model has."""
    rows = F.struct("experiment_id", "variable_id")
    model = catalog.groupBy("source_id").agg(F.count_distinct(rows).alias("all"))
    member = catalog.groupBy("source_id", "member_id").agg(F.count_distinct(rows).alias("n"))
    return member.join(model, "source_id").where("n = all").select("source_id", "member_id")


def newest_common_version(catalog: DataFrame) -> DataFrame:
    """A4. For each model, the newest version that all of its variables have."""
    v = catalog.withColumn("v", F.regexp_extract("version", r"^v(\d{8})$", 1).cast("int"))
    need = catalog.groupBy("source_id").agg(F.count_distinct("variable_id").alias("all"))
    have = v.groupBy("source_id", "v").agg(F.count_distinct("variable_id").alias("n"))
    return have.join(need, "source_id").where("n = all").groupBy("source_id").agg(F.max("v").alias("version"))


def pick_grid_and_version(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """A5. Grid gn, gr, gr1, else any; then the newest version; all its files."""
    preference = F.when(F.col("grid") == "gn", 0).when(F.col("grid") == "gr", 1).when(F.col("grid") == "gr1", 2).otherwise(3)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(preference, F.desc("version")))
    return catalog.withColumn("_r", rank).where("_r = 1").drop("_r")


def window_overlap(catalog: DataFrame, first: str, last: str) -> DataFrame:
    """A6. Files whose name's time range overlaps [first, last]; names without one stay. Times are months (yyyymm, the whole month) or days
    (yyyymmdd), in names and in the window, also mixed."""
    a, b = (F.nullif(F.regexp_extract("file", r"_(\d{8}|\d{6})-(\d{8}|\d{6})\.nc$", k), F.lit("")) for k in (1, 2))
    from_, to = (lambda x: F.rpad(x, 8, "01")), (lambda x: F.rpad(x, 8, "31"))
    return catalog.where(a.isNull() | ((from_(a) <= to(F.lit(last))) & (to(b) >= from_(F.lit(first)))))


def source_priority(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """A7. The union of sources; of rows with equal keys, that of the earliest source."""
    union = sources[0].withColumn("_s", F.lit(0))
    for k, df in enumerate(sources[1:], 1):
        union = union.unionByName(df.withColumn("_s", F.lit(k)), allowMissingColumns=True)
    return union.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_s"))).where("_r = 1").drop("_r", "_s")


def skip_present(work: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """A8."""
    return work.join(outputs, keys, "left_anti")


def panel_write(df: DataFrame, path: str) -> None:
    """A9. Replaces the partitions that df has."""
    df.write.partitionBy("experiment", "model").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_or_compute(spark: SparkSession, path: str, compute, partition: list[str]) -> DataFrame:
    """A10. A stored result, or compute() stored with its doubles as floats."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        df = compute()
        df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double" and c not in KEYS}).write.partitionBy(*partition).parquet(path)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: the same rows have the same one."""
    h = F.xxhash64(*sorted(df.columns))
    sums = df.agg(F.count("*"), *[F.sum(F.pmod(F.shiftrightunsigned(h, s), F.lit(1 << 16))) for s in (0, 16, 32, 48)]).first()
    return "-".join(str(x or 0) for x in sums)


class ResultStore:
    """A10. Results by part, such as a period and a model, under the mask that they were made with.

    A folder for each mask holds the mask, the rows by part, and a manifest of the parts that are complete. fill() computes and
    stores those that the manifest lacks, one group of parts after the other, so that a job that was ended goes on where it was; a
    part that was half written is written anew. Another mask has a folder of its own, so nothing made with the old one counts.
    """

    def __init__(self, spark: SparkSession, path: str, mask: DataFrame, keys: tuple[str, ...] = ("period", "model")):
        self.spark, self.keys = spark, list(keys)
        self.folder = f"{path.rstrip('/')}/mask-{fingerprint(mask)}"
        if not _exists(spark, f"{self.folder}/mask/_SUCCESS"):
            mask.write.mode("overwrite").parquet(f"{self.folder}/mask")

    def mask(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/mask")

    def done(self) -> set[tuple]:
        """Complete parts; a row each, and parts are few."""
        if not _exists(self.spark, f"{self.folder}/manifest"):
            return set()
        return {tuple(r) for r in self.spark.read.parquet(f"{self.folder}/manifest").select(*self.keys).distinct().collect()}

    def fill(self, parts: list[tuple], compute: Callable[[list[tuple], DataFrame], DataFrame], at_once: int = 8) -> DataFrame:
        """The rows of these parts, doubles as floats. compute(missing parts, mask) gives rows with the keys."""
        missing = [p for p in dict.fromkeys(map(tuple, parts)) if p not in self.done()]
        for k in range(0, len(missing), at_once):
            group = missing[k : k + at_once]
            df = compute(group, self.mask())
            df = df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double" and c not in KEYS})
            df.write.partitionBy(*self.keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/rows")
            self.spark.createDataFrame(group, ", ".join(f"{c} string" for c in self.keys)).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        wanted = self.spark.createDataFrame([tuple(p) for p in parts], ", ".join(f"{c} string" for c in self.keys)).distinct()
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")
        rows = rows.withColumns({c: F.col(c).cast("string") for c in self.keys})
        return rows.join(F.broadcast(wanted), self.keys, "left_semi")  # a row a part


def provenance(steps: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """B17. seq, step, keys, n_rows: what each step left of each dataset; the newest step has the largest seq."""
    rows = [df.groupBy(*keys).agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("seq"), F.lit(name).alias("step"), *keys, "n_rows") for k, (name, df) in enumerate(steps)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and the session is local."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for results that several jobs read. What it shuffled is deleted."""
    path = shared_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs that end in here leave none of what they shuffled on the disks: Spark's own setting, for so long."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def few(df: DataFrame) -> DataFrame:
    """A table of a few rows (such as one a fit), computed now; what that shuffled is deleted."""
    with tidy(df.sparkSession):
        return df.sparkSession.createDataFrame(df.collect(), df.schema)


def stored_in_parts(spark: SparkSession, parts: Iterable[DataFrame], ddl: str, name: str) -> DataFrame:
    """What these hold as one table in the shared folder. One after the other is computed, and what it shuffled deleted before the next."""
    path = shared_folder(spark, name)
    spark.createDataFrame([], ddl).write.parquet(path)
    for df in parts:
        with tidy(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(ddl).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that are stored, once what was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def csv_export(df: DataFrame, path: str) -> None:
    """A11. A result table (models by variables) as one CSV file."""
    # a shuffle, so that what comes before keeps its tasks
    df.repartition(1).write.mode("overwrite").csv(path, header=True)
