"""A training corpus from documents: quality rules, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and read
again. All but the last return the columns of documents, texts as changed and n_chars to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm import linededup, ngramjoin, packing, quality, secrets
from gridstrata.llm.common import table, written
from gridstrata.llm.queries import tokenizer_file


def _as_documents(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents, with another column as the text."""
    out = docs.withColumn("text", F.col(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failed lines, and documents that fail the base rules or lose too much text."""
    return _as_documents(quality.accepted(docs), "cleaned", docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share, except in the last document; no document goes."""
    return _as_documents(linededup.deduplicated(docs), "kept_text", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that of the smallest doc_id (null only where there is no other) and row key; documents
    without a word are none's copy and stay."""
    # the key is stored, so that it names the same row however often the table is read
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = rows.select("text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("doc_id"))
    keep = ngramjoin.joined(named).where(F.col("doc_id") == F.col("component_id")).select("doc_id._row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets; no document goes."""
    return _as_documents(secrets.redacted(docs), "text", docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and places."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Components of near duplicates and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
