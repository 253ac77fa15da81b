"""The queries of the numbered operators, each over its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm import bpe, hardneg, linededup, lm, mpegts, ngramjoin, packing, phrases, ppm, quality, secrets, toxicity, warc
from gridstrata.llm.common import hashed_share, shared_dir, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.joined(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_share("doc_id", 3) == 1
    scored = toxicity.train_and_score(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    score = F.col("toxicity.probability")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.size("toxicity.segments").alias("n_passages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *quality.BASE, "kept")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    media = docs.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), mpegts.mux(F.col("data")).alias("media"))
    back = media.withColumn("read", mpegts.demux(F.col("media")))
    payload = F.col("read.payload")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        mpegts.feature(F.col("read")).alias("feature"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), hashed_share("doc_id", 5) == 0
    trees = ppm.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), ppm.predicted(F.col("text"), trees, spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.mined(rows, F.col("vec_id") % 100 == 0)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_share("doc_id", 7) == 2
    scored = lm.scored(docs, ~held_out, tokenizer_file("byte_bpe_50k.tiktoken"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_toxicity, op4_byte_bpe, op5_warc, op6_quality_rules, op7_best_fit, op8_mpeg_ts, op9_language_id, op10_secret_scan, op11_collocations, op12_hard_negatives, op13_lm_scores)}

ORACLE_SQL = {"op2_line_dedup": linededup.SQL, "op6_quality_rules": quality.SQL, "op10_secret_scan": secrets.SQL, "op11_collocations": phrases.SQL, "op12_hard_negatives": hardneg.SQL}
