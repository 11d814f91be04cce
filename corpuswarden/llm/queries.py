"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, encoding, fingerprints, langid, lines, lm, media, neardup, oracles, packing, quality, secrets, spelling, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. One small file is a single task: rows of less files than cores are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remainder(modulus: int):
    """The fold of a document; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, _ = media.write_archives(documents(spark, sf_dir))
    return media.features(media.read_archives(spark, uri))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    return lm.score(docs, lm.train(docs.where("not held_out")), keep=["doc_id", "held_out"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (remainder(3) == 1).alias("held_out"))
    return langid.identified(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(documents(spark, sf_dir))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.successors(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_media, op2_lm_scoring, op3_quality, op4_line_dedup, op5_near_duplicates, op6_bpe, op7_quality_classifier, op8_language_id, op9_packing, op10_secrets, op11_fingerprints, op12_spelling, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op3_quality": oracles.OP3, "op4_line_dedup": oracles.OP4}
