"""The thin queries over whole tables: each applies one operator and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, contamination, linededup, oracles, quality, repetition, simhash, substrings, surrogates, tokencount, tokenfile
from .common import Scratch


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scores(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > tokencount.LIMIT).alias("over_limit"), "fit_chars")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'tokens').root}/ids"
    tokenfile.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return tokenfile.read(spark, path).withColumnRenamed("id", "doc_id")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.rules(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pattern() -> str:
    """What splits a text before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytebpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.keep_bitmaps(table(spark, sf_dir, "documents"), digest=True)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_token_file": op6_token_file,
    "op7_repetition": op7_repetition,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = oracles.ORACLES
