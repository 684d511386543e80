"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import html_text, kneser_ney, mixing, packing, permutation_ann, quality, sharding, simhash, sstable, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, ids=False)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(_table(spark, sf_dir, "documents")).drop("factors")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(_table(spark, sf_dir, "documents"))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sstable.write_tables(_table(spark, sf_dir, "documents"), sstable.fresh_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return sstable.read_tables(files).drop("file")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_permutation, op3_sharding, op4_packing, op5_substring, op6_html, op7_mixing, op8_quality, op9_kneser_ney, op10_sstable)}


def oracle_sql() -> dict[str, str]:
    return {}
