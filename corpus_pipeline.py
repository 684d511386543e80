"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet into the folder that the
session's executors share and reads it back as the next one's docs.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import mixing, packing, quality, simhash, substring
from quillwork.llm._common import checked, cut, shared_dir


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host share."""
    return quality.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 20 words that stand earlier in the corpus; a document without words left goes."""
    done = substring.deduplicate(docs, texts=True).where("n_words > n_removed")
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for: a row for each copy. Rows alike in doc_id and text are one document with the copies of all."""
    mixed = mixing.mix(docs.withColumn("text_key", _text_key()), carried="text_key")
    copies = cut(mixed.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("n")).where("_copies > 0").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_copies", "n"))
    facts = copies.agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
    rows = docs if (facts.most or 0) < 2 else docs.withColumn("_t", _text_key()).dropDuplicates(["doc_id", "_t"]).drop("_t")
    taken = rows.join(checked(copies, facts.rows), F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (_text_key() == F.col("_key")))
    return taken.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, with their ids."""
    # Workers that other stages have used share an executor's memory: they keep fewer units.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, kept_units=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("packing", packed_sequences),
]

#: Tilting by Newton's steps, fingerprints and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(shared_dir(spark), f"corpus-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        at = posixpath.join(folder, str(i))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
