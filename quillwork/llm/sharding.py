"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import cut, ranged, running


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs; the law is 'bytes'.

    Rows are taken in the order of doc_id (null first; rows of one id by checksum and size). Range partitions give
    their totals, the totals of earlier partitions plus a window within a partition give each row's global prefix sum,
    and a row goes to the shard in whose equal share of all bytes its middle byte lies. Shards are contiguous in that
    order, and differ from the mean by a row's size at most. A null text has no bytes and checksum 0; empty shards are
    possible only where rows are larger than a share. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    at = running(ranged(base, *order), [], order, {"before": "size", "row": F.lit(1).cast("long")}, totals=True)
    middle = F.expr(f"((2 * before + size) * {shards}) div (2 * before_total)")
    placed = cut(at.withColumn("shard", F.least(F.lit(shards - 1), middle.cast("int"))).select("doc_id", "size", "text_crc32", "shard", "row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
