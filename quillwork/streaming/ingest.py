"""PDF files as a stream: folders are watched, each file is parsed once, pages land as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillwork.sources import pdf

FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, content) of files as they arrive."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def start(spark: SparkSession, folder: str, target: str, state: str, once: bool = True) -> StreamingQuery:
    """Parse files as they arrive into target, with state in the folder `state`; with once, what is there now."""
    out = pdf.parse(files(spark, folder)).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
