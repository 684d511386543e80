"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the contracts call a word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is made for a local master (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillwork-")
    spark.sparkContext.setCheckpointDir(made)
    return made


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and drop its lineage; its shuffle files go at once, not when the driver collects garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    with contextlib.ExitStack() as stack:
        for key, value in (("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), *QUIET):
            stack.enter_context(_setting(spark, key, value))
        return df.select("*").checkpoint()  # a plan made under the settings


#: Many short jobs: the driver keeps no long descriptions of their plans.
QUIET = (("spark.sql.ui.explainMode", "simple"), ("spark.sql.maxPlanStringLength", "4000"))


def swept(spark: SparkSession) -> None:
    """Let the driver's JVM give back what earlier jobs left: plans, compiled classes, broadcasts that nothing refers to."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def planned_once(spark: SparkSession):
    """Jobs within are planned before they run only: for many small ones, whose hot keys are known, planning anew after each shuffle costs the driver more than it saves."""
    with _setting(spark, "spark.sql.adaptive.enabled", "false"):
        yield


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker, at the end of each task, gives freed memory back to the system: workers stay for later tasks, also of other operators."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in order over range partitions, written down, with its partition's number as _pid."""
    n = shuffle_width(df.sparkSession)
    return cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, F.Column | str], totals: bool = False) -> DataFrame:
    """Running sums over a ranged() frame: each name of sums gets the sum of its expression over all earlier rows of its keys.

    Sums within a range partition come from a window; those of earlier partitions from one row for each partition and
    key. No task sees more than one range partition, however large a key is. totals adds <name>_total.
    """
    named = df.withColumns({f"_v_{k}": F.expr(v) if isinstance(v, str) else v for k, v in sums.items()})
    per = named.groupBy("_pid", *keys).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    every = W.partitionBy(*keys)
    before = every.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("_pid", *keys, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *([F.sum(f"_s_{k}").over(every).alias(f"{k}_total") for k in sums] if totals else []))
    # Without keys there is one row for each range partition: a bounded side.
    joined = named.join(F.broadcast(per) if not keys else per, ["_pid", *keys])
    inner = W.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = joined.select("*", *[(F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inner), F.lit(0))).alias(k) for k in sums])
    return out.drop(*[f"_v_{k}" for k in sums], *[f"_b_{k}" for k in sums])


#: Bytes of a join's small side up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Parts into which salted_join() deals the rows of a key.
SALTS = 16


def checked(small: DataFrame, n: int, width: int = 64) -> DataFrame:
    """small, to be broadcast if its n rows of about width bytes are within the limit."""
    return F.broadcast(small) if n * width <= BROADCAST_BYTES else small


def bytes_of(df: DataFrame) -> int:
    """About how many bytes a written-down frame takes as a broadcast: strings, binaries and arrays by their lengths."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    width = lambda c: F.coalesce(F.octet_length(c) if kinds[c] in ("string", "binary") else 8 * F.size(c) if kinds[c] in ("array", "map") else F.lit(0), F.lit(0)) + 16
    return df.agg(F.sum(sum((width(c) for c in df.columns), F.lit(16)))).first()[0] or 0


def salted_join(large: DataFrame, small: DataFrame, on: list[str], spread: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The inner join of large with small, which is written down: by broadcast within the limit, beyond it with each key's rows dealt by a hash of the column `spread` over SALTS tasks."""
    if bytes_of(small) <= limit:
        return large.join(F.broadcast(small), on)
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt.hint("shuffle_hash"), [*on, "_salt"]).drop("_salt")


#: Rows of one key from which a join takes it as hot.
HOT_ROWS = 200_000


def hot_join(large: DataFrame, small: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """large joined with small, whose keys differ; rows of the keys in hot, each of HOT_ROWS rows or more of large, meet theirs by broadcast. hot is written down, or None if there is none."""
    if hot is None:
        return large.join(small, on, how)
    few = F.broadcast(hot)
    return large.join(few, on, "left_semi").join(F.broadcast(small.join(few, on, "left_semi")), on, how).unionByName(large.join(few, on, "left_anti").join(small, on, how))
