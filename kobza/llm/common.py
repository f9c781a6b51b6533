"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_rest(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="kobza-")


def durable(df: DataFrame) -> DataFrame:
    """The frame's rows, written once to the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def durable_by(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """The frame's rows, written once, dealt out by a column and sorted by it: grouping by the column then needs no shuffle.
    Only a plan that is not adaptive tells how its rows are dealt."""
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return durable(df.repartition(partitions, column).sortWithinPartitions(column))
    finally:
        spark.conf.set(name, before)


def clear(spark: SparkSession, path: str) -> None:
    """Replaces a table that is no longer needed by an empty one, in whatever store it is."""
    spark.createDataFrame([], "nothing boolean").write.mode("overwrite").parquet(path)


def release(spark: SparkSession) -> None:
    """A hint to collect the driver's garbage: Spark deletes shuffle files when nothing refers to them any more. Often
    enough called, it also keeps the heap small; what Python has freed goes back to the system."""
    trim_memory()
    spark.sparkContext._jvm.System.gc()


def free_shuffles(spark: SparkSession) -> None:
    """Has shuffle files deleted that nothing refers to any more. Py4J tells the JVM of dropped frames once a second, and the
    scheduler refers to the last job until the next one, so release alone comes too early for them."""
    gc.collect()
    time.sleep(1.5)
    spark.range(1).collect()
    release(spark)


def shrink_executors(spark: SparkSession) -> None:
    """A hint to the executors to collect their garbage: a heap that has grown gives back what it doesn't need. One short task
    an executor, which idle executors get one each; a local session has none but the driver."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.isLocal():
        n = max(1, sc.getExecutorMemoryStatus().size() - 1)
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def trim_memory() -> None:
    """Gives freed memory of a Python worker back to the system; workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of keys that may be broadcast; a longer list is joined by shuffling.
BROADCAST_ROWS = 50_000


def semi_join(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df with a match in keys (unique, and cheap to count), which are broadcast if they are few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches; afterwards what it held goes back to the system."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim_memory()

    return whole


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """function over each Arrow batch; a batch without rows is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(trimmed(run), schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_keys(df: DataFrame, key: str, per_stratum: int, strata: list[str] | None = None) -> DataFrame:
    """At most per_stratum keys of each stratum, spread by hash: the smallest key of each of so many hash buckets.

    Keys and strata are aggregated map-side, so no stratum's rows meet in a task.
    """
    strata = strata or []
    bucket = F.pmod(F.xxhash64(key), F.lit(per_stratum)).alias("_bucket")
    return df.where(F.col(key).isNotNull()).groupBy(*strata, bucket).agg(F.min(key).alias(key)).drop("_bucket")
