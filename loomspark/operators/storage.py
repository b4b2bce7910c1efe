"""Cutting lineage in the shared folder, checked broadcasts, and row numbers without a single-partition window."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000

#: Most bytes of an Arrow batch that goes to Python, and the session's setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of this session by their bytes; rows a batch stay as they are."""
    if int(spark.conf.get(BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def trim() -> None:
    """Gives a Python worker's freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this session's own where the cluster names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomspark-"))
    return found or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame as compressed files, for texts and other wide rows: a checkpoint isn't compressed."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places (from 0) in that order: a range sort, then one number a partition through the driver."""
    spark = df.sparkSession
    spread = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), scratch(spark, "numbered"))
    part = F.shiftright(F.col(name), 33)
    counts = spread.groupBy(part.alias("p")).count().orderBy("p").collect()
    at, base = 0, []
    for p, n in counts:
        base.append((p, at))
        at += n
    if not base:
        return spread
    offsets = F.broadcast(spark.createDataFrame(base, "__p bigint, __base bigint"))
    return spread.join(offsets, part == F.col("__p")).withColumn(name, F.col("__base") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("__p", "__base")
