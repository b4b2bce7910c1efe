"""Shared plumbing: row keys, checkpoints, and taking decisions into effect without shuffling texts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnp import lean

#: Most numbers of a side that is broadcast, counting those in its arrays; a larger side is joined by shuffling.
BROADCAST_CELLS = 4_000_000
#: Most bytes of an Arrow batch that goes to Python, and the session's setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Limits the Arrow batches of this session by their bytes, which texts of any length need; rows a batch stay as they are."""
    if int(spark.conf.get(BATCH_SETTING).rstrip("b")) > most:
        spark.conf.set(BATCH_SETTING, str(most))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of its own only where none is set, as in tests."""
    bound_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomspark-"))
    return found or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame as written files in the shared folder: its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits of a row's identifier and text; null and empty text differ."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(text).isNull())


def small(df: DataFrame, cells: Column | None = None, most: int = BROADCAST_CELLS) -> DataFrame:
    """The frame, marked for broadcast if it has at most `most` numbers; cells says how many a row has (its columns, by default)."""
    each = F.lit(len(df.columns)) if cells is None else cells
    total = df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs less the rows whose row_key is in drops(k). A small drop list is broadcast and no text moves."""
    drops = small(drops.select(F.col("k").alias("__ls_k")))
    return docs.withColumn("__ls_row", row_key()).join(drops, F.col("__ls_row") == F.col("__ls_k"), "left_anti").drop("__ls_row")


def _running(group: str, value: str):
    """Exclusive running sums of `value` within `group` in a partition that is sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(group).to_numpy(zero_copy_only=False)
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            length = np.diff(np.append(first, len(v)))
            total = np.cumsum(v)
            before = total - v
            base = before[first].copy()
            if names[0] == last:
                base[0] -= carry
            before = before - np.repeat(base, length)
            last, carry = names[-1], int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(v), pid, np.int32))], [*batch.schema.names, "before", "pid"])

    return run


def offsets(df: DataFrame, group: str, order: list[str], value: str) -> tuple[DataFrame, dict[str, int]]:
    """df with `before`, the sum of `value` over the rows of its group that come earlier, and the groups' sums.

    Rows are sorted by range, so a group of any size is spread over partitions; the driver gets one
    number for each group and partition that meet, which are fewer than both counts together.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("before", T.LongType()), T.StructField("pid", T.IntegerType())])
    spread = cut(cut(df).repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(lean(_running(group, value)), schema))
    parts = spread.groupBy(group, "pid").agg(F.max(F.col("before") + F.col(value)).alias("n")).orderBy(group, "pid").collect()
    sums: dict[str, int] = {}
    base = []
    for name, pid, n in parts:
        base.append((name, pid, sums.get(name, 0)))
        sums[name] = sums.get(name, 0) + n
    if not base:
        return spread.drop("pid"), sums
    bases = spark.createDataFrame(base, "b_group string, b_pid int, b_base bigint")
    joined = spread.join(F.broadcast(bases), (F.col(group) == F.col("b_group")) & (F.col("pid") == F.col("b_pid")))
    return joined.select(*df.columns, (F.col("before") + F.col("b_base")).alias("before")), sums


def whole_groups(batches: Iterator[pa.RecordBatch], by: int = 0, most: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of a partition that is sorted by column `by`, in parts of about `most` rows that cut no group."""
    held: list[np.ndarray] | None = None
    waiting: list[pa.RecordBatch] = []
    count = 0

    def joined() -> list[np.ndarray]:
        new = [[x.column(i).to_numpy(zero_copy_only=False) for x in waiting] for i in range(waiting[0].num_columns)] if waiting else []
        return [np.concatenate([a, *b]) for a, b in zip(held, new)] if held is not None and new else held if held is not None else [np.concatenate(b) for b in new]

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        columns = joined()
        waiting, count = [], 0
        key = columns[by]
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield [x[:last] for x in columns]
            columns = [x[last:] for x in columns]
        held = columns
    columns = joined()
    if columns and len(columns[by]):
        yield columns
