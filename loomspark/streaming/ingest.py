"""Continuous ingest, beyond the batch operators: a file stream of documents is chunked without state, and each batch's
new chunks are appended to a table whose chunk identifiers stay unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, source: str = "doc_id") -> DataFrame:
    return chunking.chunk_text(docs, source)


def append_new(chunks: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the stream's chunks to a Parquet table, without those that are there; a batch that is replayed adds nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        new = batch.dropDuplicates(["id"])
        if there:
            new = new.join(spark.read.parquet(table).where(f"batch != {number}").select("id"), "id", "left_anti")
        new.selectExpr("*", f"{number} as batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    writer = chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
