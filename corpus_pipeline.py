"""The corpus pipeline: five stages over documents, each on all that the one before kept.

1. toxicity: toxic documents go.
2. near_duplicates: of each group of near duplicates (connected by n-gram Jaccard similarity) the document of the least doc_id stays.
3. repeated_passages: a passage of at least 50 words that an earlier document has is cut; a document of which nothing is left goes.
4. mixing: documents are put in training order by the sources' weight schedules, each once.
5. tokens: the rows (doc_id, position, ids, n_tokens, exact) of the texts; position counts the documents in training order from 0.

The training order is that of the files that mixing writes, by their numbers, and of the rows in each; Spark reads files in
any order, so the last stage takes it from there. Documents that are not read from files have a null position.

Rows with nulls, repeated rows, empty and long texts: see each operator's docstring; a row with a null text
or doc_id passes all stages.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm import mixing, ngram_join, rows, sentencepiece_codec, suffix_dedup
from loomspark.llm import toxicity as toxic_terms


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_terms.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagged = placed(docs).select(F.struct("doc_id", "position").alias("doc_id"), "text")
    return sentencepiece_codec.encoded(tagged).select("doc_id.*", "ids", "n_tokens", "exact")


def placed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, position): the place of the row in the files that docs is read from."""
    try:
        at = docs.metadataColumn("_metadata")
        read = docs.select("doc_id", "text", at["file_path"].alias("file"), at["row_index"].alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast("bigint").alias("position"))
    # a row for each file that a task wrote; names are padded to five digits only
    files = read.groupBy("file").agg(F.count("*").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("bigint")
    before = F.coalesce(F.sum("n").over(W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = rows.small(rows.cut(files.select("file", before.alias("begin"))))
    return read.join(begins, "file").select("doc_id", "text", (F.col("begin") + F.col("row")).alias("position"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mix), ("tokens", tokens)]
#: Learning the lexicon and encoding are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{rows.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
