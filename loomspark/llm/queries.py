"""Queries of this subpackage, opN_<name>, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kd_search, matroska, mixing, ngram_join, quality, resharding, sentencepiece_codec, sql, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(table(spark, sf_dir, "documents"), F.col("source"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 50 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.packet_table(matroska.text_media(table(spark, sf_dir, "documents")), "doc_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents"), epochs=mixing.EPOCHS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_resharding": op1_resharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_kd_search": op3_kd_search,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_matroska": op8_matroska,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_resharding": sql.RESHARDING,
    "op2_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op3_kd_search": sql.TOP_K,
    "op5_suffix_dedup": sql.REPEATS,
    "op10_mixing": sql.MIXING,
}
