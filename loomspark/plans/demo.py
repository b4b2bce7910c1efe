"""Runs with the stub model, for the catalogue and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from . import pipeline
from .providers import StubProvider


def chunks_of(docs: DataFrame) -> DataFrame:
    return chunking.chunk_text(docs, "doc_id")


def end_to_end(spark: SparkSession, docs: DataFrame) -> DataFrame:
    config = pipeline.Config(description="a helper for invented prose", target_examples=50, seeds_per_chunk=1, seeds_from_description=10, min_hallucination_overlap=0.05, generate_dpo_pairs=True)
    out = pipeline.run(spark, config, chunks_of(docs), StubProvider())
    return out.examples.select("cand_idx", "instruction", "output", "judge_score", F.lit("kept").alias("decision")).union(out.rejected.select("cand_idx", "instruction", "output", "judge_score", "decision"))


def dialogues(spark: SparkSession, docs: DataFrame) -> DataFrame:
    config = pipeline.MultiturnConfig(description="a helper for invented prose", target=40)
    return pipeline.run_multiturn(spark, config, chunks_of(docs), StubProvider()).dialogues.select("dialogue", F.size("messages").alias("turns"), "source_chunks")
