"""Dense unit vectors of texts: hash embeddings, or a sentence-transformers model where that library is installed."""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedup

BATCH = 32


def available(model: str) -> str:
    """The model, or "hash" with a warning where the library that it needs is missing."""
    if model != "hash" and importlib.util.find_spec("sentence_transformers") is None:
        warnings.warn(f"sentence-transformers isn't installed; hash embeddings stand in for {model}", stacklevel=2)
        return "hash"
    return model


def _encode(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)  # once a task
        for batch in batches:
            got = loaded.encode(batch["text"].fillna("").tolist(), batch_size=BATCH, normalize_embeddings=True, show_progress_bar=False)
            yield pd.DataFrame({"id": batch["id"], "vector": list(got)})

    return run


def vectors(items: DataFrame, key: str, text: str, model: str = "hash", dim: int = 256) -> DataFrame:
    """Rows (key, vector); a text without words has the zero vector."""
    model = available(model)
    if model != "hash":
        kind = items.schema[key].dataType.simpleString()
        return items.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(_encode(model), f"id {kind}, vector array<float>").withColumnRenamed("id", key)
    sparse = dedup.hash_vectors(items, key, text, dim)
    norm = F.sqrt(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x * x).cast("double"))
    table = F.map_from_arrays("buckets", "counts")
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.coalesce(F.try_element_at(table, k), F.lit(0)) / norm).cast("float"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return items.select(key).join(sparse.select(key, dense.alias("vector")), key, "left").withColumn("vector", F.coalesce("vector", zero))
