"""Is an answer grounded in its reference: by shared content words, or, if asked, by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedup, embedding


def semantic_scores(pairs: DataFrame, key: str, output: str, reference: str, dim: int = 256) -> DataFrame:
    """Rows (key, semantic): cosine of the hash embeddings of two texts, to 4 places; 0 if one has no words."""
    a, b = (dedup.hash_vectors(pairs, key, c, dim).select(key, F.map_from_arrays("buckets", "counts").alias(n)) for c, n in ((output, "a"), (reference, "b")))
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    shared = F.aggregate(F.map_keys("a"), F.lit(0).cast("bigint"), lambda s, k: s + F.coalesce(F.try_element_at("a", k) * F.try_element_at("b", k), F.lit(0)))
    score = shared / F.sqrt((square(F.col("a")) * square(F.col("b"))).cast("double"))
    return pairs.select(key).join(a.join(b, key).select(key, F.bround(score, 4).alias("semantic")), key, "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))


def model_scores(pairs: DataFrame, key: str, output: str, reference: str, model: str) -> DataFrame:
    """The same by an embedding model's vectors."""
    a, b = (embedding.vectors(pairs, key, c, model).withColumnRenamed("vector", n) for c, n in ((output, "a"), (reference, "b")))
    return a.join(b, key).select(key, F.bround(X.cosine(F.col("a"), F.col("b")), 4).alias("semantic"))


def grounded(token: Column, min_token: float, semantic: Column | None = None, min_semantic: float | None = None) -> Column:
    """Enough shared words, or, where similarity is asked for, enough of it: it rescues, it doesn't restrict."""
    ok = token >= min_token
    return ok if min_semantic is None or semantic is None else ok | (semantic >= min_semantic)


def ground(pairs: DataFrame, key: str, output: str, reference: str, min_token: float = 0.35, min_semantic: float | None = None, dim: int = 256, model: str = "hash") -> DataFrame:
    """pairs with token_score, semantic (null unless asked for) and grounded."""
    scored = pairs.withColumn("token_score", X.overlap_score(F.col(output), F.col(reference)))
    if min_semantic is None:
        return scored.withColumn("semantic", F.lit(None).cast("double")).withColumn("grounded", grounded(F.col("token_score"), min_token))
    semantic = semantic_scores(pairs, key, output, reference, dim) if embedding.available(model) == "hash" else model_scores(pairs, key, output, reference, model)
    scored = scored.join(semantic, key)
    return scored.withColumn("grounded", grounded(F.col("token_score"), min_token, F.col("semantic"), min_semantic))
