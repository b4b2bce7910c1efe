"""Seeded shuffles, samples and the train/eval split; independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from . import storage


def eval_size(n: int, fraction: float, min_eval: int = 1, max_eval: int | None = None) -> int:
    if not 0 < fraction < 1:
        raise ValueError("eval_fraction must be between 0 and 1")
    if n == 0:
        return 0
    size = max(min_eval, round(n * fraction))
    return min(size if max_eval is None else min(size, max_eval), n - 1)


def shuffled(items: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """items with their places in a seeded shuffle."""
    return storage.number_rows(items, [keys.lot(seed, F.col(key)), F.col(key)], name)


def train_eval_split(items: DataFrame, key: str, eval_fraction: float = 0.1, *, max_eval: int | None = None, min_eval: int = 1, seed: int = 42) -> DataFrame:
    """items with `part`, train or eval; sort by the items' own order to get each part in it."""
    size = eval_size(items.count(), eval_fraction, min_eval, max_eval)
    placed = shuffled(items, key, seed, "__place")
    return placed.withColumn("part", F.when(F.col("__place") < size, "eval").otherwise("train")).drop("__place")
