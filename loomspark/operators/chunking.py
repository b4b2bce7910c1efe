"""Sentence-aware chunks with overlap, as a fold over each document's sentences in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TARGET_CHARS, OVERLAP_CHARS = 1200, 150


def chunk_bounds(lengths: Column, target: int, overlap: int) -> Column:
    """Array of (a, b): the sentences [a, b) of each chunk, from an array of sentence lengths.

    A chunk ends before the sentence that would exceed the target; the next one begins with the
    longest run of its last sentences that cost at most the overlap. A sentence costs its length and 1, and is never split.
    """
    pairs = "array<struct<a: int, b: int>>"
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("size"), F.array().cast(pairs).alias("cuts"))

    def tail(acc: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))
        back = F.reverse(F.slice(lengths, acc.a + 1, acc.i - acc.a))

        def step(t: Column, n: Column) -> Column:
            fits = t.open & (t.size + n + 1 <= overlap)
            return F.struct(F.when(fits, t.n + 1).otherwise(t.n).alias("n"), F.when(fits, t.size + n + 1).otherwise(t.size).alias("size"), fits.alias("open"))

        return F.aggregate(back, zero, step)

    def fold(acc: Column, n: Column) -> Column:
        full = (acc.size + n + 1 > target) & (acc.i > acc.a)
        kept = tail(acc)
        return F.when(
            full,
            F.struct((acc.i - kept.n).alias("a"), (acc.i + 1).alias("i"), (kept.size + n + 1).alias("size"), F.concat(acc.cuts, F.array(F.struct(acc.a.alias("a"), acc.i.alias("b")))).alias("cuts")),
        ).otherwise(F.struct(acc.a.alias("a"), (acc.i + 1).alias("i"), (acc.size + n + 1).alias("size"), acc.cuts.alias("cuts")))

    # lengths must be a variable by now: a lambda would compute an expression again at every step
    return F.aggregate(lengths, start, fold, lambda acc: F.when(acc.i > 0, F.concat(acc.cuts, F.array(F.struct(acc.a.alias("a"), acc.i.alias("b"))))).otherwise(acc.cuts))


def chunk_text(docs: DataFrame, source: str, text: str = "text", target_chars: int = TARGET_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows (id, text, source, index, metadata) of the chunks of every document; source is a column. No shuffle."""
    if target_chars < 1:
        raise ValueError("a chunk needs a target of at least one character")
    overlap = max(0, min(overlap_chars, target_chars // 2))

    def bodies(sentences: Column) -> Column:
        bounds = X.let(F.transform(sentences, F.length), lambda n: chunk_bounds(n, target_chars, overlap))
        return F.transform(bounds, lambda x: F.array_join(F.slice(sentences, x.a + 1, x.b - x.a), " "))

    chunks = X.let(X.split_sentences(X.normalize(F.col(text))), bodies)
    body = docs.select(F.col(source).cast("string").alias("source"), F.posexplode(chunks).alias("index", "text"))
    return body.select(
        X.chunk_id(F.col("source"), F.col("index"), F.col("text")).alias("id"), "text", "source", "index", F.struct(F.length("text").alias("char_count")).alias("metadata")
    )
