"""The gates that candidates pass in turn, the stop at the target, and the counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(accepted: Column, grounded: Column, score: Column, min_score: int) -> Column:
    """What the gates say of a candidate; grounded is null where there is no chunk to hold it against."""
    return (
        F.when(~accepted, "diversity_rejected").when(~F.coalesce(grounded, F.lit(True)), "hallucination_rejected").when(F.coalesce(score, F.lit(0)) < min_score, "judge_rejected").otherwise("kept")
    )


def stop_at(decided: DataFrame, order: str, target: int, overflow: str = "unexamined") -> DataFrame:
    """decided, with decisions after the target-th kept row changed.

    overflow="unexamined": rows after it were never looked at; "reject": all were, and what is kept beyond the target becomes "overflow".
    Only the target's first kept rows are sorted.
    """
    if overflow not in ("unexamined", "reject"):
        raise ValueError("overflow must be unexamined or reject")
    kept = decided.where("decision = 'kept'").orderBy(order).limit(max(target, 0)).agg(F.count("*").alias("n"), F.max(order).alias("last")).first()
    if kept["n"] < target:
        return decided
    late = F.lit(True) if target <= 0 else F.col(order) > kept["last"]
    if overflow == "reject":
        late = late & (F.col("decision") == "kept")
        return decided.withColumn("decision", F.when(late, "overflow").otherwise(F.col("decision")))
    return decided.withColumn("decision", F.when(late, "unexamined").otherwise(F.col("decision")))


def stats(decided: DataFrame, seeds: int = 0, generated: int | None = None, dpo_pairs: int = 0) -> DataFrame:
    """One row of counters."""
    is_ = lambda *names: F.count_if(F.col("decision").isin(*names))
    return decided.agg(
        F.lit(seeds).cast("bigint").alias("seeds"), (F.count("*") if generated is None else F.lit(generated).cast("bigint")).alias("generated"), is_("kept", "judge_rejected", "overflow").alias("judged"),
        is_("diversity_rejected").alias("diversity_rejected"), is_("hallucination_rejected").alias("hallucination_rejected"), is_("judge_rejected").alias("judge_rejected"),
        is_("kept").alias("kept"), F.lit(dpo_pairs).cast("bigint").alias("dpo_pairs"),
    )


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Rows (instruction, chosen, rejected, chosen_score, rejected_score, source_chunks) where the weak answer isn't blank, differs and scores less."""
    from ..functions.text import strip

    weak = strip(F.coalesce("weak", F.lit("")))
    ok = (weak != "") & (weak != strip(F.col("output"))) & (F.coalesce("weak_score", F.lit(0)) < F.col("judge_score"))
    return rows.where(ok).select(
        "instruction", F.col("output").alias("chosen"), F.col("weak").alias("rejected"), F.col("judge_score").alias("chosen_score"), F.coalesce("weak_score", F.lit(0)).alias("rejected_score"), "source_chunks"
    )
