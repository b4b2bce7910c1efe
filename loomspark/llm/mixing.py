"""Time-varying curriculum: mixes sources to weights that change over the training run.

Source s has a weight schedule, linear from begin_s to end_s over training time u in [0, 1]. Its
integral, begin_s * u + (end_s - begin_s) * u^2 / 2, is the share of its tokens demanded until u. A
document that begins at token c of its source's order is due when the demand reaches c: the integral
is inverted for u, and the position is the token u * total. Documents are then sorted by position, by
range.

Two forms: with `epochs`, the run has that many times the corpus's tokens, and source s is asked for total * weight_s of them, its weight being its part
of all sources' integrals; a source with fewer starts again (the same document at later positions), one
with more leaves the rest out. Without it, every document is used exactly once: the demand is scaled to
what the source has, so that the schedules only say when.

Order in a source: by the md5 of seed and doc_id, then by row key. Tokens are whitespace-separated words.

Defined cases: a null or empty text, or one of white space only, has 0 tokens and stands where the next
document of its source begins; a source without any tokens is used once, at position 0. A null source is
a source of its own; a null doc_id is ordered as ''. Repeated rows are separate documents at successive
positions. An empty table gives no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rows


@dataclass(frozen=True)
class Schedules:
    """Weight schedules: source s goes from share_s ** power_begin to share_s ** power_end, its share being that of its tokens.

    Powers below 1 favour small sources. `given` overrides (begin, end) by source name. Weights are
    relative; they are rounded to millionths, so that demands are exact integers.
    """

    power_begin: float = 1.0
    power_end: float = 0.5
    given: tuple[tuple[str, float, float], ...] = ()

    def of(self, tokens: dict[str | None, int]) -> dict[str | None, tuple[int, int]]:
        total = sum(tokens.values()) or 1
        out = {s: ((n / total) ** self.power_begin, (n / total) ** self.power_end) if n else (0.0, 0.0) for s, n in tokens.items()}
        out |= {s: (b, e) for s, b, e in self.given if s in out}
        return {s: (round(b * 1_000_000), round(e * 1_000_000)) for s, (b, e) in out.items()}


SEED = 20240607
#: Training tokens of the registered query, as a multiple of the corpus's.
EPOCHS = 1.5


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r\x0B\f]+")), F.lit(0)).cast("bigint")


def _when(at: Column, begin: Column, end: Column) -> Column:
    """The u in [0, 1] at which the integral of a schedule is the share `at` of its whole."""
    whole = (begin + end) / 2
    slope = end - begin
    root = F.sqrt(F.greatest(begin * begin + 2 * slope * whole * at, F.lit(0.0)))
    # of the quadratic's two forms the one that also holds for slope 0
    return F.least(F.lit(1.0), F.when(begin + root > 0, 2 * whole * at / (begin + root)).otherwise(F.lit(0.0)))


def order(docs: DataFrame, schedules: Schedules = Schedules(), epochs: float | None = None, seed: int = SEED) -> DataFrame:
    """Rows (k, doc_id, source, tokens, pass, position) of the plan; no texts are moved.

    k is rows.row_key() of the document and source; pass counts how often it was used before.
    """
    spark = docs.sparkSession
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(rows.row_key().alias("k"), "doc_id", "source", tokens().alias("tokens"), name.alias("g"), lot.alias("lot"))
    placed, supply = rows.offsets(base, "g", ["lot", "k"], "tokens")
    names = {g: g[1:] if g[0] == "s" else None for g in supply}
    weights = schedules.of({names[g]: n for g, n in supply.items()})
    span = sum(supply.values()) if epochs is None else int(sum(supply.values()) * epochs)
    whole = sum(map(sum, weights.values())) or 1
    # demand is what the run asks of the source, in tokens
    table = [(g, float(b), float(e), n, n if epochs is None else span * (b + e) // whole) for g, n in supply.items() for b, e in [weights[names[g]]]]
    if not table:
        return placed.select("k", "doc_id", "source", "tokens", F.lit(0).alias("pass"), F.lit(0).cast("bigint").alias("position"))
    side = F.broadcast(spark.createDataFrame(table, "w_g string, w_begin double, w_end double, w_supply bigint, w_demand bigint"))
    joined = placed.join(side, F.col("g") == F.col("w_g"))
    last = F.when(F.col("w_supply") > 0, F.floor((F.col("w_demand") - 1 - F.col("before")) / F.greatest("w_supply", F.lit(1)))).otherwise(0)
    used = joined.where((F.col("before") < F.col("w_demand")) | F.lit(epochs is None) | (F.col("w_supply") == 0))
    used = used.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(0) if epochs is None else F.greatest(last, F.lit(0)).cast("int"))))
    at = (F.col("before") + F.col("pass") * F.col("w_supply")) / F.greatest("w_demand", F.lit(1))
    position = F.floor(_when(at, F.col("w_begin"), F.col("w_end")) * span)
    return used.select("k", "doc_id", "source", "tokens", "pass", position.cast("bigint").alias("position"))


def curriculum(docs: DataFrame, schedules: Schedules = Schedules(), epochs: float | None = None, seed: int = SEED) -> DataFrame:
    """The plan's rows (doc_id, source, tokens, pass, position), range-sorted by position."""
    plan = rows.cut(order(docs, schedules, epochs, seed))
    return plan.repartitionByRange("position", "k").sortWithinPartitions("position", "k").drop("k")


def mix(docs: DataFrame, schedules: Schedules = Schedules(), seed: int = SEED) -> DataFrame:
    """docs, all of them once, range-sorted by their training positions. Texts are shuffled once."""
    plan = rows.cut(order(docs, schedules, None, seed).select(F.col("k").alias("__ls_k"), F.col("source").alias("__ls_s"), F.col("position").alias("__ls_at")))
    # copies of one row share their key: each takes one of the key's positions
    once = plan.groupBy("__ls_k", "__ls_s").agg(F.array_sort(F.collect_list("__ls_at")).alias("__ls_at"))
    keyed = docs.withColumn("__ls_row", rows.row_key())
    match = (F.col("__ls_row") == F.col("__ls_k")) & F.col("source").eqNullSafe(F.col("__ls_s"))
    single = once.where(F.size("__ls_at") == 1).withColumn("__ls_at", F.col("__ls_at")[0])
    many = rows.cut(once.where(F.size("__ls_at") > 1))
    placed = keyed.join(rows.small(single), match)
    if not many.isEmpty():
        again = keyed.join(rows.small(many), match)
        numbered = again.withColumn("__ls_n", F.row_number().over(W.partitionBy("__ls_row", "__ls_s").orderBy("doc_id")))
        placed = placed.union(numbered.withColumn("__ls_at", F.element_at("__ls_at", F.col("__ls_n"))).drop("__ls_n"))
    spread = placed.repartitionByRange("__ls_at", "__ls_row").sortWithinPartitions("__ls_at", "__ls_row")
    return spread.drop("__ls_row", "__ls_k", "__ls_s", "__ls_at")
