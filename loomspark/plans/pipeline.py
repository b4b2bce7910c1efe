"""The generation run: chunks -> seeds -> answers -> gates -> kept, rejected, preference pairs; and dialogues.

A run is a chain of DataFrame stages. Every stage that asks a model is written to Parquet under run_dir/<signature>/
before anything reads it, so that no retry, second action or optimiser rule asks again, and an interrupted run goes on
after its last finished stage. Rows carry explicit order columns; nothing depends on partitions.

Chunks are written once, and texts are not shuffled: a text that several chunks have is asked for one of them, its owner,
where it lies, and everything behind that carries the owner's id. The gates look at candidates in waves until
the target is kept, each with all that come before it, as no decision depends on a later candidate.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, replies
from ..functions import text as X
from ..operators import dedup, embedding, gates, grounding, split, storage
from . import prompts
from .providers import Cache, Call, Provider, ask, ask_each

Progress = Callable[[float, str], None]


@dataclass(frozen=True)
class Config:
    description: str
    language: str = "English"
    seed: int = 1234
    # how many
    seeds_from_description: int = 40
    seeds_per_chunk: int = 6
    evol_rounds: int = 1
    evol_factor: float = 0.0
    target_examples: int = 200
    dpo_target_pairs: int = 50
    generate_dpo_pairs: bool = False
    overflow: str = "unexamined"
    # gates
    min_judge_score: int = 7
    min_semantic_similarity: float | None = None
    min_hallucination_overlap: float = 0.35
    diversity_threshold: float = 0.9
    # models
    judge_model: str | None = None
    generator_model: str | None = None
    embedding_model: str = "hash"
    answer_max_tokens: int = 800
    generator_temperature: float = 0.7
    #: Physical knobs, which no result depends on.
    concurrency: int = 1
    wave: int = 4096

    def logical(self) -> dict:
        return {k: v for k, v in dataclasses.asdict(self).items() if k not in ("concurrency", "wave")}


@dataclass
class Output:
    """examples, rejected and pairs, and one row of stats."""

    examples: DataFrame
    rejected: DataFrame
    pairs: DataFrame
    stats: DataFrame
    elapsed_sec: float = 0.0


@dataclass(frozen=True)
class MultiturnConfig:
    description: str
    language: str = "English"
    target: int = 100
    turns: int = 4
    temperature: float = 0.8
    max_tokens: int = 1200
    model: str | None = None
    seed: int = 1234
    concurrency: int = 1


@dataclass
class MultiturnOutput:
    dialogues: DataFrame
    asked: int
    valid: int


class Stages:
    """Named stage tables of one run; a finished stage is read, not computed again."""

    def __init__(self, spark: SparkSession, run_dir: str | None, signature: str):
        self.spark = spark
        self.root = f"{run_dir or storage.shared_folder(spark)}/{signature if run_dir else f'run-{signature[:12]}-{time.time_ns()}'}"

    def _done(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._done(path):
            storage.stored(make(), path)
        return self.spark.read.parquet(path)


#: Most different texts with copies that are broadcast.
SHARED_TEXTS = 1_000_000


def one_an_id(chunks: DataFrame, path: str) -> DataFrame:
    """Rows (id, text) of the chunks, written to path; of several with an id the one of the highest index. Only those are shuffled."""
    written = storage.stored(chunks.select("id", "text", "index"), path)
    again = storage.cut(written.groupBy("id").count().where("count > 1").select(F.col("id").alias("__id")))
    if again.isEmpty():
        return written.drop("index")
    again = storage.small(again)
    same = F.col("id").eqNullSafe(F.col("__id"))
    last = storage.stored(written.join(again, same, "left_semi").groupBy("id").agg(F.max_by("text", "index").alias("text")), f"{path}-again")
    return written.join(again, same, "left_anti").drop("index").unionByName(last)


def different_texts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text) of each different text's owner, the chunk of the least id; rows (id, owner) of the other chunks."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    marked = chunks.select("id", digest.alias("digest"))
    shared = storage.cut(marked.groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("n")).where("n > 1 and digest is not null").drop("n"))
    copies = marked.join(shared, "digest").where("id != owner").select("id", "owner")
    # two numbers for the digest, as its text would make a large broadcast
    halves = lambda d: (F.xxhash64(d), F.xxhash64(F.lit("second"), d))
    a, b = halves(F.col("digest"))
    owners = storage.small(shared.select(a.alias("__a"), b.alias("__b"), "owner"), SHARED_TEXTS)
    a, b = halves(digest)
    texts = chunks.join(owners, (a == F.col("__a")) & (b == F.col("__b")), "left").where("owner is null or id = owner").select("id", "text")
    return texts, copies


def collect_seeds(spark: SparkSession, config: Config, asked: DataFrame, copies: DataFrame, provider: Provider, cache: Cache | None = None) -> DataFrame:
    """Rows (key, instruction, chunk_id, owner): seeds of each chunk, from the rows (id, text, found) of the owners, and, without a chunk, of the description."""
    own = asked.select(F.col("id").alias("owner"), F.posexplode("found").alias("n", "instruction"))
    found = own.withColumn("chunk_id", F.col("owner")).unionByName(copies.withColumnRenamed("id", "chunk_id").join(own, "owner"))
    found = found.select(F.concat_ws("#", "chunk_id", "n").alias("key"), "instruction", "chunk_id", "owner")
    if config.seeds_from_description <= 0:
        return found
    one = spark.createDataFrame([(prompts.free_seeds(config),)], "prompt string")
    free = ask(one, provider, Call(config.generator_model, 0.95, 1200, threads=config.concurrency), cache)
    free = free.select(F.posexplode(replies.seeds(F.col("response"))).alias("n", "instruction"))
    none = F.lit(None).cast("string")
    return found.unionByName(free.select(F.concat(F.lit("#free#"), "n").alias("key"), "instruction", none.alias("chunk_id"), none.alias("owner")))


def answers(config: Config, asked: DataFrame, seeds: DataFrame, provider: Provider, cache: Cache | None = None) -> DataFrame:
    """Rows (owner, instruction, response), one for each different instruction of a text, or of none."""
    call = Call(config.generator_model, config.generator_temperature, config.answer_max_tokens, threads=config.concurrency)
    texts = asked.select(F.col("id").alias("owner"), F.col("text").alias("chunk_text"), F.array_distinct("found").alias("found"))
    own = texts.select("owner", "chunk_text", F.explode("found").alias("instruction"))
    if config.evol_factor > 0:
        new = seeds.where("owner is not null").select("owner", "instruction").distinct().join(own.select("owner", "instruction"), ["owner", "instruction"], "left_anti")
        own = own.unionByName(new.join(texts.drop("found"), "owner"))
    free = seeds.where("owner is null").select("instruction").distinct().withColumn("owner", F.lit(None).cast("string")).withColumn("chunk_text", F.lit(None).cast("string"))
    got = ask_each(own.select("owner", "instruction", prompts.answer(config).alias("prompt")), provider, call, cache)
    got = got.unionByName(ask(free.select("owner", "instruction", prompts.answer(config).alias("prompt")), provider, call, cache).drop("prompt"))
    return got.select("owner", "instruction", "response")


def evolve(seeds: DataFrame, config: Config, provider: Provider, cache: Cache | None = None) -> DataFrame:
    """seeds and the rewritings of a share evol_factor of them in each round, with the same chunk."""
    factor = max(0.0, min(1.0, config.evol_factor))
    if factor == 0:
        return seeds
    rounds = seeds.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(config.evol_rounds))))
    picked = rounds.where(keys.uniform(config.seed, F.col("key"), F.col("round")) <= factor)
    names = F.array(*[F.lit(x) for x in sorted(prompts.MUTATIONS)])
    mutation = F.element_at(names, (F.pmod(F.xxhash64(F.lit(config.seed + 1), "key", "round"), F.lit(len(prompts.MUTATIONS))) + 1).cast("int"))
    asked = ask(picked.withColumn("prompt", prompts.rewrite(F.col("instruction"), mutation, config)), provider, Call(config.generator_model, 0.8, 400, threads=config.concurrency), cache)
    new = asked.select(F.concat_ws("~", "key", "round").alias("key"), replies.evolution(F.col("response"), F.col("instruction")).alias("instruction"), "chunk_id", "owner")
    return seeds.unionByName(new.where("instruction is not null"))


def judge(rows: DataFrame, config: Config, provider: Provider, reference: Column | None, cache: Cache | None = None) -> DataFrame:
    """rows (instruction, output) with judge_score and judge_reason; a failed call scores 0 and says why."""
    asked = ask(rows.withColumn("prompt", prompts.judge(config, reference)), provider, Call(config.judge_model, 0.0, 200, threads=config.concurrency), cache)
    v = replies.verdict(F.col("response"))
    failed = F.col("error").isNotNull()
    got = asked.withColumn("judge_score", F.when(failed, 0).otherwise(v.score)).withColumn("judge_reason", F.when(failed, F.concat(F.lit("judge error: "), "error")).otherwise(v.reason))
    return got.drop("prompt", "response", "error")


def _gated(candidates: DataFrame, texts: DataFrame, config: Config) -> DataFrame:
    """candidates with the verdicts of the gates before the judge; texts: rows (owner, chunk_text) of theirs at least."""
    if embedding.available(config.embedding_model) == "hash":
        marked = dedup.diversity(candidates, "cand_idx", "instruction", config.diversity_threshold)
    else:
        vectors = storage.cut(embedding.vectors(candidates, "cand_idx", "instruction", config.embedding_model))
        marked = dedup.vector_diversity(candidates.join(vectors, "cand_idx"), "cand_idx", "vector", config.diversity_threshold).drop("vector")
    with_chunk = candidates.select("cand_idx", "output", "owner").join(texts, "owner").drop("owner")
    scored = grounding.ground(with_chunk, "cand_idx", "output", "chunk_text", config.min_hallucination_overlap, config.min_semantic_similarity, model=config.embedding_model)
    marked = marked.join(scored.select("cand_idx", F.col("token_score").alias("hallucination_score"), "semantic", "grounded"), "cand_idx", "left")
    gated = gates.gate(F.col("accepted"), F.col("grounded"), F.lit(10), 0)
    return marked.withColumn("early", F.when(gated != "kept", gated))


def _examine(stages: Stages, candidates: DataFrame, n: int, texts: DataFrame, config: Config, provider: Provider, cache: Cache | None) -> DataFrame:
    """The first candidates of n, by cand_idx, with decisions: in waves until the target is kept, each four times as long; all of them where the overflow is rejected."""
    low, kept, judged = 0, 0, None
    high = n if config.overflow == "reject" else min(n, config.wave)
    while True:
        seen = candidates.where(F.col("cand_idx") < high)
        near = texts
        if high < n:
            owners = storage.small(storage.cut(seen.where("owner is not null").select("owner").distinct()))
            near = stages(f"texts-{high}", lambda owners=owners: texts.join(owners, "owner", "left_semi"))
        ready = stages(f"ready-{high}", lambda seen=seen, near=near: _gated(seen, near, config))
        part = ready.where((F.col("cand_idx") >= low) & F.col("early").isNull()).join(near, "owner", "left")
        got = stages(f"judged-{low}-{high}", lambda part=part: judge(part, config, provider, F.col("chunk_text"), cache).drop("chunk_text"))
        judged = got if judged is None else judged.unionByName(got)
        kept += got.where(F.col("judge_score") >= config.min_judge_score).count()
        if high >= n or kept >= config.target_examples:
            break
        low, high = high, min(n, 4 * high)
    scored = ready.join(judged.select("cand_idx", "judge_score", "judge_reason"), "cand_idx", "left")
    decision = F.coalesce("early", F.when(F.col("judge_score") < config.min_judge_score, "judge_rejected").otherwise("kept"))
    return gates.stop_at(scored.withColumn("decision", decision), "cand_idx", config.target_examples, config.overflow)


def run(
    spark: SparkSession, config: Config, chunks: DataFrame, provider: Provider, *, judge_provider: Provider | None = None, run_dir: str | None = None, cache: Cache | None = None, progress: Progress = lambda f, m: None
) -> Output:
    """The whole run. With run_dir, a run with the same config and chunks goes on where it stopped."""
    started = time.time()
    judge_provider = judge_provider or provider
    folder = storage.scratch(spark, "chunks")
    chunks = one_an_id(chunks, f"{folder}/all")
    stages = Stages(spark, run_dir, keys.signature(config.logical(), chunks.count(), keys.ids_hash(chunks, "id")))

    progress(0.02, "collecting seeds")
    texts, copies = different_texts(chunks)
    call = Call(config.generator_model, 0.9, 768, threads=config.concurrency)

    def questions() -> DataFrame:
        got = ask_each(texts.withColumn("prompt", prompts.seeds(F.col("text"), config)), provider, call, cache)
        return got.select("id", "text", replies.seeds(F.col("response")).alias("found"))

    asked = stages("asked", questions)
    seeds = stages("seeds", lambda: evolve(collect_seeds(spark, config, asked, copies, provider, cache), config, provider, cache))
    storage.remove(spark, folder)
    n_seeds = seeds.count()

    progress(0.15, f"answering {n_seeds} seeds")
    replied = stages("replies", lambda: answers(config, asked, seeds, provider, cache))

    def answered() -> DataFrame:
        mine = replied.select(F.col("owner").alias("__owner"), F.col("instruction").alias("__instruction"), "response")
        got = seeds.join(mine, F.col("owner").eqNullSafe(F.col("__owner")) & (F.col("instruction") == F.col("__instruction")))
        good = got.withColumn("output", X.strip(F.col("response"))).withColumn("instruction", X.strip(F.col("instruction"))).where(F.length("output") >= 12)
        return split.shuffled(good.select("key", "instruction", "output", "chunk_id", "owner"), "key", config.seed, "cand_idx")

    candidates = stages("answers", answered)
    generated = candidates.count()
    texts = asked.select(F.col("id").alias("owner"), F.col("text").alias("chunk_text"))
    decided = stages("decisions", lambda: _examine(stages, candidates, generated, texts, config, judge_provider, cache))
    chunk_list = F.when(F.col("chunk_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("chunk_id"))
    examples = decided.withColumn("source_chunks", chunk_list).withColumn("format", F.lit("sft"))
    examples = examples.withColumn("metadata", F.when(F.col("semantic").isNotNull(), F.to_variant_object(F.struct(F.col("semantic").alias("semantic_similarity")))))
    examples = examples.select("cand_idx", "key", "instruction", "output", "source_chunks", "judge_score", "judge_reason", "hallucination_score", "format", "metadata", "decision")
    kept = examples.where("decision = 'kept'").drop("decision")
    rejected = examples.where("decision not in ('kept', 'unexamined')")

    pairs = stages("pairs", lambda: make_pairs(kept, config, provider, judge_provider, cache)) if config.generate_dpo_pairs else gates.preference_pairs(kept.withColumn("weak", F.lit("")).withColumn("weak_score", F.lit(0)))
    stats = gates.stats(decided, n_seeds, generated, pairs.count() if config.generate_dpo_pairs else 0)
    progress(1.0, "done")
    return Output(kept, rejected, pairs, stats, round(time.time() - started, 2))


def make_pairs(kept: DataFrame, config: Config, provider: Provider, judge_provider: Provider, cache: Cache | None = None) -> DataFrame:
    """Weak answers to some kept examples, judged without a reference, where they are worse."""
    pool = kept.orderBy(keys.lot(config.seed, F.concat(F.lit("pairs"), "key")), "key").limit(config.dpo_target_pairs)
    asked = ask(pool.withColumn("prompt", prompts.weak()), provider, Call(config.generator_model, 0.9, 300, threads=config.concurrency), cache)
    weak = asked.withColumn("weak", X.strip(F.col("response"))).where("weak != ''").drop("prompt", "response", "error")
    probe = weak.select("key", "instruction", F.col("weak").alias("output"))
    scores = judge(probe, config, judge_provider, None, cache).select("key", F.col("judge_score").alias("weak_score"))
    return gates.preference_pairs(weak.join(scores, "key"))


def run_multiturn(spark: SparkSession, config: MultiturnConfig, chunks: DataFrame, provider: Provider, cache: Cache | None = None) -> MultiturnOutput:
    """Dialogues about randomly picked chunks, or about the description if there are none; 1.3 times as many and 4 are asked for, and the first valid ones kept."""
    turns = max(2, min(8, config.turns)) // 2 * 2
    n = int(1.3 * config.target) + 4
    wanted = spark.range(n).withColumnRenamed("id", "dialogue")
    folder = storage.scratch(spark, "chunks")
    chunks = storage.stored(chunks.select("id", "text"), folder)
    count = chunks.count()
    if count:
        placed = storage.number_rows(chunks.select("id"), [F.col("id")], "n")
        pick = F.pmod(F.xxhash64(F.lit(config.seed), "dialogue"), F.lit(count))
        wanted = storage.cut(wanted.withColumn("n", pick).join(placed, "n").drop("n"))
        picked = chunks.join(storage.small(wanted.select("id").distinct()), "id", "left_semi")
        wanted = wanted.join(storage.cut(picked.groupBy("id").agg(F.min("text").alias("text"))), "id")
    else:
        wanted = wanted.withColumn("id", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))
    storage.remove(spark, folder)
    call = Call(config.model, config.temperature, config.max_tokens, threads=config.concurrency)
    asked = ask(wanted.withColumn("prompt", prompts.dialogue(config, turns)), provider, call, cache)
    valid = asked.withColumn("messages", replies.dialogue(F.col("response"), turns)).where("messages is not null")
    valid = storage.cut(valid.select("dialogue", "messages", F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.array("id")).alias("source_chunks")))
    return MultiturnOutput(valid.orderBy("dialogue").limit(config.target), n, valid.count())
