"""Prompts as column expressions. The material stands behind <<< at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MUTATIONS = {
    "deepen": "so that a good answer must explain causes, limits and hard cases",
    "constrain": "so that one believable restriction applies, such as a budget, a date, a format or a forbidden tool",
    "concretize": "so that it is about one definite case with names, amounts or dates",
    "reason": "so that the answer has to be worked out in several visible steps",
    "broaden": "so that it also asks how a neighbouring case differs",
    "troubleshoot": "so that something has failed and the cause and the remedy are to be found",
}
#: Characters of a chunk that the judge sees.
REFERENCE_CHARS = 2000


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def seeds(text: Column, config) -> Column:
    return _join(f"Write exactly {config.seeds_per_chunk} different questions or tasks in {config.language} that the passage below can answer. Reply with a JSON array of strings only.\n<<<\n", text)


def free_seeds(config) -> str:
    return f"Write exactly {config.seeds_from_description} different questions or tasks in {config.language} that users would bring to this assistant. Reply with a JSON array of strings only.\n<<<\n{config.description}"


def rewrite(instruction: Column, mutation: Column, config) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MUTATIONS.items() for x in pair])
    return _join("Rewrite the task below ", F.element_at(table, mutation), f". Keep its subject, write in {config.language}, and reply with the new task alone.\n<<<\n", instruction)


def answer(config) -> Column:
    with_text = _join(f"You are: {config.description}\nAnswer in {config.language}, using only the passage.\nTask: ", F.col("instruction"), "\nPassage:\n<<<\n", F.col("chunk_text"))
    free = _join(f"You are: {config.description}\nAnswer in {config.language}.\nTask:\n<<<\n", F.col("instruction"))
    return F.when(F.col("chunk_text").isNotNull(), with_text).otherwise(free)


def judge(config, reference: Column | None) -> Column:
    ask = f'Grade the answer from 0 to 10 for an assistant described as: {config.description}\nReply with a JSON object like {{"score": 7, "reason": "short"}}.\n'
    block = F.lit("") if reference is None else F.coalesce(_join("Reference:\n", F.substring(reference, 1, REFERENCE_CHARS), "\n"), F.lit(""))
    return _join(ask, block, "Task: ", F.col("instruction"), "\nAnswer:\n<<<\n", F.col("output"))


def weak() -> Column:
    return _join("Answer the task below briefly and vaguely, in one or two careless sentences.\n<<<\n", F.col("instruction"))


def dialogue(config, turns: int) -> Column:
    head = f'Write a conversation of exactly {turns} messages in {config.language} between a user and this assistant: {config.description}\nThe user begins, they take turns, the assistant has the last word. Reply with one JSON object whose "messages" are a list of objects with the keys role and content.\n<<<\n'
    return _join(head, F.coalesce("text", F.lit(config.description)))
