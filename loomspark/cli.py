"""Command line: ingest, generate, multiturn, cache-info, version."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import pipeline
from .plans.providers import Cache
from .sinks import card, exports, runs
from .sources import files
from .sources.settings import load, provider_of

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomspark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, sources: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if sources:
            for kind in ("pdf", "text", "url"):
                p.add_argument(f"--{kind}", action="append", default=[])
            p.add_argument("--target-chars", type=int, default=1200)
            p.add_argument("--overlap-chars", type=int, default=150)
        return p

    command("ingest").add_argument("--output", "-o", required=True)
    for name in ("generate", "multiturn"):
        p = command(name)
        p.add_argument("--description", "-d", required=True)
        p.add_argument("--output-dir", "-o", required=True)
        p.add_argument("--chunks")
        p.add_argument("--language", "-l", default="English")
        p.add_argument("--concurrency", "-c", type=int, default=1)
        p.add_argument("--cache")
        p.add_argument("--target", "-n", type=int, default=200 if name == "generate" else 100)
    p.add_argument("--turns", type=int, default=4)
    p.add_argument("--system-prompt")
    p = sub.choices["generate"]
    for flag, default in (("min-judge-score", 7), ("seeds-per-chunk", 6), ("seeds-from-description", 40), ("dpo-target-pairs", 50), ("evol-rounds", 1)):
        p.add_argument(f"--{flag}", type=int, default=default)
    for flag, default in (("diversity-threshold", 0.9), ("min-hallucination-overlap", 0.35), ("eval-fraction", 0.1), ("evol-factor", 0.0)):
        p.add_argument(f"--{flag}", type=float, default=default)
    p.add_argument("--min-semantic", type=float, help="similarity that also counts as grounded")
    p.add_argument("--formats", default="jsonl,openai")
    p.add_argument("--checkpoint", help="folder of a run that can go on after a stop")
    p.add_argument("--dpo", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--tool-calling", action="store_true")
    p.add_argument("--datacard", action=argparse.BooleanOptionalAction, default=True)
    command("cache-info", sources=False).add_argument("--cache", required=True)
    command("version", sources=False)
    return top


def _chunks(spark: SparkSession, a: argparse.Namespace):
    if getattr(a, "chunks", None):
        return files.read_chunks(spark, a.chunks)
    if not (a.pdf or a.text or a.url):
        return None
    return files.collect(spark, a.pdf, a.text, a.url, a.target_chars, a.overlap_chars)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("loomspark").getOrCreate()
    if a.command == "cache-info":
        print(json.dumps(Cache(a.cache).stats(spark)))
        return 0
    chunks = _chunks(spark, a)
    if a.command == "ingest":
        if chunks is None:
            raise SystemExit("give at least one of --pdf, --text, --url")
        print(exports.write_array(chunks.orderBy("source", "index"), a.output), "chunks")
        return 0
    settings = load()
    cache = Cache(a.cache) if a.cache else None
    if chunks is None:
        chunks = spark.createDataFrame([], files.CHUNKS)
    told = lambda f, m: print(f"{m} ({100 * f:.0f}%)", flush=True)
    if a.command == "multiturn":
        config = pipeline.MultiturnConfig(a.description, a.language, a.target, a.turns, model=settings.generator_model, concurrency=a.concurrency)
        got = pipeline.run_multiturn(spark, config, chunks, provider_of(settings), cache)
        path = str(Path(a.output_dir) / f"dialogues_{int(time.time())}.jsonl")
        n = exports.write_lines(exports.dialogues(got.dialogues.orderBy("dialogue"), a.system_prompt), path, one_file=True)
        exports.write_json({"dialogues": n, "asked": got.asked, "valid": got.valid, "file": path}, path.replace(".jsonl", ".manifest.json"))
        print(n, "dialogues")
        return 0
    same = "description language seeds_per_chunk seeds_from_description diversity_threshold min_judge_score min_hallucination_overlap dpo_target_pairs evol_factor evol_rounds concurrency".split()
    models = {name: getattr(settings, name) for name in ("generator_model", "judge_model", "embedding_model")}
    rest = {"target_examples": a.target, "min_semantic_similarity": a.min_semantic, "generate_dpo_pairs": a.dpo, "overflow": "reject" if a.concurrency > 1 else "unexamined"}
    config = pipeline.Config(**{name: getattr(a, name) for name in same}, **models, **rest)
    out = pipeline.run(spark, config, chunks, provider_of(settings), run_dir=a.checkpoint, cache=cache, progress=told)
    manifest = runs.write(
        out, config, settings, a.output_dir, formats=a.formats, eval_fraction=a.eval_fraction, tool_calling=a.tool_calling, datacard=a.datacard, sources=card.sources_of(a.pdf, a.text, a.url, a.chunks), cache=cache
    )
    print(json.dumps(manifest["stats"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
