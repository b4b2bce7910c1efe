"""All files of a finished run: exports by format, card and manifest."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from ..operators import split
from ..plans.pipeline import Config, Output
from ..plans.providers import Cache
from ..sources.settings import Settings
from . import card, exports

FORMATS = ("jsonl", "openai", "flat")


def write(
    out: Output, config: Config, settings: Settings, folder: str | Path, *, formats: str = "jsonl,openai", eval_fraction: float = 0.1, stem: str | None = None, tool_calling: bool = False, datacard: bool = True,
    sources: str = "the description alone", cache: Cache | None = None,
) -> dict:
    """Writes the run and returns its manifest, which is also written."""
    folder, stem = Path(folder), stem or f"dataset_{int(time.time())}"
    wanted = {x.strip().lower() for x in formats.split(",") if x.strip()}
    parts = split.train_eval_split(out.examples, "key", eval_fraction)
    train, held = (parts.where(F.col("part") == p).orderBy("cand_idx") for p in ("train", "eval"))
    spark = out.examples.sparkSession
    files, sizes = {}, {}

    def lines(name: str, rows, file: str) -> None:
        files[name] = str(folder / file)
        sizes[name] = exports.write_lines(rows, files[name], one_file=True)

    lines("jsonl_train" if "jsonl" in wanted else "train", exports.record(train), f"{stem}.train.jsonl")
    lines("jsonl_eval" if "jsonl" in wanted else "eval", exports.record(held), f"{stem}.eval.jsonl")
    if "openai" in wanted:
        lines("openai_messages", exports.sft(train), f"{stem}.openai.jsonl")
    if "flat" in wanted:
        files["flat_json"] = str(folder / f"{stem}.flat.json")
        exports.write_array(exports.flat(train), files["flat_json"])
    if config.generate_dpo_pairs:
        lines("dpo", exports.preferences(out.pairs), f"{stem}.dpo.jsonl")
    lines("rejected", exports.record(out.rejected), f"{stem}.rejected.jsonl")
    if tool_calling:
        files["tool_calling"] = str(folder / f"{stem}.tool_calling.jsonl")
        sizes["tool_calling"] = exports.write_tool_lines(exports.tool_calls(train), files["tool_calling"], one_file=True)
    stats = out.stats.first().asDict() | {"elapsed_sec": out.elapsed_sec}
    n_train, n_eval = next(v for k, v in sizes.items() if k.endswith("train")), next(v for k, v in sizes.items() if k.endswith("eval"))
    knobs = {k: getattr(config, k) for k in ("description", "language", "target_examples", "min_judge_score", "diversity_threshold", "min_hallucination_overlap")}
    models = {k: getattr(settings, k) for k in ("provider", "generator_model", "judge_model", "embedding_model")}
    if datacard:
        info = card.CardInfo(
            config.description[:60], config.description, config.language, sources, models, {"train": n_train, "eval": n_eval, "preference pairs": sizes.get("dpo", 0), "rejected": sizes["rejected"]}, stats=stats, config=knobs, tags=[config.language.lower()]
        )
        files["dataset_card"] = str(card.write(folder / "README.md", info))
    manifest = {"stats": stats, "train_size": n_train, "eval_size": n_eval, "config": knobs | models, "files": files}
    if tool_calling:
        manifest["tool_calling_count"] = sizes["tool_calling"]
    manifest |= {} if cache is None else {"cache": cache.stats(spark)}
    exports.write_json(manifest, str(folder / f"{stem}.manifest.json"))
    return manifest
