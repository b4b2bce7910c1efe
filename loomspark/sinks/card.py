"""Dataset cards and manifests, from one row of counters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..functions import keys

OWN_TAGS = ("loomspark", "synthetic", "instruction-tuning")
KNOBS = (("Smallest judge score", "min_judge_score"), ("Similarity limit", "diversity_threshold"), ("Smallest word overlap", "min_hallucination_overlap"), ("Examples wanted", "target_examples"))


@dataclass
class CardInfo:
    title: str
    description: str
    language: str
    sources: str
    models: dict[str, str]
    counts: dict[str, int]
    license: str = "mit"
    stats: dict[str, Any] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)


def code_of(language: str) -> str:
    return keys.LANGUAGES.get(language.strip().lower(), "en")


def bucket_of(n: int) -> str:
    return next((name for limit, name in keys.BUCKETS if n < limit), "n>1M")


def tag_list(tags: Iterable[str]) -> list[str]:
    """Lower-case tags and our own, without repeats, in order."""
    return list(dict.fromkeys(t for t in (x.lower().strip() for x in [*tags, *OWN_TAGS]) if t))


def sources_of(pdfs: Iterable[str] = (), texts: Iterable[str] = (), urls: Iterable[str] = (), chunks: str | None = None) -> str:
    parts = [f"PDF {p}" for p in pdfs] + [f"text {p}" for p in texts] + [f"page {u}" for u in urls] + ([f"chunk file {chunks}"] if chunks else [])
    return "; ".join(parts) or "the description alone"


def _table(rows: Iterable[tuple[str, Any]], head: str) -> list[str]:
    return [f"| {head} | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in rows)]


def render(info: CardInfo) -> str:
    """YAML head and Markdown body; a knob that isn't known is shown as ?."""
    head = ["---", "language:", f"- {code_of(info.language)}", f"license: {info.license}", "task_categories:", "- text-generation", "- question-answering", f'pretty_name: "{info.title}"']
    head += ["size_categories:", f"- {bucket_of(info.counts.get("train", 0))}", "tags:", *(f"- {t}" for t in tag_list(info.tags))]
    head += ["configs:", "- config_name: default", "  data_files:", "  - split: train", '    path: "*.train.jsonl"', "  - split: validation", '    path: "*.eval.jsonl"', "---"]
    counts = [*info.counts.items(), ("language", info.language), ("license", info.license)]
    made = [*info.models.items()] + [(label, info.config.get(k, "?")) for label, k in KNOBS]
    body = [f"# {info.title}", "", info.description.strip(), "", "## Contents", "", *_table(counts, "part"), "", "## Making", "", f"Made from {info.sources.strip()}: a model proposes tasks about each chunk and answers them;"]
    body += ["near-duplicate tasks, answers without support in their chunk and answers with a low grade are left out.", "", *_table(made, "knob"), "", "## Counters", "", *_table(info.stats.items(), "counter"), ""]
    body += ["## Use and limits", "", "For fine-tuning and preference training. Answers are a model's; for facts, read the sources. Examples without", "source chunks rest on the description alone. Check the sources for personal data before publishing.", ""]
    return "\n".join(head) + "\n\n" + "\n".join(body)


def write(path: str | Path, info: CardInfo) -> Path:
    target = Path(path)
    text = render(info)
    target.parent.mkdir(exist_ok=True, parents=True)
    target.write_text(text, encoding="utf-8")
    return target
