"""Settings from the environment and a dotenv file, and what is built from them."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from ..plans.providers import ChatProvider, OllamaProvider, Provider, StubProvider

PROVIDERS = ("ollama", "openai", "stub")


@dataclass(frozen=True)
class Settings:
    provider: str = "ollama"
    ollama_url: str = "http://localhost:11434"
    openai_url: str = "https://api.openai.com/v1"
    api_key: str | None = None
    generator_model: str = "llama3.1"
    judge_model: str = "llama3.1"
    embedding_model: str = "hash"
    workspace: Path = Path("workspace")


def dotenv(path: str | Path) -> dict[str, str]:
    """NAME=value lines; comments and blank lines are skipped, quotes around values dropped."""
    out = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out


def load(env: dict[str, str] | None = None, file: str | Path = ".env") -> Settings:
    """LOOMSPARK_* settings; the environment goes before the file."""
    env = dotenv(file) | dict(os.environ if env is None else env)
    get = lambda name, default: (env.get(f"LOOMSPARK_{name}") or "").strip() or default
    provider = get("PROVIDER", "ollama").lower()
    if provider not in PROVIDERS:
        raise ValueError(f"LOOMSPARK_PROVIDER must be one of {', '.join(PROVIDERS)}")
    model = get("GENERATOR_MODEL", "llama3.1")
    found = Settings(provider, get("OLLAMA_URL", Settings.ollama_url).rstrip("/"), get("OPENAI_URL", Settings.openai_url).rstrip("/"), get("API_KEY", None), model, get("JUDGE_MODEL", model), get("EMBEDDING_MODEL", "hash"), Path(get("WORKSPACE", "workspace")))
    found.workspace.mkdir(parents=True, exist_ok=True)
    return found


def provider_of(s: Settings) -> Provider:
    if s.provider == "stub":
        return StubProvider()
    if s.provider == "ollama":
        return OllamaProvider(s.ollama_url, s.generator_model)
    return ChatProvider(s.openai_url, s.generator_model, s.api_key)
