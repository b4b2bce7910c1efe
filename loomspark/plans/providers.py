"""Model providers: the protocol, HTTP clients, a stub, and the operator that maps prompts to replies.

A provider is any object with generate(prompt, *, model, temperature, max_tokens, system) -> str that can be pickled;
it raises RuntimeError where it gives up. Replies never come from re-evaluation: `ask` writes them to the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..operators import storage


class Provider(Protocol):
    def generate(self, prompt: str, *, system: str | None = None, model: str | None = None, max_tokens: int = 800, temperature: float = 0.7) -> str: ...


@dataclass
class _Http:
    base_url: str
    default_model: str = ""
    api_key: str | None = field(default=None, repr=False)
    timeout: float = 300.0
    tries: int = 3

    def _post(self, path: str, body: dict) -> dict:
        last: Exception | None = None
        for attempt in range(1, self.tries + 1):
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
            request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    return json.loads(got.read())
            except (OSError, ValueError) as e:
                last = e
                if attempt < self.tries:
                    time.sleep(attempt)
        raise RuntimeError(f"the model at {self.base_url} failed: {last}")


class OllamaProvider(_Http):
    """A local server's generate call."""

    def generate(self, prompt: str, *, system: str | None = None, model: str | None = None, max_tokens: int = 800, temperature: float = 0.7) -> str:
        body = {"stream": False, "prompt": prompt, "options": {"num_predict": max_tokens, "temperature": temperature}, "model": model or self.default_model}
        return self._post("/api/generate", body | ({"system": system} if system else {})).get("response", "")


class ChatProvider(_Http):
    """A chat-completions call; no choices give an empty reply."""

    def generate(self, prompt: str, *, system: str | None = None, model: str | None = None, max_tokens: int = 800, temperature: float = 0.7) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        got = self._post("/chat/completions", {"temperature": temperature, "max_tokens": max_tokens, "messages": messages, "model": model or self.default_model})
        choices = got.get("choices") or []
        return (choices[0].get("message") or {}).get("content") or "" if choices else ""


class StubProvider:
    """Replies that are a function of the prompt alone, for tests and the bench."""

    default_model = "stub"

    def generate(self, prompt: str, *, system: str | None = None, model: str | None = None, max_tokens: int = 800, temperature: float = 0.7) -> str:
        h = int(hashlib.sha1(prompt.encode()).hexdigest()[:8], 16)
        words = re.findall(r"\w+", prompt.rpartition("<<<")[2])
        pick = lambda k: " ".join(words[(h + k * 7) % max(1, len(words)) :][:6]) or "nothing"
        if "JSON array" in prompt:
            n = int((re.search(r"exactly (\d+)", prompt) or [0, "2"])[1])
            return json.dumps([f"Explain how {pick(k)} works ({h % 997})" for k in range(n)])
        if '"score"' in prompt:
            return json.dumps({"score": 4 + h % 7, "reason": f"stub {h % 10}"})
        if '"messages"' in prompt:
            turns = int((re.search(r"exactly (\d+)", prompt) or [0, "4"])[1])
            return json.dumps({"messages": [{"content": f"{pick(k)} {k}", "role": ("user", "assistant")[k % 2]} for k in range(turns)]})
        if "Rewrite" in prompt:
            return "Rewritten: " + f"Compare {pick(1)} with {pick(2)} step by step ({h % 997})"
        return " ".join([pick(0), pick(1), pick(2), "so it goes"])


@dataclass(frozen=True)
class Call:
    """What is asked of the model besides the prompt. threads: parallel calls in each task."""

    model: str | None = None
    temperature: float = 0.7
    max_tokens: int = 800
    system: str | None = None
    threads: int = 1


#: Up to so many requests are spread over the tasks before they are asked; more stay where they lie.
SPREAD = 10_000
#: Requests of which the prompts are held in Python at a time.
AT_ONCE = 256


def _one(provider: Provider, call: Call):
    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return provider.generate(prompt, model=call.model, temperature=call.temperature, max_tokens=call.max_tokens, system=call.system), None
        except RuntimeError as e:
            return None, str(e)

    return one


def _each(provider: Provider, call: Call):
    """Batches with the prompt as the last column; the reply and the error stand in its place."""
    one = _one(provider, call)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(1, call.threads)) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    got = list(pool.map(one, part.column(part.num_columns - 1).to_pylist()))
                    new = [pa.array([x[k] for x in got], pa.string()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*part.schema.names[:-1], "response", "error"])

    return run


def _map(provider: Provider, call: Call):
    one = _one(provider, call)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, call.threads)) as pool:
            for batch in batches:
                got = list(pool.map(one, batch["prompt"]))
                yield batch[["key"]].assign(response=[r for r, _ in got], error=[e for _, e in got])

    return run


def model_of(provider: Provider, call: Call) -> str:
    return call.model or getattr(provider, "default_model", "") or ""


def ask(requests: DataFrame, provider: Provider, call: Call, cache: "Cache | None" = None) -> DataFrame:
    """requests (with `prompt`) and their `response` and `error`; each different prompt is asked once.

    The replies are written before anything reads them. With a cache, calls of a temperature up to its limit are looked up first, and new replies are added.
    """
    requests = storage.cut(requests)
    key = keys.cache_key(F.lit(model_of(provider, call)), F.lit(call.temperature), F.lit(call.max_tokens), F.lit(call.system).cast("string"), F.col("prompt"))
    wanted = requests.select("prompt").distinct().withColumn("key", key)
    use = cache is not None and call.temperature <= cache.limit
    known = cache.rows(requests.sparkSession).select("key", "response") if use else None
    missing = wanted if known is None else wanted.join(known, "key", "left_anti")
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replies = storage.cut(missing.repartition(tasks, "key").mapInPandas(_map(provider, call), "key string, response string, error string"))
    if use:
        cache.add(replies.where("error is null").join(wanted, "key"), provider, call)
        hits = wanted.join(known, "key").select("key", "response", F.lit(None).cast("string").alias("error"))
        cache.hits, cache.misses = cache.hits + hits.count(), cache.misses + replies.count()
        replies = replies.unionByName(hits)
    replies = replies.withColumnRenamed("key", "__key")
    return requests.withColumn("__key", key).join(replies, "__key", "left").drop("__key")


def ask_each(requests: DataFrame, provider: Provider, call: Call, cache: "Cache | None" = None) -> DataFrame:
    """The same, without `prompt`, for requests of which no two have the same prompt: they are asked where they lie, and no text is shuffled.

    The caller writes the result before it reads it; the requests must come from files, as they may be read twice.
    """
    if cache is not None and call.temperature <= cache.limit:
        return ask(requests, provider, call, cache).drop("prompt")
    if requests.limit(SPREAD + 1).count() <= SPREAD:
        requests = requests.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in requests.columns if c != "prompt"]
    schema = T.StructType([*(requests.schema[c] for c in others), T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    return requests.select(*others, "prompt").mapInArrow(_each(provider, call), schema)


@dataclass
class Cache:
    """Replies of deterministic calls as a Parquet table; of several replies to a key the newest counts."""

    path: str
    limit: float = 0.0
    hits: int = 0
    misses: int = 0

    COLUMNS = "key string, model string, temperature double, max_tokens int, prompt string, system string, response string, created_at double"

    def rows(self, spark) -> DataFrame:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], self.COLUMNS)
        table = spark.read.schema(self.COLUMNS).parquet(self.path)
        newest = table.groupBy("key").agg(F.max_by(F.struct(*[c for c in table.columns if c != "key"]), "created_at").alias("x"))
        return storage.cut(newest.select("key", "x.*"))

    def add(self, replies: DataFrame, provider: Provider, call: Call) -> None:
        replies.select(
            "key", F.lit(model_of(provider, call)).alias("model"), F.lit(float(call.temperature)).alias("temperature"), F.lit(call.max_tokens).alias("max_tokens"), "prompt",
            F.lit(call.system).cast("string").alias("system"), "response", F.lit(time.time()).alias("created_at"),
        ).write.mode("append").parquet(self.path)

    def stats(self, spark) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "entries": self.rows(spark).count()}
