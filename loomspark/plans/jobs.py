"""Generation jobs: a small store, a runner with cooperative cancelling, and the calls a service would offer."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import keys
from ..sources import files
from ..sources.settings import Settings, load, provider_of
from . import pipeline
from .providers import Cache

COLUMNS = ("id", "kind", "params", "status", "progress", "message", "result", "error", "created_at", "finished_at", "cancel_requested")
SCHEMA = "id string, kind string, params string, status string, progress double, message string, result string, error string, created_at double, finished_at double, cancel_requested int"
PARAMETERS = {"description": str, "language": str, "target_examples": int, "min_judge_score": int, "diversity_threshold": float, "generate_dpo_pairs": bool, "concurrency": int, "evol_factor": float}
KINDS = {"generate_from_text": "text", "generate_from_pdf": "pdf_path", "generate_from_url": "url"}


class Cancelled(Exception):
    pass


class Store:
    """Job rows in SQLite on the driver; they are few."""

    def __init__(self, path: str | Path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.lock = threading.RLock()
        self.db = sqlite3.connect(str(path), check_same_thread=False)
        with self.lock, self.db:
            self.db.execute(f"create table if not exists jobs ({', '.join(COLUMNS)}, primary key (id))")
            # what ran when the service stopped can't go on
            self.db.execute("update jobs set status = 'failed', error = 'the service stopped', finished_at = ? where status not in ('succeeded', 'failed', 'cancelled')", (time.time(),))

    def add(self, kind: str, params: dict) -> str:
        job = uuid.uuid4().hex
        with self.lock, self.db:
            self.db.execute(f"insert into jobs values ({', '.join('?' * len(COLUMNS))})", (job, kind, json.dumps(params), "queued", 0.0, "", None, None, time.time(), None, 0))
        return job

    def update(self, job: str, **values) -> None:
        if values.get("status") in ("succeeded", "failed", "cancelled"):
            values["finished_at"] = time.time()
        with self.lock, self.db:
            self.db.execute(f"update jobs set {', '.join(f'{k} = ?' for k in values)} where id = ?", (*values.values(), job))

    def get(self, job: str) -> dict | None:
        with self.lock:
            row = self.db.execute(f"select {', '.join(COLUMNS)} from jobs where id = ?", (job,)).fetchone()
        if row is None:
            return None
        found = dict(zip(COLUMNS, row))
        return found | {k: json.loads(found[k]) if found[k] else None for k in ("params", "result")}

    def latest(self, limit: int = 20, status: str | None = None) -> list[dict]:
        """The newest jobs, 1 to 200 of them."""
        where, args = (" where status = ?", (status,)) if status else ("", ())
        with self.lock:
            ids = self.db.execute(f"select id from jobs{where} order by created_at desc, id limit ?", (*args, max(1, min(200, limit)))).fetchall()
        return [self.get(i) for (i,) in ids]

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(self.db.execute(f"select {', '.join(COLUMNS)} from jobs").fetchall(), SCHEMA)


class Service:
    """Runs jobs on threads that share one Spark session; each job's Spark work carries its id as a tag."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, workers: int = 1, cache: str | None = None):
        self.spark, self.settings, self.cache = spark, settings or load(), cache
        self.store = Store(self.settings.workspace / "jobs.sqlite")
        self.pool = ThreadPoolExecutor(workers)

    def submit(self, kind: str, params: dict) -> dict:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if not str(params.get(KINDS[kind], "")).strip() or not str(params.get("description", "")).strip():
            raise ValueError(f"{KINDS[kind]} and description are needed")
        bounds = {"target_examples": (1, 5000), "min_judge_score": (0, 10), "concurrency": (1, 32), "diversity_threshold": (0.01, 0.99), "evol_factor": (0, 1)}
        for name, (low, high) in bounds.items():
            if name in params and not low <= float(params[name]) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        job = self.store.add(kind, params)
        self.pool.submit(self._run, job, params)
        return {"job_id": job, "status": "queued"}

    def _run(self, job: str, params: dict) -> None:
        from ..sinks import runs

        def progress(fraction: float, message: str) -> None:
            if (self.store.get(job) or {}).get("cancel_requested"):
                raise Cancelled
            self.store.update(job, progress=round(fraction, 3), message=message)

        self.spark.addTag(f"job-{job}")
        try:
            progress(0.0, "starting")
            self.store.update(job, status="running")
            chunks = files.for_job(self.spark, params)
            s = self.settings
            given = {name: kind(params[name]) for name, kind in PARAMETERS.items() if params.get(name) is not None}
            calls = given.setdefault("concurrency", 4)
            models = {name: getattr(s, name) for name in ("generator_model", "judge_model", "embedding_model")}
            config = pipeline.Config(**given, **models, overflow="reject" if calls > 1 else "unexamined")
            cache = Cache(self.cache) if self.cache else None
            out = pipeline.run(self.spark, config, chunks, provider_of(s), cache=cache, progress=progress)
            stem = f"{keys.slug(params.get('name') or params['description'][:40])}_{int(time.time())}"
            manifest = runs.write(out, config, s, s.workspace / "datasets" / stem, stem=stem, cache=cache)
            self.store.update(job, result=json.dumps(manifest), message="done", progress=1.0, status="succeeded")
        except Cancelled:
            self.store.update(job, status="cancelled", message="cancelled")
        except Exception as e:  # a job's failure is its result, not the service's
            cancelled = (self.store.get(job) or {}).get("cancel_requested")
            self.store.update(job, status="cancelled" if cancelled else "failed", error=f"{type(e).__name__}: {e}"[:2000])
        finally:
            self.spark.removeTag(f"job-{job}")

    def status(self, job: str) -> dict:
        return self.store.get(job) or {"error": f"no job {job}"}

    def list(self, limit: int = 20, status: str | None = None) -> list[dict]:
        return self.store.latest(limit, status)

    def cancel(self, job: str) -> dict:
        found = self.store.get(job)
        if not found or found["status"] not in ("queued", "running"):
            return {"cancelled": False}
        self.store.update(job, cancel_requested=1)
        self.spark.interruptTag(f"job-{job}")
        return {"cancelled": True}

    def wait(self, job: str, timeout: float = 600.0, poll: float = 0.2) -> dict:
        until = time.time() + timeout
        while time.time() < until and self.status(job).get("status") in ("queued", "running"):
            time.sleep(poll)
        return self.status(job)

    def health(self) -> dict:
        return {"status": "ok", "provider": self.settings.provider, "workspace": str(self.settings.workspace), "cache": Cache(self.cache).stats(self.spark) if self.cache else None}
