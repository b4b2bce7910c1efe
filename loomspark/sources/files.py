"""Documents from text and PDF files, addresses, chunk files and inline text, as rows (source, text)."""

from __future__ import annotations

import io
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from .pages import text_of

ROWS = "source string, text string"
CHUNKS = "id string, text string, source string, index int, metadata struct<char_count: int>"


def text_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Whole files as UTF-8, bytes that aren't replaced by U+FFFD; a missing file is an error."""
    raw = spark.read.format("binaryFile").load([str(p) for p in paths])
    return raw.select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _pdf_text(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    pages = [(page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(p for p in pages if p)


def _pdfs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"source": batch["path"], "text": [_pdf_text(c) for c in batch["content"]]})


def pdf_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The pages' texts, blank ones left out, an empty line between them."""
    raw = spark.read.format("binaryFile").load([str(p) for p in paths])
    return raw.select("path", "content").mapInPandas(_pdfs, ROWS)


def fetch(url: str, timeout: float = 20.0, user_agent: str = "loomspark/1.0") -> tuple[str, str]:
    """Content type and body of an address."""
    request = urllib.request.Request(url, headers={"User-Agent": user_agent})
    with urllib.request.urlopen(request, timeout=timeout) as got:
        return got.headers.get("Content-Type", ""), got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")


def page_or_text(url: str, kind: str, body: str) -> str:
    """Plain text as it is, everything else as HTML."""
    plain = "text/plain" in kind.lower() or url.partition("?")[0].lower().rpartition(".")[2] in ("md", "txt")
    return body if plain else text_of(body) or ""


def urls(spark: SparkSession, addresses: Sequence[str], get: Callable[[str], tuple[str, str]] = fetch) -> DataFrame:
    """Addresses fetched on the executors; a failed one is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[page_or_text(u, *get(u)) for u in batch["source"]])

    table = spark.createDataFrame([(str(a),) for a in addresses], "source string")
    return table.repartition(max(1, min(len(addresses), 64)), "source").mapInPandas(run, ROWS)


def inline(spark: SparkSession, text: str, tag: str = "inline-text") -> DataFrame:
    return spark.createDataFrame([(tag, text)], ROWS)


def collect(spark: SparkSession, pdfs: Sequence[str] = (), texts: Sequence[str] = (), addresses: Sequence[str] = (), target_chars: int = 1200, overlap_chars: int = 150) -> DataFrame:
    """Chunks of all sources: PDFs, then texts, then addresses."""
    parts = [f(spark, x) for f, x in ((pdf_files, pdfs), (text_files, texts), (urls, addresses)) if x]
    if not parts:
        raise ValueError("no source is given")
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.unionByName(part)
    return chunking.chunk_text(docs, "source", target_chars=target_chars, overlap_chars=overlap_chars)


def for_job(spark: SparkSession, params: dict) -> DataFrame:
    """Chunks of a job's text, else its PDF file, else its address."""
    if params.get("text"):
        docs = inline(spark, params["text"])
    elif params.get("pdf_path"):
        docs = pdf_files(spark, [params["pdf_path"]])
    elif params.get("url"):
        docs = urls(spark, [params["url"]])
    else:
        raise ValueError("a job needs text, pdf_path or url")
    return chunking.chunk_text(docs, "source")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks, or lines of them; a missing index is 0."""
    raw = spark.read.schema(CHUNKS).option("multiLine", True).json(path)
    return raw.withColumn("index", F.coalesce("index", F.lit(0)))
