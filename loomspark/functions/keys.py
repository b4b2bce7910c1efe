"""Keys, signatures, codes and buckets."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

LANGUAGES = dict(pair.split("=") for pair in "chinese=zh dutch=nl english=en french=fr german=de italian=it japanese=ja portuguese=pt spanish=es".split())
BUCKETS = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"))


def cache_key(model: Column, temperature: Column, max_tokens: Column, system: Column, prompt: Column) -> Column:
    """sha256 of a request; a null system prompt counts as an empty one."""
    return F.sha2(F.concat_ws("|", model, F.format_string("%.4f", temperature.cast("double")), max_tokens.cast("int").cast("string"), F.coalesce(system, F.lit("")), prompt), 256)


def pair_key(instruction: Column, output: Column) -> Column:
    return F.sha1(F.concat(F.lower(strip(instruction)), F.lit("|"), F.lower(strip(output))).cast("binary"))


def language_code(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(name))), F.lit("en"))


def size_bucket(n: Column) -> Column:
    out = F.lit("n>1M")
    for limit, name in reversed(BUCKETS):
        out = F.when(n < limit, name).otherwise(out)
    return out


def lot(seed: int, key: Column) -> Column:
    """A hash to order by: a seeded shuffle that no partitioning changes."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def ids_hash(ids: DataFrame, column: str, at_once: int = 100_000) -> str:
    """sha1 over the sorted identifiers, each with a | behind it; the same for any order of the rows.

    Up to at_once identifiers are hashed in one row; more come to the digest in order, a range at a time.
    """
    ids = ids.select(column).where(F.col(column).isNotNull())
    if ids.count() <= at_once:
        row = ids.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: F.concat(x, F.lit("|"))), "").cast("binary"))).first()
        return row[0]
    digest = hashlib.sha1()
    for row in ids.repartitionByRange(column).sortWithinPartitions(column).toLocalIterator():
        digest.update(f"{row[0]}|".encode())
    return digest.hexdigest()


def signature(config: dict, chunk_count: int, chunk_ids_hash: str) -> str:
    """Identifies a run by what decides its result; physical knobs and paths must not be in config."""
    return hashlib.sha1(json.dumps({"config": config, "chunk_count": chunk_count, "chunk_ids_hash": chunk_ids_hash}, sort_keys=True).encode()).hexdigest()


def slug(name: str) -> str:
    bare = re.sub(r"[\W_]", "-", name.lower()).strip("-")
    return bare[:48] if bare else "run"
