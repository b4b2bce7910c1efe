"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features: length, host length, path depth, labels of the host, shares of digits and of hyphens, entropy of the
characters of the URL and of the host, parameters, whether it is secure, a fragment, a file ending, an
address of digits as the host, and the smoothed rate of bad URLs of the host's name suffix (its last two labels) and of its ending
among the training rows. Features and trees are evaluated in numpy over Arrow batches; URLs are short, so no text is read.

Where no labelled URLs are given, `seeded` labels a table by host words of a short public block list.

Defined cases: bytes that are not UTF-8 are read as U+FFFD (the URL given back is unchanged); a null, empty or malformed URL gets the features of the text it is (an empty one for null) and is
judged by them; repeated rows are judged alike; a null identifier is carried; labelled rows with a null URL or
label are not used; with no labelled rows or one kind only, the score is constant; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import boost
from . import textnp as T

#: Most labelled URLs that the model is fitted to; beyond it, those of the lowest hashes.
TRAIN_ROWS = 50_000
LIMIT = 0.5
BLOCKED = ("casino", "bets", "betting", "poker", "pills", "viagra", "spam", "adult", "porn", "xxx", "ads", "adserver", "malware", "phish")
NAMES = ("length", "host_length", "depth", "labels", "digits", "hyphens", "host_hyphens", "entropy", "host_entropy", "parameters", "secure", "fragment", "ending", "digit_host", "suffix_rate", "top_rate")
PRIOR = 5.0


def seeded(url: str = "url") -> Column:
    """1 where a word of the host is on the block list, else 0."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z]*:?(?://)?([^/?#]*)", 1)
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(x) for x in BLOCKED])).cast("int")


def _entropy(raw: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    counts = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    p = counts / total
    return -(p * np.log2(np.where(counts, p, 1.0))).sum(1)


def _hosts(urls: pd.Series) -> pd.Series:
    return urls.str.lower().str.extract(r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", expand=False).fillna("")


def _suffix(hosts: pd.Series, last: int) -> pd.Series:
    """The host's labels from the last-th on: 2 gives name and ending."""
    return hosts.str.extract(r"((?:[^.]*\.){0,%d}[^.]*)$" % (last - 1), expand=False).fillna("")


@dataclass
class Model:
    base: float
    trees: list[boost.Tree]
    suffixes: dict[str, float]
    tops: dict[str, float]
    prior: float


def features(urls: pd.Series, suffixes: dict[str, float], tops: dict[str, float], prior: float) -> np.ndarray:
    urls = urls.fillna("").astype(str)
    hosts = _hosts(urls)
    n = len(urls)
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    raw, off = T.buffers(pa.array(urls, pa.string()))
    row = np.repeat(np.arange(n), np.diff(off))
    host_raw, host_off = T.buffers(pa.array(hosts, pa.string()))
    host_row = np.repeat(np.arange(n), np.diff(host_off))
    size, host_size = np.maximum(np.diff(off), 1), np.maximum(np.diff(host_off), 1)
    count = lambda data, at, low, high: np.bincount(at[(data >= low) & (data <= high)], minlength=n)
    path = urls.str.replace(r"[?#].*$", "", regex=True).str.replace(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "", regex=True)
    columns = [
        np.diff(off), np.diff(host_off), path.str.count("/"), hosts.str.count(r"\.") + 1, count(raw, row, 48, 57) / size, count(raw, row, 45, 45) / size, count(host_raw, host_row, 45, 45),
        _entropy(raw, row, n), _entropy(host_raw, host_row, n), urls.str.count("[?&][^=&#]*="), urls.str.lower().str.startswith("https:"), urls.str.contains("#", regex=False), path.str.contains(r"\.[a-z]{2,5}$", regex=True),
        count(host_raw, host_row, 48, 57) / host_size, _suffix(hosts, 2).map(suffixes).fillna(prior), _suffix(hosts, 1).map(tops).fillna(prior),
    ]
    for k, column in enumerate(columns):
        out[:, k] = np.asarray(column, float)
    return out


def _rates(keys: pd.Series, y: np.ndarray, prior: float) -> dict[str, float]:
    by = pd.DataFrame({"k": keys.to_numpy(), "y": y}).groupby("k")["y"].agg(["sum", "count"])
    return ((by["sum"] + PRIOR * prior) / (by["count"] + PRIOR)).to_dict()


def train(urls: pd.Series, y: np.ndarray) -> Model:
    """A model of labelled URLs (1 is bad)."""
    if not len(y) or y.min() == y.max():
        return Model(-6.0, [], {}, {}, 0.0)
    prior = float(y.mean())
    hosts = _hosts(urls.astype(str))
    # rates for training come from the other half, so that the trees don't trust them more than new URLs deserve
    half = np.arange(len(y)) % 2 == 0
    x = np.zeros((len(y), len(NAMES)))
    for mine in (half, ~half):
        other = ~mine
        x[mine] = features(urls[mine], _rates(_suffix(hosts[other], 2), y[other], prior), _rates(_suffix(hosts[other], 1), y[other], prior), prior)
    base, trees = boost.fit(x, y.astype(float), trees=60, depth=4, rate=0.25, least=max(3, len(y) // 2000))
    return Model(base, trees, _rates(_suffix(hosts, 2), y, prior), _rates(_suffix(hosts, 1), y, prior), prior)


def fit(labelled: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """From rows (url, label)."""
    got = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label"))
    got = got.orderBy(F.xxhash64("url"), "url").limit(most).select(F.make_valid_utf8("url").alias("url"), "label").toPandas()
    return train(got["url"], got["label"].to_numpy() if len(got) else np.zeros(0))


def _apply(m: Model, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(boost.score(features(T.repaired(batch.column(1)).to_pandas(), m.suffixes, m.tops, m.prior), m.base, m.trees), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(p < limit)], ["page_id", "url", "score", "keep"])

    return run


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """A row (page_id, url, score, keep) for every page."""
    if labelled is None:
        labelled = pages.select("url", seeded().alias("label"))
    schema = ST.StructType([pages.schema["page_id"], pages.schema["url"], *ST._parse_datatype_string("score double, keep boolean").fields])
    return pages.select("page_id", "url").mapInArrow(T.lean(_apply(fit(labelled), limit)), schema)
