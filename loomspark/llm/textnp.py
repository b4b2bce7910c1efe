"""Vectorised word and n-gram hashing over Arrow text batches.

A word is a longest run of bytes that are neither ASCII white space, punctuation nor control
characters; callers lower-case the text in Spark first. Every text is read whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_SLOTS = 4096
_R = _RNG.integers(1, 2**63, _SLOTS, dtype=np.uint64) * U(2) + U(1)
_C = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_WORD = np.zeros(256, dtype=bool)
_WORD[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
#: The same word rule for regular expressions of Java and RE2.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CHUNK_BYTES = 2 << 20


def trim() -> None:
    """Gives freed memory back to the system, where the C library can; idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(work):
    """work over Arrow batches, with memory given back after each batch that it yields and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield batch
            del batch
            trim()
        trim()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as an empty text."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def repaired(col: pa.Array) -> pa.Array:
    """The column, with U+FFFD for bytes that are not UTF-8, which a string of Spark can hold."""
    raw, off = buffers(col)
    try:
        str(raw, "utf-8")
        # a range may be whole though its rows are not: no row begins within a character
        if not (raw[off[:-1][off[:-1] < len(raw)]] & 0xC0 == 0x80).any():
            return col
    except UnicodeDecodeError:
        pass
    whole = raw.tobytes()
    null = col.is_null().to_numpy(zero_copy_only=False)
    return pa.array([None if gone else whole[a:b].decode("utf-8", "replace") for gone, a, b in zip(null, off, off[1:])], pa.large_string())


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about `most` bytes of text; one longer text is a range of its own."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < n:
        end = min(at + 65536, max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (within the row) of every word, and each row's first word index."""
    raw, off = buffers(col)
    n = len(off) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = off[:-1][off[:-1] < len(raw)]
    begins[firsts] = inside[firsts]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside)
    word = np.searchsorted(at, start)  # where each word begins among the word bytes
    size = np.diff(np.append(word, len(at)))
    place = np.arange(len(at)) - np.repeat(word, size)
    weight = _R[place & (_SLOTS - 1)]
    if size.max() > _SLOTS:
        weight = weight * (U(2) * (place // _SLOTS).astype(U) + U(1))
    h = mix(np.add.reduceat((raw[at].astype(U) + U(1)) * weight, word) + size.astype(U))
    row = np.searchsorted(start, off)  # words before each row boundary
    base = np.repeat(off[:-1], np.diff(row))
    return h, start - base, start + size - base, row


def grams(h: np.ndarray, row: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of n words, the run's row and its first word; short: a row of fewer words is one run."""
    count = np.diff(row)
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = len(h)
    g = np.zeros(total, U)
    for k in range(n):
        if total > k:
            g[: total - k] += h[k:] * _C[k]
    owner = np.repeat(np.arange(len(count)), count)
    whole = np.arange(total) + n <= row[1:][owner]
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        for r in few:
            words_ = h[row[r] : row[r + 1]]
            g[row[r]] = (words_ * _C[: len(words_)]).sum(dtype=U) + U(len(words_))
        whole[row[:-1][few]] = True
    at = np.flatnonzero(whole)
    return mix(g[at]), owner[at], at


def gram_sets(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of n-grams as ascending 48-bit hashes, with row offsets; at most 65,536 rows."""
    g, owner, _ = grams(h, row, n, short=True)
    key = np.sort((owner.astype(U) << U(48)) | (g >> U(16)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key & U((1 << 48) - 1), np.searchsorted(key >> U(48), np.arange(len(row), dtype=U))
