"""Reads a SentencePiece model file (protocol buffer wire format) and prepares its tables for batched encoding."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Base of the polynomial substring hashes.
BASE = U(0x9E3779B97F4A7C15 | 1)
SLOT_BITS = 20
NEVER = np.int64(1) << 60


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def read(path: str) -> tuple[list[tuple[str, float, int]], int]:
    """The model's (piece, score, type) by id, and its kind: 1 unigram, 2 BPE."""
    pieces, kind = [], 1
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                got = dict(_fields(value))
                score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
                pieces.append((got.get(1, b"").decode("utf-8"), score, got.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
    return pieces, kind


def merge(text: str, rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Greedy merging of neighbours, lowest rank first and leftmost among equals; and the last merge made."""
    symbols = list(text)
    after = list(range(1, len(symbols))) + [-1]
    before = list(range(-1, len(symbols) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            both = symbols[i] + symbols[after[i]]
            if both in rank:
                heapq.heappush(heap, (rank[both], i, both))

    for i in range(len(symbols)):
        offer(i)
    last = None
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j < 0 or symbols[i] + symbols[j] != both:
            continue
        last = (symbols[i], symbols[j])
        symbols[i], symbols[j] = both, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        offer(before[i])
        offer(i)
    return [x for x in symbols if x], last


@dataclass
class Tables:
    """Tokens are numbered 0..n-1: the normal pieces, by ascending hash."""

    hashes: np.ndarray
    length: np.ndarray
    piece_id: np.ndarray
    rank: np.ndarray
    score: np.ndarray
    left: np.ndarray
    right: np.ndarray
    alive: np.ndarray
    prefixes: np.ndarray
    prefix_piece: np.ndarray
    slots: np.ndarray
    spill: np.ndarray
    shift: int
    powers: np.ndarray
    byte_id: np.ndarray
    unknown: int
    bpe: bool
    ranks: dict[str, float]
    ids: dict[str, int]
    bytes: list[bytes]


def text_hash(points: np.ndarray) -> np.ndarray:
    """Values whose running polynomial gives substring hashes: prefix[k+1] = prefix[k] * BASE + value."""
    h = (points.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h | U(1)


def _hash(piece: str) -> int:
    h = 0
    for v in text_hash(np.array([ord(c) for c in piece], np.int64)):
        h = (h * int(BASE) + int(v)) & (2**64 - 1)
    return h


def tables(path: str) -> Tables:
    pieces, kind = read(path)
    bpe = kind == 2
    normal = [(i, p, s) for i, (p, s, t) in enumerate(pieces) if t in (NORMAL, USER)]
    ranks = {p: -s for _, p, s in normal}
    spaces = {p for p in ranks if len(p) > 1 and not p.strip(SPACE)}
    of = sorted((_hash(p), i, p, s) for i, p, s in normal)
    number = {p: k for k, (_, _, p, _) in enumerate(of)}
    left, right, alive = (np.full(len(of), -1, np.int32) for _ in range(3))
    for k, (_, _, p, _) in enumerate(of):
        if len(p) == 1:
            alive[k] = 1
        elif p in spaces:
            alive[k] = 0
        elif not bpe:
            alive[k] = 1
        else:
            got, last = merge(p, ranks)
            alive[k] = got == [p]
            if alive[k]:
                left[k], right[k] = number[last[0]], number[last[1]]
    hashes = np.array([h for h, *_ in of], U)
    length = np.array([len(p) for _, _, p, _ in of], np.int64)
    starts = {}
    for _, _, p, _ in of:
        h = 0
        for v in text_hash(np.array([ord(c) for c in p], np.int64)).tolist():
            h = (h * int(BASE) + v) & (2**64 - 1)
            starts.setdefault(h, -1)
        starts[h] = number[p]
    prefixes = np.array(sorted(starts), U)
    prefix_piece = np.array([starts[h] for h in prefixes.tolist()], np.int32)
    # a direct table of the prefixes; those whose slot is taken are in a second one, by other bits
    slots, spill = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(2 << SLOT_BITS, np.int32)
    first = (prefixes >> U(64 - SLOT_BITS)).astype(np.int64)
    slots[first[::-1]] = np.arange(len(prefixes))[::-1]
    rest = np.flatnonzero(slots[first] != np.arange(len(prefixes)))
    for shift in range(0, 64 - SLOT_BITS):
        second = (prefixes[rest] >> U(shift) & U((2 << SLOT_BITS) - 1)).astype(np.int64)
        if len(np.unique(second)) == len(rest):
            break
    else:
        raise ValueError("the model's pieces don't fit the table")
    spill[second] = rest
    powers = np.array([pow(int(BASE), k, 2**64) for k in range(int(length.max()) + 2)], U)
    byte_id = np.full(256, next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0), np.int32)
    raw = [b"" if t in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode() for p, _, t in pieces]
    for i, (p, _, t) in enumerate(pieces):
        if t == BYTE:
            byte_id[int(p[3:5], 16)] = i
            raw[i] = bytes([int(p[3:5], 16)])
    rank = np.array([ranks[p] if len(p) > 1 else -1 for _, _, p, _ in of])
    order = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    order[length == 1] = -1
    return Tables(hashes, length, np.array([i for _, i, _, _ in of], np.int32), order, np.array([s for *_, s in of]), left, right, alive == 1, prefixes, prefix_piece, slots, spill, shift, powers, byte_id, int(byte_id[0]) if byte_id[0] == byte_id[1] else -1, bpe, ranks, {p: i for i, p, _ in normal}, raw)
