"""N-gram Jaccard self-join by parity sketches.

Each text becomes the set of its word n-grams (a text of fewer than n words is one gram). A set is
hashed into a bit sketch: every gram flips one bit (of 2^32 a chunk, of which only those set are held, as the XOR
of their hashes, so that chance agreement stays rare at any size), so the Hamming distance of two sketches is at
most the size of the symmetric difference. Jaccard >= t bounds that difference by
D = (1-t)/(1+t) * (|A|+|B|); a sketch is divided into K > D chunks, so sketches within D agree in at
least K-D chunks. Sets are banded by size, K follows from the largest D of a band, and chunks are
joined by equality. A chunk without set bits says nothing, so it is not joined on: where a set has
more than D chunks with bits, some agreeing chunk has bits. The rare sets with fewer (their grams
fell into few chunks) are also joined among themselves on single grams. If a set must agree with its
partner in m chunks, its m - 1 most frequent ones (of all sets, ties by hash) need not be joined on:
two sets that agree in m have a common one among the others. So passages that many documents share
make no candidates.

Up to t = 0.5 two sets may differ in as many grams as the smaller one has, so that agreeing chunks can't be
promised, and the sketch is refined until every chunk has one bit: sets are joined on single grams. A set of s grams shares
at least a = ceil(t*s) with any partner. So the first s - a + m of both sets by hash hold at least m common ones, of which
the m - 1 most frequent need not be joined on; m is 1 + a // 2, which grows no faster than a, so it holds for
sets of different sizes too. Grams that a hundredth of the sets have are known before the others are counted, and are left
out first, so that no task ever gathers them. All this is exact, up to 64-bit hash collisions of sets and 48-bit ones of grams.

Keys travel packed, a binary of many sets' keys for each bucket of the key space: 11 bytes a key instead of a row. The sets of a key
are a list; sets that lists connect are a tile, to which their grams and lists go once. The tile pairs its
sets by a product of the lists' incidence matrix, so a pair is found once however many keys it shares, and verifies the pairs on the grams.
Neither candidates nor pairs are shuffled: a tile gives each set's number of links and a spanning forest of
them. A tile of much work is split into blocks of sets that meet two at a time; a large group that few lists hold together
is split by the lists' least members instead, and as two sets may then meet in several tiles, its similar pairs are given and made distinct.

Identical sets are joined once, as a class, so a text with thousands of copies costs no more pairs
than any other; a class is never gathered anywhere.

Defined cases: a null text, and a text without words, has no partner and no class; a null doc_id takes part in nothing, and
its row has nulls and 0; repeated rows (same doc_id and text) count as copies, each with a row;
an empty table gives no rows; only the identifier and text columns are read, so other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows
from . import textnp as T

#: A replaced word takes five 5-grams along: copies with 5 to 10 % of their words edited are at 0.4 to 0.65, other documents below.
N, THRESHOLD, BAND = 5, 0.4, 1.5
#: Grams that 1 of HOT_SHARE sets has, and HOT_LEAST sets at least, are left out first; at most HOT_MOST, the most frequent.
HOT_SHARE, HOT_LEAST, HOT_MOST = 100, 1000, 200_000
#: Keys that are packed together; a tile's most bytes of grams, sets, and grams times sets, about.
GATHER, TILE_BYTES, TILE_SETS, TILE_WORK = 1_500_000, 32 << 20, 20_000, 300_000_000
#: Pairs of which one task finds the connected groups (16 MB).
ONE_TASK = 1_000_000
KEY_BITS, SID_BITS = 48, 40
U = np.uint64
KEYED = "bucket int, n int, data binary"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_ids(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set, 0 for an empty one."""
    out = []
    for salt in (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)):
        total = np.append(U(0), np.cumsum(T.mix(g ^ salt)))
        out.append(T.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(U)))
    return out[0], out[1]


def distance_bound(size: float, t: float) -> int:
    """Most grams in which a set of `size` and any set not larger can differ."""
    return math.floor((1 - t) / (1 + t) * 2 * size + 1e-9)


def band_of(t: float) -> float:
    """Ratio of a band's sizes: a set's partners are in its own band and the next ones only."""
    return max(BAND, 1 / t)


def chunks_of(scheme: int, t: float) -> int:
    """K of a band's scheme: more than D, with room for chunks without bits."""
    return math.floor(1.15 * distance_bound(band_of(t) ** (scheme + 1), t)) + 3


# keys in packed form


class Packing:
    """Records of numbers of some bytes each, packed by buckets: the top bits of their first number."""

    def __init__(self, tasks: int, first_bits: int, *widths: int):
        self.tasks = tasks
        self.bits = max(8, math.ceil(math.log2(4 * tasks)))
        self.shift = U(first_bits - self.bits)
        self.widths = (-(-(first_bits - self.bits) // 8), *widths)

    def rows_of(self, columns: list[np.ndarray], by: np.ndarray) -> pa.RecordBatch:
        """One row for each bucket; in a bucket, records are in the order of `by`, a byte."""
        bucket = (columns[0] >> self.shift).astype(np.int64)
        order = np.argsort(bucket << 8 | by, kind="stable")
        bucket = bucket[order]
        planes = [(columns[0] & U((1 << int(self.shift)) - 1)), *columns[1:]]
        planes = [np.ascontiguousarray(x.astype("<u8")[order].view(np.uint8).reshape(-1, 8)[:, :w]) for x, w in zip(planes, self.widths)]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(bucket)) if len(bucket) else first
        data = [b"".join(x[a:b].tobytes() for x in planes) for a, b in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array((ends - first).astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "n", "data"])

    def gather(self, made: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Packs (columns, by) as they come, about GATHER records at a time."""
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        count = 0

        def packed() -> pa.RecordBatch:
            return self.rows_of([np.concatenate(x) for x in zip(*(c for c, _ in held))], np.concatenate([b for _, b in held]))

        for columns, by in made:
            if not len(by):
                continue
            held.append((columns, by))
            count += len(by)
            if count >= GATHER:
                yield packed()
                held, count = [], 0
        if held:
            yield packed()

    def buckets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """The records of each bucket; rows come sorted by bucket."""
        now, held = -1, []

        def unpacked() -> list[np.ndarray]:
            out = []
            for k, w in enumerate(self.widths):
                before = sum(self.widths[:k])
                x = np.zeros((sum(n for n, _ in held), 8), np.uint8)
                x[:, :w] = np.concatenate([np.frombuffer(data, np.uint8, n * w, n * before) for n, data in held]).reshape(-1, w)
                out.append(x.view("<u8")[:, 0])
            out[0] |= U(now) << self.shift
            return out

        for batch in batches:
            for bucket, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now and held:
                    yield unpacked()
                    held = []
                now = bucket
                held.append((n, data))
        if held:
            yield unpacked()

    def spread(self, df: DataFrame) -> DataFrame:
        """Packed rows where their buckets belong, sorted by bucket."""
        return df.repartitionById(self.tasks, F.pmod("bucket", F.lit(self.tasks))).sortWithinPartitions("bucket")


def _level(x: np.ndarray, per: int) -> np.ndarray:
    """A byte for numbers from 1 on, ascending with them, `per` to an octave."""
    return np.minimum(np.floor(per * np.log2(np.maximum(x, 1)) + 1e-9), 255).astype(np.int64)


#: How many keys a list may leave out, in six bits: rounded down.
_SPARE = np.unique(np.concatenate([[0], np.floor(2 ** (np.arange(62) / 2.5))]).astype(np.int64))[:64]


def _classes(n: int):
    """(doc_id, k, sid, sid2, size) of each row; and, with size -1, (gram as sid, sets that have it as sid2) where a range of rows has it often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 1):
                h, _, _, row = T.words(part.column(1))
                g, off = T.gram_sets(h, row, n)
                a, b = _set_ids(g, off)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _signed(a), _signed(b), pa.array(np.diff(off).astype(np.int32))], ["doc_id", "k", "sid", "sid2", "size"])
                g = np.sort(g)
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(g)))
                often = count >= max(8, part.num_rows // (2 * HOT_SHARE))
                if often.any():
                    none = pa.nulls(int(often.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, _signed(g[first[often]]), pa.array(count[often]), pa.array(np.full(int(often.sum()), -1, np.int32))], ["doc_id", "k", "sid", "sid2", "size"])

    return run


def _keys(n: int, t: float, packing: Packing, hot: np.ndarray):
    """Packed (key, sid, tag), ordered by size; a tag is the kind of the list that the key is in, and how many keys it may leave out."""
    ratio = band_of(t)
    sid_shift = U(64 - SID_BITS)

    def columns(key: np.ndarray, sid: np.ndarray, size: np.ndarray, spare: np.ndarray, kind: np.ndarray | int) -> tuple[list[np.ndarray], np.ndarray]:
        level = _level(size, 12)  # lists of like sizes have like tags, which then compress
        tag = (np.searchsorted(_SPARE, spare, side="right") - 1) << 2 | kind
        return [key, sid >> sid_shift, tag.astype(U)], level

    def grams_of(mine: np.ndarray) -> np.ndarray:
        return (mine * U(0x9E3779B97F4A7C15)) & U((1 << KEY_BITS) - 1)  # one to one, and evenly spread

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for batch in batches:
            for part in T.slices(batch, 0):
                h, _, _, row = T.words(part.column(0))
                g, off = T.gram_sets(h, row, n)
                sid, _ = _set_ids(g, off)
                size = np.diff(off)
                if t <= 0.5:
                    least = np.ceil(t * size - 1e-9).astype(np.int64)
                    owner = np.repeat(np.arange(len(size)), size)
                    pick = np.arange(len(g)) - off[owner] < (size - least + least // 2 + 1)[owner]
                    g, owner = g[pick], owner[pick]
                    spare = least // 2
                    key = grams_of(g)
                    if len(hot) and len(g):
                        is_hot = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
                        at = np.flatnonzero(is_hot)
                        at = at[np.lexsort((key[at], owner[at]))[::-1]]  # the largest keys of each set first
                        count = np.bincount(owner[at], minlength=len(size))
                        begin = np.append(0, np.cumsum(count[::-1]))[:-1][::-1]
                        lost = at[np.arange(len(at)) - begin[owner[at]] < spare[owner[at]]]
                        spare = spare - np.bincount(owner[lost], minlength=len(size))
                        keep = np.ones(len(g), bool)
                        keep[lost] = False
                        key, owner = key[keep], owner[keep]
                    yield columns(key, sid[owner], size[owner], spare[owner], 2)
                    continue
                band = np.full(len(size), -1)
                some = size > 0
                band[some] = np.floor(np.log(size[some]) / math.log(ratio) + 1e-9)
                for up in (0, 1):  # a set meets larger ones in the scheme of the next band
                    top = np.floor(ratio ** (band + 1.0) + 1e-9)
                    use = some if not up else some & (np.floor(size / t + 1e-9) > top)
                    r = np.flatnonzero(use)
                    if not len(r):
                        continue
                    lens = size[r]
                    owner = np.repeat(np.arange(len(r)), lens)
                    at = np.repeat(off[r], lens) + np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
                    mine = g[at]
                    scheme = band[r] + up
                    k = np.array([chunks_of(int(s), t) for s in scheme], dtype=np.int64)
                    chunk = (((mine >> U(16)) * k.astype(U)[owner]) >> U(32)).astype(np.int64)  # ascends with the grams
                    fresh = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (owner[1:] != owner[:-1])))
                    parity = np.bitwise_xor.reduceat(T.mix((T.mix(mine) & U(0xFFFFFFFF)) + U(1)), fresh)  # equal bits cancel
                    o, c = owner[fresh], chunk[fresh]
                    bits = parity != 0
                    o, c, parity = o[bits], c[bits], parity[bits]
                    key = T.mix(parity ^ T.mix(scheme.astype(U)[o] * U(1 << 40) + c.astype(U))) >> U(64 - KEY_BITS)
                    bound = np.minimum(np.floor((1 - t) / t * lens + 1e-9), np.floor((1 - t) / (1 + t) * 2 * ratio ** (scheme + 1.0) + 1e-9)).astype(np.int64)
                    have = np.bincount(o, minlength=len(r))
                    yield columns(key, sid[r][o], lens[o], np.maximum(have - bound - 1, 0)[o], up)
                    # sets with too few chunks with bits for the pigeonhole
                    poor = have <= bound
                    if poor.any():
                        pick = poor[owner]
                        spare = np.maximum(np.ceil(t * lens - 1e-9).astype(np.int64) - 1, 0)
                        yield columns(grams_of(mine[pick]), sid[r][owner[pick]], lens[owner[pick]], spare[owner[pick]], 2 + up)

    return lambda batches: packing.gather(made(batches))


def _shared(by_key: Packing, by_sid: Packing):
    """Packed (sid, key, level of its frequency, tag) of the keys that more than one set has."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for key, sid, tag in by_key.buckets(batches):
            order = np.argsort(key)
            sorted_ = key[order]
            edge = np.append(True, sorted_[1:] != sorted_[:-1])
            lone = edge & np.append(edge[1:], True)
            at = order[~lone]
            at = at[np.lexsort((tag[at], sid[at], key[at]))]
            key, sid, tag = key[at], sid[at], tag[at]
            if not len(key):
                continue
            new = np.append(True, key[1:] != key[:-1])
            fresh = new | np.append(True, sid[1:] != sid[:-1])
            run = np.cumsum(new) - 1
            freq = np.bincount(run, weights=fresh)[run]
            once = (fresh | np.append(True, tag[1:] != tag[:-1])) & (freq > 1)
            yield [sid[once], key[once], _level(freq[once], 8).astype(U), tag[once]], tag[once].astype(np.int64)

    return lambda batches: by_sid.gather(made(batches))


def _rarest(by_sid: Packing, by_key: Packing):
    """Packed (key, sid) without each list's most frequent keys, as many as its tag allows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for sid, key, freq, tag in by_sid.buckets(batches):
            at = np.lexsort((key, freq, tag, sid))[::-1]
            sid, key, tag = sid[at], key[at], tag[at]
            first = np.flatnonzero(np.append(True, (sid[1:] != sid[:-1]) | (tag[1:] != tag[:-1])))
            place = np.arange(len(sid)) - np.repeat(first, np.diff(np.append(first, len(sid))))
            keep = place >= _SPARE[(tag >> U(2)).astype(np.int64)]
            yield [key[keep], sid[keep]], np.zeros(int(keep.sum()), np.int64)

    return lambda batches: by_key.gather(made(batches))


def _lists(by_key: Packing):
    """(leader, members): the sets that share a key (8 bytes each), and the least of them; each list once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple[int, bytes]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["leader", "members"])

        for key, sid in by_key.buckets(batches):
            order = np.lexsort((sid, key))
            key, sid = key[order], sid[order]
            once = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
            key, sid = key[once], sid[once]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(first, len(key)))
            total = np.append(U(0), np.cumsum(T.mix(sid + U(1))))
            content = T.mix(total[first + length] - total[first] + length.astype(U))
            many = np.flatnonzero(length > 1)
            _, at = np.unique(content[many], return_index=True)
            for f, n, c in zip(first[many[at]].tolist(), length[many[at]].tolist(), content[many[at]].tolist()):
                if c in seen:
                    continue
                if len(seen) < 1_000_000:  # for less to send; a list that comes again does no harm
                    seen.add(c)
                out.append((int(sid[f]), sid[f : f + n].tobytes()))
                held += 8 * n
                if held > 4 << 20:
                    yield packed()
                    out, held = [], 0
        if out:
            yield packed()

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ca, cb): the first member of each list with every other one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(1).cast(pa.large_binary())
        raw, off = T.buffers(size)
        flat, n = np.frombuffer(raw.tobytes(), np.int64), np.diff(off) // 8
        lead = np.repeat(batch.column(0).to_numpy(), n)
        edge = np.unique(np.stack([lead, flat], 1)[lead != flat], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["ca", "cb"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (l, members) as rows (l, sid)."""
    for batch in (part for whole in batches for part in T.slices(whole, 1)):
        raw, off = T.buffers(batch.column(1).cast(pa.large_binary()))
        each = np.unique(np.stack([np.repeat(batch.column(0).to_numpy(), np.diff(off) // 8), np.frombuffer(raw.tobytes(), np.int64)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1])], ["l", "sid"])


def _tile(l: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return T.mix(l.astype(np.int64).view(U) ^ T.mix(np.minimum(i, j).astype(U) * U(1 << 32) + np.maximum(i, j).astype(U))).view(np.int64)


def _block(sid: np.ndarray, parts: int) -> np.ndarray:
    return (T.mix(sid.astype(np.int64).view(U)) % U(parts)).astype(np.int64)


#: Mark of tiles whose sets may meet in others.
SHARED = 1 << 30
TILED = "tile bigint, kind tinyint, a bigint, b bigint, data binary"


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (l, parts, members) as rows (tile, kind 1, block, block << 32 | parts, members): to every tile that pairs two of their blocks; parts is negative where sets may meet in other tiles too."""

    def rows_of(tile: np.ndarray, x: np.ndarray, y: np.ndarray, members: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(np.ones(len(tile), np.int8)), pa.array(x), pa.array(y), members], ["tile", "kind", "a", "b", "data"])

    for batch in (part for whole in batches for part in T.slices(whole, 2)):
        shared = np.where(batch.column(1).to_numpy() < 0, SHARED, 0)
        one = np.abs(batch.column(1).to_numpy()) == 1
        zero = np.zeros(int(one.sum()), np.int64)
        yield rows_of(_tile(batch.column(0).to_numpy()[one], zero, zero), zero, shared[one], batch.column(2).filter(pa.array(one)).cast(pa.binary()))
        if one.all():
            continue
        rest = batch.filter(pa.array(~one))
        l, parts = rest.column(0).to_numpy(), np.abs(rest.column(1).to_numpy()).astype(np.int64)
        shared = shared[~one]
        raw, off = T.buffers(rest.column(2).cast(pa.large_binary()))
        sid, n = np.frombuffer(raw.tobytes(), np.int64), np.diff(off) // 8
        owner = np.repeat(np.arange(len(l)), n)
        block = (T.mix(sid.view(U)) % parts.astype(U)[owner]).astype(np.int64)
        order = np.lexsort((block, owner))
        sid, owner, block = sid[order], owner[order], block[order]
        seg = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))
        size = np.diff(np.append(seg, len(sid)))
        # each segment of a list with itself and those after it
        last = np.searchsorted(owner[seg], owner[seg], side="right")
        count = last - np.arange(len(seg))
        for a in range(0, len(seg), 20_000):
            x = np.repeat(np.arange(a, min(a + 20_000, len(seg))), count[a : a + 20_000])
            y = x + np.arange(len(x)) - np.repeat(np.cumsum(count[a : a + 20_000]) - count[a : a + 20_000], count[a : a + 20_000])
            second = np.where(x == y, 0, size[y])
            use = size[x] + second > 1
            x, y, second = x[use], y[use], second[use]
            starts, lengths = np.stack([seg[x], seg[y]], 1).ravel(), np.stack([size[x], second], 1).ravel()
            ends = np.cumsum(lengths)
            flat = sid[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
            cuts = np.append(0, np.cumsum(8 * (size[x] + second))).astype(np.int64)
            members = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            i, j = block[seg[x]], block[seg[y]]
            yield rows_of(_tile(l[owner[seg[x]]], i, j), i, j << 32 | parts[owner[seg[x]]] | shared[owner[seg[x]]], members)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (l, parts, sid) as rows (tile, sid): to every tile that has their block."""
    for batch in batches:
        l, parts, sid = (batch.column(i).to_numpy() for i in range(3))
        parts = np.abs(parts)
        of = np.repeat(np.arange(len(l)), parts)
        other = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        own = np.concatenate([_block(sid[k : k + 1], int(parts[k])) for k in np.flatnonzero(parts > 1)]) if (parts > 1).any() else np.zeros(0, np.int64)
        block = np.zeros(len(l), np.int64)
        block[parts > 1] = own
        yield pa.RecordBatch.from_arrays([pa.array(_tile(l[of], block[of], other)), pa.array(sid[of])], ["tile", "sid"])


def _sets(n: int):
    """The sets of texts (tile, c, sid, text): rows (tile, kind 0, c, sid, grams of 6 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 3):
                h, _, _, row = T.words(part.column(3))
                g, off = T.gram_sets(h, row, n)
                raw = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                blobs = [raw[6 * a : 6 * b] for a, b in zip(off, off[1:])]
                kind = pa.array(np.zeros(part.num_rows, np.int8))
                yield pa.RecordBatch.from_arrays([part.column(0), kind, part.column(1), part.column(2), pa.array(blobs, pa.binary())], ["tile", "kind", "a", "b", "data"])

    return run


def _commons(e: np.ndarray, grams: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many grams the sets x and y of each pair have in common; e: number of the set << 48 | gram, ascending."""
    out = np.zeros(len(x), np.int64)
    size = np.diff(off)
    ends = np.cumsum(size[y])
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
        n = size[y[at:to]]
        owner = np.repeat(np.arange(to - at), n)
        place = np.repeat(off[y[at:to]] - (np.cumsum(n) - n), n) + np.arange(len(owner))
        probe = x[at:to].astype(U)[owner] << U(48) | grams[place]
        there = e[np.minimum(np.searchsorted(e, probe), len(e) - 1)] == probe
        out[at:to] = np.bincount(owner[there], minlength=to - at)
        at = to
    return out


def _meeting(lists: list[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs x < y of numbers below n that are in one of the lists together, each once; ascending rows a time."""
    lists = [x for x in lists if len(x) > 1]
    if not lists:
        return
    member, index = np.unique(np.concatenate(lists), return_inverse=True)
    m = len(member)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    width = max(1, 4_000_000 // m)
    step = max(1, 4_000_000 // m)
    for i in range(0, m, step):
        near = np.zeros((min(step, m - i), m), bool)
        for k in range(0, len(lists), width):
            here = (row >= k) & (row < k + width)
            has = np.zeros((m, min(width, len(lists) - k)), np.float32)
            has[index[here], row[here] - k] = 1
            near |= (has[i : i + step] @ has.T) > 0
        x, y = np.nonzero(near)
        x += i
        yield member[x[x < y]], member[y[x < y]]


def _products(grams: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_commons for many pairs of few sets, by products of the incidence matrix of the grams that more than one set has."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    order = np.argsort(grams, kind="stable")
    g, owner = grams[order], owner[order]
    new = np.append(True, g[1:] != g[:-1])
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1
    number, owner = np.cumsum(new[many]) - 1, owner[many]
    out = np.zeros((n, n), np.float32)
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(number, [k, k + 2048])
        has = np.zeros((n, min(2048, int(number[-1]) + 1 - k)), np.float32)
        has[owner[a:b], number[a:b] - k] = 1
        out += has @ has.T
    return out[x, y].astype(np.int64)


def _verified(t: float, every: bool):
    """The similar pairs of each tile, as rows (kind, ca, cb, n): a set and its links (kind 0), and pairs of a spanning forest (kind 1); pairs and their common grams (kind 2) where sets may meet in other tiles, or if every.

    Rows come sorted by tile and kind: a tile's sets (kind 0: c, sid, grams), then its lists (kind 1: two blocks and their number, sids).
    """

    def verdict(x: np.ndarray, y: np.ndarray, blobs: list[bytes], size: np.ndarray) -> np.ndarray:
        """The common grams of the pairs, 0 where too few."""
        common = np.zeros(len(x), np.int64)
        live = np.flatnonzero(np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - 1e-9)
        for at in range(0, len(live), 2_000_000):
            part = live[at : at + 2_000_000]
            some = np.unique(np.concatenate([x[part], y[part]]))
            dense = len(some) <= 4000 and len(part) > max(200, len(some) ** 2 // 16)
            for k in range(0, len(part), len(part) if dense else 30_000):  # of so few pairs the sets can be numbered in 16 bits
                mine = part if dense else part[k : k + 30_000]
                a, b = x[mine], y[mine]
                a, b = np.where(size[a] < size[b], b, a), np.where(size[a] < size[b], a, b)
                some, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
                off = np.append(0, np.cumsum(size[some]))
                grams = np.zeros((int(off[-1]), 8), np.uint8)
                grams[:, :6] = np.frombuffer(b"".join(blobs[i] for i in some), np.uint8).reshape(-1, 6)
                grams = grams.view("<u8")[:, 0]
                if dense:
                    common[mine] = _products(grams, off, *np.split(inverse, 2))
                else:
                    common[mine] = _commons(np.repeat(np.arange(len(some), dtype=U) << U(48), size[some]) | grams, grams, off, *np.split(inverse, 2))
        return np.where(common >= t * (size[x] + size[y] - common) - 1e-9, common, 0)

    def judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        tile, kind, a, b = (table[x].to_numpy() for x in ("tile", "kind", "a", "b"))
        data = table["data"].to_pylist()
        is_set = np.flatnonzero(kind == 0)
        order = is_set[np.lexsort((a[is_set], b[is_set], tile[is_set]))]
        order = order[np.append(True, (a[order][1:] != a[order][:-1]) | (tile[order][1:] != tile[order][:-1]))[: len(order)]]  # a repeated row's set comes again
        c, sid, at = a[order], b[order], tile[order]
        blobs = [data[i] for i in order]
        size = np.array([len(x) // 6 for x in blobs], np.int64)
        links = np.zeros(len(c), np.int64)
        root = np.arange(len(c))
        forest: list[tuple[int, int]] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def take(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> None:
            common = verdict(x, y, blobs, size)
            ok = common > 0
            x, y, shared = x[ok], y[ok], shared[ok] | every
            found.append((c[x[shared]], c[y[shared]], common[ok][shared]))
            np.add.at(links, x[~shared], 1)
            np.add.at(links, y[~shared], 1)
            for joined in _roots(x, y, root):
                forest.extend(zip(x[joined].tolist(), y[joined].tolist()))

        lists = np.flatnonzero(kind == 1)
        lists = lists[np.argsort(tile[lists], kind="stable")]
        edge = np.flatnonzero(np.append(True, tile[lists][1:] != tile[lists][:-1])) if len(lists) else lists
        low, high = np.searchsorted(at, tile[lists[edge]]), np.searchsorted(at, tile[lists[edge]], side="right")
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for e, begin in enumerate(edge):
            mine = lists[begin : edge[e + 1] if e + 1 < len(edge) else len(lists)]
            ids = sid[low[e] : high[e]]
            x0, y0, n_parts = int(a[mine[0]]), int(b[mine[0]]) >> 32, int(b[mine[0]]) & SHARED - 1
            members = []
            for raw in {data[i] for i in mine}:
                m = np.frombuffer(raw, np.int64)
                lo, hi = np.searchsorted(ids, m), np.searchsorted(ids, m, side="right")  # more than one set where sids collide
                members.append(np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum())))
            if len(members) == 1 and len(members[0]) == 2:
                meeting = [(members[0][:1], members[0][1:])]
            else:
                meeting = _meeting(members, len(ids))
            for x, y in meeting:
                if n_parts:
                    bx, by = _block(ids[x], n_parts), _block(ids[y], n_parts)
                    ok = (np.minimum(bx, by) == x0) & (np.maximum(bx, by) == y0)
                    x, y = x[ok], y[ok]
                pairs.append((x + low[e], y + low[e], np.full(len(x), bool(int(b[mine[0]]) & SHARED))))
                held += len(x)
                if held > 1_000_000:
                    take(*(np.concatenate(z) for z in zip(*pairs)))
                    pairs, held = [], 0
        if pairs:
            take(*(np.concatenate(z) for z in zip(*pairs)))
        some = np.flatnonzero(links)
        yield answer(0, c[some], None, links[some])
        if forest:
            x, y = (np.array(z) for z in zip(*forest))
            yield answer(1, c[x], c[y], None)
        for x, y, common in found:
            yield answer(2, np.minimum(x, y), np.maximum(x, y), common)

    def answer(kind: int, x: np.ndarray, y: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x), none if y is None else pa.array(y), none if n is None else pa.array(n)], ["kind", "ca", "cb", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if weight > 8 << 20:
                tile = batch.column(0).to_numpy()
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                cut = int(np.argmax(tile != last)) if (tile != last).any() else batch.num_rows
                if cut < batch.num_rows:
                    held.append(batch.slice(0, cut))
                    yield from judged(held)
                    held, weight, batch = [], 0, batch.slice(cut)
            held.append(batch)
            weight += batch.nbytes
        if held:
            yield from judged(held)

    return run


def members(docs: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """A row (doc_id, k, c, size) for every row of docs, c being the class of its set (size 0: none); the classes; and the frequent grams.

    A class has (c, sid, size, copies, first, key, again): first and key are its least doc_id and that row's key, again how many rows have that key.
    """
    live = F.col("doc_id").isNotNull()
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.when(live, F.col("text"))).alias("text"), rows.row_key().alias("k"))
    each = found.mapInArrow(T.lean(_classes(n)), "doc_id bigint, k bigint, sid bigint, sid2 bigint, size int")
    each = rows.cut(each)
    one = each.where("size > 0").groupBy("sid", "sid2", "k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max("size").alias("size"))
    by_class = one.groupBy("sid", "sid2").agg(F.min(F.struct("doc_id", "k", "n")).alias("x"), F.sum("n").alias("copies"), F.max("size").alias("size"))
    by_class = rows.cut(by_class.select(F.xxhash64("sid", "sid2").alias("c"), F.shiftrightunsigned("sid", 64 - SID_BITS).alias("sid"), "size", "copies", F.col("x.doc_id").alias("first"), F.col("x.k").alias("key"), F.col("x.n").alias("again")))
    often = each.where("size < 0").groupBy("sid").agg(F.sum("sid2").alias("n")).where(F.col("n") >= max(HOT_LEAST, each.where("size > 0").count() // HOT_SHARE))
    hot = np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "sid").limit(HOT_MOST).collect()], np.int64).astype(U))
    each = each.where("size >= 0").select("doc_id", "k", F.when(F.col("size") > 0, F.xxhash64("sid", "sid2")).alias("c"), "size")
    return each, by_class, hot


def copies_of(each: DataFrame, by_class: DataFrame) -> DataFrame:
    """Keys k of the rows that are not their class's first one."""
    return each.where("size > 0").join(by_class.where("copies > 1").select("c", "key"), "c").where("k != key").select("k").distinct()


def _roots(x: np.ndarray, y: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
    """Joins the ends of the pairs in the forest `root`, each tree's root being its least number; gives the pairs that joined two trees."""
    at = np.arange(len(x))
    while len(at):
        p, q = root[x[at]], root[y[at]]
        while (root[p] != p).any() or (root[q] != q).any():
            p, q = root[p], root[q]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return
        at, p, q = at[apart], p[apart], q[apart]
        high, low = np.maximum(p, q), np.minimum(p, q)
        _, first = np.unique(high, return_index=True)  # each root is hung once
        root[high[first]] = low[first]
        yield at[first]


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, l) of all pairs, which are one partition of at most ONE_TASK."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if ends:
        values, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
        at = at.reshape(2, -1)
        root = np.arange(len(values))
        for _ in _roots(at[0], at[1], root):
            pass
        while (root[root] != root).any():
            root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(values[root])], ["c", "l"])


def components(pairs: DataFrame) -> DataFrame:
    """Rows (c, l): the ends of pairs (ca, cb), and the least end that each is connected with. Up to ONE_TASK pairs are joined in one task, more in rounds of shuffles."""
    pairs = rows.cut(pairs.select("ca", "cb"))
    if pairs.count() <= ONE_TASK:
        return rows.cut(pairs.coalesce(1).mapInArrow(T.lean(_labels), "c bigint, l bigint"))
    both = rows.cut(pairs.select("ca", "cb").union(pairs.select("cb", "ca")).toDF("c", "o"))
    label = rows.cut(both.groupBy("c").agg(F.min(F.least("c", "o")).alias("l")))
    while True:  # labels spread along edges, and jump to their label's label, until none changes
        near = both.join(label.select(F.col("c").alias("o"), F.col("l").alias("got")), "o").groupBy("c").agg(F.min("got").alias("got"))
        step = label.join(near, "c").select("c", "l", F.least("l", "got").alias("via"))
        jump = label.select(F.col("c").alias("via"), F.col("l").alias("far"))
        step = rows.cut(step.join(jump, "via").select("c", F.col("l").alias("old"), F.least("via", "far").alias("l")))
        label = step.select("c", "l")
        if step.where("old != l").isEmpty():
            return label


def lists_of(docs: DataFrame, hot: np.ndarray, n: int, threshold: float) -> DataFrame:
    """Rows (leader, members) of the sids of sets that share a key. docs: a row for each class."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key, by_sid, short = Packing(tasks, KEY_BITS, 5, 1), Packing(tasks, SID_BITS, 6, 1, 1), Packing(tasks, KEY_BITS, 5)
    low = docs.where("text is not null and doc_id is not null").select(F.lower("text").alias("text"))
    keys = by_key.spread(low.mapInArrow(T.lean(_keys(n, threshold, by_key, hot)), KEYED))
    shared = by_sid.spread(keys.mapInArrow(T.lean(_shared(by_key, by_sid)), KEYED))
    rare = short.spread(shared.mapInArrow(T.lean(_rarest(by_sid, short)), KEYED))
    return rows.cut(rare.mapInArrow(T.lean(_lists(short)), "leader bigint, members binary").distinct())


def verdicts(docs: DataFrame, each: DataFrame, by_class: DataFrame, hot: np.ndarray, n: int, threshold: float, every: bool = False) -> DataFrame:
    """What the tiles give of the classes' pairs whose sets' Jaccard similarity is at least the threshold: see _verified."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = rows.without(docs.select("doc_id", "text"), copies_of(each, by_class))
    lists = lists_of(single, hot, n, threshold)
    label = components(lists.mapInArrow(T.lean(_stars), "ca bigint, cb bigint").distinct())
    of = by_class.select("sid", "c", "size", "key")
    ends = rows.cut(label.withColumnRenamed("c", "sid").join(of.select("sid", "size"), "sid"))
    lists = rows.cut(lists.join(rows.small(label.select(F.col("c").alias("leader"), "l")), "leader"))
    grams, sets = F.sum(F.col("size").cast("bigint")), F.count("*")
    parts = F.greatest(F.ceil(6 * grams / TILE_BYTES), F.ceil(sets / TILE_SETS), F.ceil(F.sqrt(grams.cast("double") * sets / TILE_WORK))).cast("int").alias("parts")
    weight = ends.groupBy("l").agg(parts, sets.alias("sets"))
    # large groups of which the lists cover little
    met = lists.groupBy("l").agg(F.sum(F.pow(F.length("members") / 8, 2)).alias("met"))
    weight = rows.cut(weight.join(met, "l").select("l", "parts", ((F.col("parts") > 1) & (4 * F.col("met") < F.pow("sets", 2))).alias("loose")))
    lists = rows.cut(lists.join(rows.small(weight), "l").select(F.when(F.col("loose"), F.xxhash64("l", "leader")).otherwise(F.col("l")).alias("l"), "members", "parts", "loose"))
    pieces = lists.where("loose").select("l", "members").mapInArrow(T.lean(_members), "l bigint, sid bigint").distinct().join(of.select("sid", "size"), "sid")
    small_parts = rows.cut(pieces.groupBy("l").agg((-parts).alias("parts")))
    tight = weight.where("not loose").select("l", "parts")
    weight = rows.cut(tight.union(small_parts))
    ends = ends.join(tight.select("l"), "l", "left_semi").select("l", "sid").union(pieces.select("l", "sid"))
    routed = lists.select("l", "members").join(rows.small(weight), "l").select("l", "parts", "members").mapInArrow(T.lean(_routed), TILED)
    sent = ends.join(weight, "l").select("l", "parts", "sid").distinct().mapInArrow(T.lean(_sent), "tile bigint, sid bigint").join(of.drop("size"), "sid")
    texts = single.where("text is not null").select(rows.row_key().alias("key"), F.lower("text").alias("text"))
    # sets are computed again for the candidates only
    again = texts.join(rows.small(rows.cut(sent)), "key").select("tile", "c", "sid", "text").mapInArrow(T.lean(_sets(n)), TILED)
    if not by_class.where("again > 1").isEmpty():
        again = again.dropDuplicates(["tile", "a"])
    gathered = again.union(routed).repartition(tasks, "tile").sortWithinPartitions("tile", "kind")
    return gathered.mapInArrow(T.lean(_verified(threshold, every)), "kind tinyint, ca bigint, cb bigint, n bigint")


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of different sets with Jaccard similarity of at least the threshold: rows (doc_a, doc_b, n_a, n_b, common, jaccard), each set by its least doc_id."""
    each, by_class, hot = members(docs, n)
    pairs = verdicts(docs, each, by_class, hot, n, threshold, every=True).where("kind = 2").select("ca", "cb", F.col("n").alias("common")).distinct()
    a, b = (by_class.select(F.col("c").alias(f"c{s}"), F.struct(F.col("first").alias("doc"), F.col("size").alias("n")).alias(s)) for s in "ab")
    both = pairs.join(a, "ca").join(b, "cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")
    jaccard = F.col("common") / (F.col("a.n") + F.col("b.n") - F.col("common"))
    return both.select(F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.col("common").cast("int").alias("common"), jaccard.alias("jaccard"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row (doc_id, class_id, n_copies, n_links) for every row of docs.

    class_id: the least doc_id of those connected with it by pairs of at least the threshold; n_copies: rows with the same set, itself
    included; n_links: the other sets that it is similar to. A row without words has no class, and 0.
    """
    each, by_class, hot = members(docs, n)
    found = rows.cut(verdicts(docs, each, by_class, hot, n, threshold))
    label = components(found.where("kind = 1"))
    least = label.join(by_class.select("c", "first"), "c").groupBy("l").agg(F.min("first").alias("class_id"))
    met = found.where("kind = 2").select("ca", "cb").distinct().select(F.explode(F.array("ca", "cb")).alias("c"), F.lit(1).cast("bigint").alias("n"))
    count = found.where("kind = 0").select(F.col("ca").alias("c"), "n").union(met).groupBy("c").agg(F.sum("n").alias("n_links"))
    near = label.join(least, "l").join(count, "c").select("c", "class_id", "n_links")
    classes = by_class.select("c", "first", "copies").join(near, "c", "left").select("c", F.coalesce("class_id", "first").alias("class_id"), F.col("copies").alias("n_copies"), "n_links")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
    return each.join(classes, "c", "left").select("doc_id", "class_id", zero("n_copies"), zero("n_links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs less all but the first (lowest doc_id) of each group of near duplicates.

    A group is a connected component of the join's pairs. A row with a null doc_id or text, or with a
    text without words, stays. Of rows with one doc_id and equal sets one stays.
    """
    each, by_class, hot = members(docs, n)
    found = rows.cut(verdicts(docs, each, by_class, hot, n, threshold).where("kind = 1"))
    ranked = components(found).join(by_class.select("c", F.struct("first", "c").alias("me")), "c")
    least = ranked.groupBy("l").agg(F.min("me").alias("least"))
    lost = rows.cut(ranked.join(least, "l").where("least.c != c").select("c"))
    gone = each.join(lost, "c", "left_semi").select("k")
    kept = rows.without(docs, rows.cut(gone.union(copies_of(each, by_class)).distinct()))
    again = by_class.where("again > 1").join(lost, "c", "left_anti").select(F.col("key").alias("__ls_k"))
    if again.isEmpty():
        return kept
    again = rows.small(again)
    keyed = kept.withColumn("__ls_row", rows.row_key())
    match = F.col("__ls_row") == F.col("__ls_k")
    once = keyed.join(again, match, "left_semi").dropDuplicates(["__ls_row"])
    return keyed.join(again, match, "left_anti").union(once).drop("__ls_row")
