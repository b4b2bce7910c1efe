"""SentencePiece encoding and decoding by a batched Viterbi pass.

The model file is read without its library. A text becomes words (a space mark and the characters up to
the next space); the different words of a batch advance together: for every length, the hashes of all
substrings that begin a piece probe a table of the sorted piece hashes, and the surviving edges of the lattices are taken by end
position, all words at once, with the best predecessor stored as a backpointer. For a unigram model the best is the
highest sum of scores. For a BPE model it is the one edge whose piece the greedy merges would leave
next to the piece that ends at its start: neighbours are tested by undoing their merges, latest first,
and probing whether a merge across the boundary would have come before. Both are exact.

Words already seen by the task are not encoded again, as long as they fit in a table of KNOWN words, which then starts again. A word of more than LONG characters is merged
by a heap instead (the same result, without a step of the whole batch for each character).

Decoding joins the pieces' bytes; it gives back the text exactly, except that a literal U+2581 becomes a space, as
with the model's own library.

Defined cases: bytes that are not UTF-8 are read as U+FFFD, and the row isn't exact; a null text gives null ids and null elsewhere; an empty text no ids; repeated rows are encoded alike; a null doc_id is
carried; an empty table gives no rows; only the identifier and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

from . import piece_model as M
from . import rows
from . import textnp as T

U = np.uint64
LONG = 400
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20
#: Characters of new words that advance together, about.
STEP = 300_000
#: Most words and ids that are kept encoded; when they would be more, those of the range at hand are encoded anew.
KNOWN, KNOWN_IDS = 500_000, 4_000_000
MARK = ord(M.SPACE)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... of all i, one after another."""
    if not len(start):
        return np.zeros(0, np.int64)
    end = np.cumsum(length)
    return np.arange(int(end[-1])) + np.repeat(start - (end - length), length)


class Encoder:
    """Encodes batches of words; what it has encoded once it looks up."""

    def __init__(self, t: M.Tables):
        self.t = t
        self.forget()
        self.runs: dict[int, list[int]] = {}
        self.by_id = np.zeros(int(t.piece_id.max()) + 1, np.int64)
        self.by_id[t.piece_id] = np.arange(len(t.piece_id))

    def forget(self) -> None:
        """Empties the table of words: sorted hashes, and where in `flat` their ids begin and how many they are."""
        self.known = np.zeros(0, U)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.used = 0

    def unknown(self, u: np.ndarray) -> np.ndarray:
        """Which of these hashes, ascending, the table hasn't."""
        if not len(self.known):
            return np.ones(len(u), bool)
        return self.known[np.minimum(np.searchsorted(self.known, u), len(self.known) - 1)] != u

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the piece prefixes with these hashes, -1 for none."""
        t = self.t
        k = t.slots[(h >> U(64 - M.SLOT_BITS)).astype(np.int64)]
        miss = np.flatnonzero(t.prefixes[k] != h)
        if len(miss):
            other = t.spill[(h[miss] >> U(t.shift) & U((2 << M.SLOT_BITS) - 1)).astype(np.int64)]
            k[miss] = np.where(t.prefixes[other] == h[miss], other, -1)
        return k

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Token numbers of substring hashes, -1 for none."""
        k = self.find(h)
        return np.where(k >= 0, self.t.prefix_piece[k], -1)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether greedy merging of the joined text leaves token a next to token b; -1 is a character without a piece."""
        t = self.t
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live], b[live]
        limit = np.full(len(live), M.NEVER)
        while len(live):
            both = self.probe(t.hashes[a] * t.powers[t.length[b]] + t.hashes[b])
            crossed = (both >= 0) & (np.where(both >= 0, t.rank[both], 0) < limit)
            ok[live[crossed]] = False
            ra, rb = t.rank[a], t.rank[b]
            first = ra > rb
            go = ~crossed & (first | (rb >= 0))
            limit = np.where(first, ra, rb + 1)[go]
            a, b = np.where(first, t.right[a], a)[go], np.where(first, b, t.left[b])[go]
            live = live[go]
        return ok

    def viterbi(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all words in order, -1 - character for one without a piece, and each word's count."""
        t, n, words = self.t, len(points), len(off) - 1
        owner = np.repeat(np.arange(words), np.diff(off))
        prefix = np.zeros(n + 1, U)
        # running polynomial within each word: positions of all words advance together
        value = M.text_hash(points)
        local = np.arange(n) - off[owner]
        longest = int(np.diff(off).max())
        inner = np.zeros(n, U)
        by_place = np.argsort(local.astype(np.int16 if longest < 1 << 15 else np.int64), kind="stable")
        bounds = np.searchsorted(local[by_place], np.arange(longest + 1))
        for k in range(longest):
            p = by_place[bounds[k] : bounds[k + 1]]
            inner[p] = value[p] if k == 0 else inner[p - 1] * M.BASE + value[p]
        before = np.zeros(n, U)
        before[1:] = inner[:-1]
        before[off[:-1]] = 0
        room = np.repeat(np.diff(off), np.diff(off)) - local
        begin, end, token = [], [], []
        p = np.arange(n, dtype=np.int32)
        size = 1
        while len(p):  # only where a piece goes on
            k = self.find(inner[p + (size - 1)] - before[p] * t.powers[size])
            piece = np.where(k >= 0, t.prefix_piece[k], -1)
            if size == 1:
                lone = piece < 0
                begin.append(p[lone]), end.append(p[lone]), token.append((-1 - points[p[lone]]).astype(np.int32))
            hit = np.flatnonzero(piece >= 0)
            hit = hit[t.alive[piece[hit]]]
            begin.append(p[hit]), end.append(p[hit] + (size - 1)), token.append(piece[hit].astype(np.int32))
            p = p[(k >= 0) & (room[p] > size)]
            size += 1
        begin, end, token = map(np.concatenate, (begin, end, token))
        order = np.argsort(local[end].astype(np.int16 if longest < 1 << 15 else np.int64), kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        steps = np.searchsorted(local[end], np.arange(longest + 1))
        best = np.full(n, -1, np.int64)  # the edge that ends here
        held = np.full(n, -M.NEVER, np.int64)  # its token
        total = np.full(n, -np.inf)
        for k in range(longest):
            b, e, x = begin[steps[k] : steps[k + 1]], end[steps[k] : steps[k + 1]], token[steps[k] : steps[k + 1]]
            fresh = local[b] == 0
            ready = fresh | (best[np.maximum(b - 1, 0)] >= 0)
            if t.bpe:
                ask = np.flatnonzero(ready & ~fresh)
                last = held[b[ask] - 1]
                ready[ask] = self.fits(np.where(last < 0, -1, last), np.where(x[ask] < 0, -1, x[ask]))
                use = np.flatnonzero(ready)
                best[e[use]] = steps[k] + use
                held[e[use]] = x[use]
            else:
                use = np.flatnonzero(ready)
                gain = np.where(x[use] >= 0, t.score[np.maximum(x[use], 0)], t.score.min() - 10.0) + np.where(fresh[use], 0.0, total[np.maximum(b[use] - 1, 0)])
                np.maximum.at(total, e[use], gain)
                top = use[gain == total[e[use]]]
                best[e[top]] = steps[k] + top
                held[e[top]] = x[top]
        # backpointers, all words at once
        counts = np.zeros(words, np.int64)
        place, word = off[1:] - 1, np.arange(words)
        got_w, got_x = [], []
        while len(word):
            edge = best[place]
            got_w.append(word), got_x.append(token[edge])
            counts[word] += 1
            more = local[begin[edge]] > 0
            place, word = begin[edge][more] - 1, word[more]
        w, x = np.concatenate(got_w), np.concatenate(got_x)
        back = np.lexsort((-np.arange(len(w)), w))
        return x[back], counts

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of tokens, and how many each gives: a character without a piece gives its bytes."""
        size = np.ones(len(numbers), np.int64)
        odd = np.flatnonzero(numbers < 0)
        if not len(odd):
            return self.t.piece_id[numbers], size
        coded = [chr(-1 - x).encode("utf-8", "surrogatepass") for x in numbers[odd].tolist()]
        if self.t.unknown < 0:
            size[odd] = [len(c) for c in coded]
        out = np.zeros(int(size.sum()), np.int32)
        start = np.cumsum(size) - size
        plain = numbers >= 0
        out[start[plain]] = self.t.piece_id[numbers[plain]]
        if self.t.unknown < 0:
            out[ranges(start[odd], size[odd])] = self.t.byte_id[np.frombuffer(b"".join(coded), np.uint8)]
        else:
            out[start[odd]] = self.t.unknown
        return out, size

    def add(self, h: np.ndarray, points: np.ndarray, off: np.ndarray) -> None:
        """Encodes new words."""
        size = np.diff(off)
        parts_flat, parts_n, parts_h = [], [], []
        every = np.flatnonzero(size <= LONG)
        parts = np.searchsorted(np.cumsum(size[every]), np.arange(STEP, int(size[every].sum()) + STEP, STEP))
        for short in np.split(every, parts[:-1]) if len(every) else []:
            if not len(short):
                continue
            p = points[ranges(off[short], size[short])]
            x, n = self.viterbi(p, np.append(0, np.cumsum(size[short])))
            ids, each = self.ids_of(x)
            word = np.repeat(np.arange(len(short)), n)
            parts_flat.append(ids), parts_n.append(np.bincount(word, each, len(short)).astype(np.int64)), parts_h.append(h[short])
        for w in np.flatnonzero(size > LONG):
            text = "".join(map(chr, points[off[w] : off[w + 1]]))
            if self.t.bpe:
                tokens, _ = M.merge(text, self.t.ranks)
                numbers = np.array([self.t.ids.get(x, -1 - ord(x[0])) for x in tokens], np.int64)
                numbers = np.where(numbers >= 0, self.by_id[np.maximum(numbers, 0)], numbers)
            else:
                numbers, _ = self.viterbi(points[off[w] : off[w + 1]], np.array([0, size[w]]))
            ids, _ = self.ids_of(numbers)
            parts_flat.append(ids), parts_n.append(np.array([len(ids)])), parts_h.append(h[w : w + 1])
        flat, n, hs = np.concatenate(parts_flat), np.concatenate(parts_n), np.concatenate(parts_h)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat[: self.used], np.zeros(max(self.used, len(flat)) + len(flat), np.int32))
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        order = np.argsort(hs)
        into = np.searchsorted(self.known, hs[order])
        self.known, self.at, self.size = np.insert(self.known, into, hs[order]), np.insert(self.at, into, at[order]), np.insert(self.size, into, n[order])

    def run(self, length: int) -> list[int]:
        """Ids of that many space marks."""
        if length not in self.runs:
            tokens, _ = M.merge(M.SPACE * length, self.t.ranks)
            self.runs[length] = [self.t.ids[x] for x in tokens]
        return self.runs[length]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's count."""
        raw, off = T.buffers(col)
        rows_n = len(off) - 1
        points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype=np.uint32)
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[off]
        # a space mark before every text that isn't empty
        some = np.flatnonzero(np.diff(chars) > 0)
        points = np.insert(points, chars[some], 32)
        step = np.zeros(rows_n, np.int64)
        step[some] = 1
        chars = chars + np.append(0, np.cumsum(step))
        points = np.where(points == 32, MARK, points).astype(np.int64)
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows_n, np.int64)
        space = points == MARK
        first = np.zeros(n + 1, bool)
        first[chars[:-1][chars[:-1] < n]] = True
        first[n] = True
        ends_word = np.append(space[1:], True) | first[1:]
        starts_word = space & ~ends_word  # a mark with a character after it
        starts_run = space & ends_word & (np.append(True, ~space[:-1]) | first[:-1])
        start = np.flatnonzero(starts_word | starts_run)
        length = np.diff(np.append(start, n))
        is_run = starts_run[start]
        h = np.add.reduceat(M.text_hash(points) * self.place_weights(np.arange(n) - np.repeat(start, length)), start)
        h = T.mix(h + length.astype(U))
        words = np.flatnonzero(~is_run)
        u, at = np.unique(h[words], return_index=True)
        new = self.unknown(u)
        if len(self.known) + int(new.sum()) > KNOWN or self.used > KNOWN_IDS:
            self.forget()
            new[:] = True
        if new.any():
            w = words[at[new]]
            self.add(u[new], points[ranges(start[w], length[w])], np.append(0, np.cumsum(length[w])))
        unit_at, unit_n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        k = np.searchsorted(self.known, h[words])
        unit_at[words], unit_n[words] = self.at[k], self.size[k]
        flat = self.flat[: self.used]
        if is_run.any():
            r = np.flatnonzero(is_run)
            size = length[r].copy()
            row = np.searchsorted(chars, start, side="right")
            follow = np.minimum(r + 1, len(start) - 1)
            mark = self.t.ids[M.SPACE]
            joins = (follow > r) & ~is_run[follow] & (row[follow] == row[r])
            joins[joins] = flat[unit_at[follow[joins]]] == mark
            f = follow[joins]
            size[joins] += 1  # a word that keeps its mark by itself leaves it to the run
            unit_at[f] += 1
            unit_n[f] -= 1
            sizes, which = np.unique(size, return_inverse=True)
            tokens = [self.run(int(s)) for s in sizes]
            counts = np.array([len(x) for x in tokens])
            base = len(flat) + np.cumsum(counts) - counts
            flat = np.concatenate([flat, *[np.array(x, np.int32) for x in tokens]])
            unit_at[r], unit_n[r] = base[which], counts[which]
        total = np.append(0, np.cumsum(unit_n))
        upto = np.searchsorted(start, chars)
        return flat[ranges(unit_at, unit_n)], np.diff(total[upto])

    @staticmethod
    def place_weights(place: np.ndarray) -> np.ndarray:
        weight = T._R[place & (T._SLOTS - 1)]
        return weight if not len(place) or place.max() < T._SLOTS else weight * (U(2) * (place // T._SLOTS).astype(U) + U(1))


def decode(t: M.Tables, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of token lists, one after another."""
    size = np.array([len(x) for x in t.bytes], np.int64)
    joined = np.frombuffer(b"".join(t.bytes), np.uint8)
    at = np.cumsum(size) - size
    each = size[ids]
    data = joined[ranges(at[ids], each)]
    end = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(counts))]
    starts = end[:-1][np.diff(end) > 0]
    starts = starts[data[starts] == 32]  # the mark that encoding put first
    keep = np.ones(len(data), bool)
    keep[starts] = False
    data = data[keep]
    end = end - np.searchsorted(starts, end)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(end.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _encode(t: M.Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(t)
        for batch in batches:
            for part in T.slices(batch, 1, CHUNK):
                ids, counts = coder.encode(T.repaired(part.column(1)))
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                back = decode(t, ids, counts)
                same = back.to_numpy(zero_copy_only=False) == part.column(1).cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(counts.astype(np.int32), mask=null), pa.array(same.astype(bool), mask=null)], ["doc_id", "ids", "n_tokens", "exact"])

    return run


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """A row (doc_id, ids, n_tokens, exact) for every document; exact: decoding the ids gives the text."""
    rows.bound_batches(docs.sparkSession)
    schema = ST.StructType([docs.schema["doc_id"], *ST._parse_datatype_string("ids array<int>, n_tokens int, exact boolean").fields])
    return docs.select("doc_id", "text").mapInArrow(T.lean(_encode(M.tables(model))), schema)


def _decode(t: M.Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            counts = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            back = decode(t, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = [None if gone else x.decode("utf-8", "replace") for x, gone in zip(back.to_pylist(), null)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids)."""
    schema = ST.StructType([tokens.schema["doc_id"], ST.StructField("text", ST.StringType())])
    return tokens.select("doc_id", "ids").mapInArrow(T.lean(_decode(M.tables(model))), schema)
