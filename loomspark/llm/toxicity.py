"""Toxic documents, by Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is a short public list of English insults and, per corpus, the words that the labels show
to occur in toxic documents only. A listed term may be misspelled by as many edits as its length
allows; a learnt word must match as it is. The terms' Levenshtein automata are intersected with the
terms' trie into one deterministic automaton, and all words of a batch advance through its table
together, a character at a time, most of them dying after a few.

A match counts its term's weight, less for each edit, times a context factor: matches in a window that
quotes (quotation marks around, or a reporting word nearby) count QUOTED of it, and a window that
addresses somebody (a second-person word) counts ADDRESSED. A document is toxic if its matches add up to LIMIT.

Defined cases: a null or empty text, or one without words, has score 0 and is kept; repeated rows are judged
alike; a null doc_id is carried; without labels only the listed terms count; an empty table gives no
rows; only the identifier and text columns are read, and other columns are carried along whatever their names.
Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import rows
from . import textnp as T

TERMS = ("idiot", "moron", "pathetic", "scum", "trash", "loser", "worthless", "clown", "disgusting", "stupid", "imbecile", "vermin", "scumbag", "dumbass", "retard")
REPORTING = ("said", "says", "wrote", "writes", "quoted", "quote", "called", "claimed", "alleged", "according", "reported", "dit", "sagte", "dijo", "zitiert", "cita", "écrit")
ADDRESSING = ("you", "your", "youre", "tu", "toi", "dich", "eres", "vous", "usted")
WINDOW = 4
QUOTED, ADDRESSED, EDIT_WEIGHT = 0.25, 1.5, 0.6
LIMIT = 1.2
#: Most labelled documents that the lexicon is learnt from; beyond it, those of the lowest key hashes.
TRAIN_ROWS = 200_000
#: A word is learnt if this many toxic documents have it, and its rate in toxic documents is this many times that in others.
LEARN_DOCS, LEARN_RATIO = 5, 30.0
QUOTES, ADDRESSES, INNOCENT = 1, 2, 3
MARKS = np.array([ord(c) for c in '"“”„«»‟'])


def edits_of(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """Deterministic table: step[state, symbol] (0 is dead, 1 the start); final[state] is the weight of the best term there, 0 for none."""

    symbols: np.ndarray
    step: np.ndarray
    final: np.ndarray
    kind: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))


def build(terms: dict[str, tuple[float, int]], others: dict[str, int] | None = None) -> Automaton:
    """The intersection of the terms' Levenshtein automata with their trie. terms: word -> (weight, edits).

    others: words to find as they are, with a kind other than 0.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[tuple[float, int] | None] = [None]
    kinds = [0]
    reach = [0]

    def insert(word: str, edits: int) -> int:
        x = 0
        reach[0] = max(reach[0], edits)
        for c in word:
            if c not in children[x]:
                children[x][c] = len(children)
                children.append({})
                ends.append(None)
                kinds.append(0)
                reach.append(0)
            x = children[x][c]
            reach[x] = max(reach[x], edits)
        return x

    for word, (weight, edits) in sorted(terms.items()):
        ends[insert(word, edits)] = (weight, edits)
    for word, kind in sorted((others or {}).items()):
        kinds[insert(word, 0)] = kind
    letters = sorted({c for x in children for c in x})

    def closed(pairs: dict[int, int]) -> frozenset[tuple[int, int]]:
        """With the trie nodes that skipping letters of the term leads to; the fewest edits of each node."""
        work = list(pairs.items())
        while work:
            x, e = work.pop()
            if pairs.get(x, 99) < e:
                continue
            for y in children[x].values():
                if e + 1 <= reach[y] and e + 1 < pairs.get(y, 99):
                    pairs[y] = e + 1
                    work.append((y, e + 1))
        return frozenset(pairs.items())

    def moved(state: frozenset[tuple[int, int]], letter: str | None) -> frozenset[tuple[int, int]]:
        out: dict[int, int] = {}
        for x, e in state:
            if e + 1 <= reach[x] and e + 1 < out.get(x, 99):
                out[x] = e + 1  # a letter too many
            for c, y in children[x].items():
                cost = e + (c != letter)
                if cost <= reach[y] and cost < out.get(y, 99):
                    out[y] = cost
        return closed(out)

    def verdict(state: frozenset[tuple[int, int]]) -> tuple[float, int]:
        best, kind = 0.0, 0
        for x, e in state:
            if ends[x] is not None and e <= ends[x][1]:
                best = max(best, ends[x][0] * EDIT_WEIGHT**e)
            if e == 0 and kinds[x]:
                kind = kinds[x]
        return (0.0 if kind == INNOCENT else best), kind

    start = closed({0: 0})
    number = {frozenset(): 0, start: 1}
    order = [frozenset(), start]
    table: list[list[int]] = []
    at = 0
    while at < len(order):
        row = []
        for letter in [None, *letters]:
            to = moved(order[at], letter)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
        at += 1
    verdicts = [verdict(x) for x in order]
    return Automaton(np.array([ord(c) for c in letters], np.int64), np.array(table, np.int32), np.array([v for v, _ in verdicts]), np.array([k for _, k in verdicts], np.int8))


def _points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a batch's texts and row offsets."""
    raw, off = T.buffers(col)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    starts = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return points, starts[off]


_LETTER = np.zeros(0x110000, dtype=bool)
_LETTER[[b for b in range(128) if chr(b).isalnum()]] = True
_LETTER[128:] = True
_LETTER[[*range(0x80, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004), 0xFEFF]] = False


def matches(a: Automaton, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first code point and end (in the batch), weight and kind of the words that the automaton accepts, in text order; and the code points."""
    points, off = _points(col)
    n = len(points)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, np.zeros(0), np.zeros(0, np.int8)
    inside = _LETTER[points]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < n]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    at = np.flatnonzero(inside)
    place = np.searchsorted(at, start)
    length = np.diff(np.append(place, len(at)))
    if not len(start):
        return none, none, none, np.zeros(0), np.zeros(0, np.int8)
    symbol = np.zeros(0x110000, np.int32)
    symbol[a.symbols] = np.arange(1, len(a.symbols) + 1)
    alive, state = np.arange(len(start)), np.ones(len(start), np.int32)
    done_w, done_s = [], []
    k = 0
    while len(alive):
        state = a.step[state, symbol[points[start[alive] + k]]]
        k += 1
        ended = (length[alive] == k) & ((a.final[state] > 0) | (a.kind[state] > 0))
        if ended.any():
            done_w.append(alive[ended])
            done_s.append(state[ended])
        live = (state > 0) & (length[alive] > k)
        alive, state = alive[live], state[live]
    if not done_w:
        return none, none, none, np.zeros(0), np.zeros(0, np.int8)
    word, state = np.concatenate(done_w), np.concatenate(done_s)
    sort = np.argsort(word)
    word, state = word[sort], state[sort]
    row = np.searchsorted(off, start[word], side="right") - 1
    return row, word, start[word], a.final[state], a.kind[state]


def _hits(a: Automaton, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first code point, weight, whether quoted and whether addressed, of the terms in the column's texts (lower case)."""
    row, word, start, weight, kind = matches(a, col)
    hit = weight > 0
    if not hit.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)
    near = lambda wanted: _near(word[hit], row[hit], word[kind == wanted], row[kind == wanted])
    points, off = _points(col)
    mark = np.cumsum(np.isin(points, MARKS))
    # inside quotation marks: an odd number before it in its text and another one after it
    opened = mark[start[hit]] - np.append(0, mark)[off[row[hit]]]
    closes = np.append(0, mark)[off[row[hit] + 1]] - mark[start[hit]]
    quoted = ((opened % 2 == 1) & (closes > 0)) | near(QUOTES)
    return row[hit], start[hit], weight[hit], quoted, near(ADDRESSES)


def scores(a: Automaton, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, matches and quoted matches of each text of the column (lower case)."""
    row, _, weight, quoted, addressed = _hits(a, col)
    n = len(col)
    factor = np.where(quoted, QUOTED, np.where(addressed, ADDRESSED, 1.0))
    return np.bincount(row, weight * factor, n).astype(float), np.bincount(row, minlength=n), np.bincount(row, quoted, n).astype(np.int64)


def _near(word: np.ndarray, row: np.ndarray, other: np.ndarray, other_row: np.ndarray) -> np.ndarray:
    """Whether one of the other words is within WINDOW words, in the same row; both ascend."""
    if not len(other):
        return np.zeros(len(word), bool)
    out = np.zeros(len(word), bool)
    at = np.searchsorted(other, word)
    for k in (at - 1, np.minimum(at, len(other) - 1)):
        k = np.maximum(k, 0)
        out |= (np.abs(other[k] - word) <= WINDOW) & (other_row[k] == row)
    return out


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    tokens = pc.split_pattern_regex(batch.column(0), pattern=T.SEPARATORS)
    return tokens.flatten(), pc.list_parent_indices(tokens).to_numpy()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, before, doc_id): the words of toxic documents with the word before."""
    for batch in batches:
        for part in T.slices(batch, 0):
            words, row = _words(part)
            size = pc.utf8_length(words)
            keep = pc.and_(pc.greater_equal(size, 4), pc.less_equal(size, 40))
            before = words.take(pc.max_element_wise(pa.array(np.arange(len(words)) - 1), 0)) if len(words) else words
            yield pa.RecordBatch.from_arrays([words, before, part.column(1).take(pa.array(row))], ["word", "before", "doc_id"]).filter(keep)


def _counted(wanted: list[str]):
    """(word, n): in how many texts of a batch each wanted word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(wanted, pa.string())
        for batch in batches:
            for part in T.slices(batch, 0):
                words, row = _words(part)
                code = pc.index_in(words, value_set=values)
                here = pc.is_valid(code).to_numpy(zero_copy_only=False)
                pairs = np.unique(np.stack([code.filter(pa.array(here)).to_numpy(), row[here]], 1), axis=0)
                n = np.bincount(pairs[:, 0], minlength=len(wanted))
                yield pa.RecordBatch.from_arrays([values.filter(pa.array(n > 0)), pa.array(n[n > 0])], ["word", "n"])

    return run


def _misspelt(a: Automaton):
    """(word, before, doc_id): the unquoted words that the automaton accepts with edits, with the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 0):
                row, start, weight, quoted, _ = _hits(a, part.column(0))
                pick = (weight < 1) & ~quoted
                points, off = _points(part.column(0))
                found = []
                for r, first in zip(row[pick], start[pick]):
                    end, stop = first, first - 1
                    while end < off[r + 1] and _LETTER[points[end]]:
                        end += 1
                    while stop >= off[r] and not _LETTER[points[stop]]:
                        stop -= 1
                    begin = stop
                    while begin >= off[r] and _LETTER[points[begin]]:
                        begin -= 1
                    found.append(("".join(map(chr, points[first:end])), "".join(map(chr, points[begin + 1 : stop + 1]))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([b for _, b in found]), part.column(1).take(pa.array(row[pick]))], ["word", "before", "doc_id"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Words that the labels show to be toxic, and words like a term that are not; at most TRAIN_ROWS labelled documents are read.

    Occurrences count by the different words before them, so that copies of a document teach nothing. A
    word that a term's automaton accepts with edits is innocent if LEARN_DOCS documents without toxicity have it
    unquoted, unless its rate in toxic documents is LEARN_RATIO times that in others.
    """
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    toxic = rows.cut(toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) if toxic.count() > TRAIN_ROWS else toxic)
    n_bad, n_good = toxic.where("toxic").count(), toxic.where("not toxic").count()
    texts = docs.where("text is not null").select("doc_id", "text")
    of = lambda which: texts.join(F.broadcast(toxic.where(which).select("doc_id")), "doc_id").select(F.lower("text").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    form = "word string, before string, doc_id bigint"
    seen = of("toxic").mapInArrow(T.lean(_placed), form)
    bad = {w: n for w, p, n in seen.groupBy("word").agg(F.countDistinct("before").alias("p"), F.countDistinct("doc_id").alias("n")).where(F.col("p") >= LEARN_DOCS).collect() if n >= LEARN_DOCS}
    good = dict(of("not toxic").mapInArrow(T.lean(_counted(sorted(bad))), "word string, n bigint").groupBy("word").sum("n").collect())
    learnt = [w for w in sorted(bad) if n_good and (bad[w] / n_bad) / ((good.get(w, 0) + 1) / n_good) >= LEARN_RATIO]
    loose = lambda which: of(which).mapInArrow(T.lean(_misspelt(lexicon(learnt))), form).groupBy("word").agg(F.countDistinct("before").alias("p"), F.countDistinct("doc_id").alias("n"))
    clean = {w: n for w, p, n in loose("not toxic").where(F.col("p") >= LEARN_DOCS).collect() if n >= LEARN_DOCS}
    rude = {w: n for w, _, n in loose("toxic").where(F.col("word").isin(sorted(clean))).collect()} if clean and n_bad else {}
    return learnt, sorted(w for w, n in clean.items() if not n_bad or (rude.get(w, 0) / n_bad) / (n / n_good) < LEARN_RATIO)


def lexicon(learnt: list[str] = [], innocent: list[str] = []) -> Automaton:
    others = {w: QUOTES for w in REPORTING} | {w: ADDRESSES for w in ADDRESSING} | {w: INNOCENT for w in innocent}
    return build({w: (1.0, 0) for w in learnt if w not in others} | {t: (1.0, edits_of(t)) for t in TERMS}, others)


def _score(a: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 2):
                score, n, quoted = scores(a, part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.round(score, 6)), pa.array(n), pa.array(quoted), pa.array(score >= LIMIT - 1e-9)], ["doc_id", "k", "score", "matches", "quoted", "toxic"])

    return run


def scored(docs: DataFrame, a: Automaton) -> DataFrame:
    rows.bound_batches(docs.sparkSession)
    schema = ST.StructType([docs.schema["doc_id"], *ST._parse_datatype_string("k bigint, score double, matches bigint, quoted bigint, toxic boolean").fields])
    return docs.select("doc_id", rows.row_key().alias("k"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(T.lean(_score(a)), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row (doc_id, score, matches, quoted, toxic) for every document."""
    return scored(docs, lexicon(*learn(docs, labels))).drop("k")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less the toxic ones. No text moves between executors."""
    bad = rows.cut(scored(docs, lexicon(*learn(docs, labels))).where("toxic").select("k").distinct())
    return rows.without(docs, bad)
