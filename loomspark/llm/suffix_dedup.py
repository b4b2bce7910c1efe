"""Repeated passages by suffix arrays built with induced sorting.

A window is LEAST consecutive words. A window that equals an earlier one (by doc_id, then place) is a
repeat; a span is a maximal run of words that repeats cover, and spans are what deduplication cuts.

Shards without quadratic work: each window is represented by the least of its RUN-word hashes (winnowing),
its anchor. Equal windows have equal anchors, so windows whose anchor occurs once in the corpus are done
with. The others are gathered as regions (an anchor's adjoining windows); equal regions are
collapsed, and the distinct ones of an anchor go to the same shard, with their words. Every shard builds
one suffix array over its regions: suffixes are classified as smaller or larger than the next one, the
leftmost-smaller substrings are sorted by induction, named, and sorted recursively where names repeat, and
the rest is induced, all in linear time. Permuted common prefixes then tell which neighbours agree in LEAST words:
irreducible ones are compared, the others follow from the one before. Groups of such neighbours are the
equal windows.

All of it is exact up to 64-bit hash collisions. Nothing caps the copies of a passage.

Defined cases: null and empty texts, and those of fewer than LEAST words, have no window; a row with a
null doc_id takes no part and stays; rows with one doc_id and the same text are one document; a text may
repeat itself; an empty table gives no spans; other columns are carried along whatever their names.
Words are those of textnp, in lower case; case and punctuation don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows
from . import textnp as T

U = np.uint64
LEAST, RUN = 50, 8
GROW = U(0x9E3779B97F4A7C15)
#: Words of the regions of one shard, as far as whole anchors allow.
SHARD_WORDS = 200_000


def _sort(text: list[int], top: int) -> list[int]:
    """Suffix array of integers in [0, top), by induced sorting. The end counts as smaller than any."""
    n = len(text)
    if n == 0:
        return []
    if n == 1:
        return [0]
    smaller = bytearray(n + 1)
    smaller[n] = 1
    after = -1
    for i in range(n - 1, -1, -1):
        c = text[i]
        if c < after or (c == after and smaller[i + 1]):
            smaller[i] = 1
        after = c
    size = [0] * (top + 1)
    for c in text:
        size[c + 1] += 1
    for c in range(top):
        size[c + 1] += size[c]
    heads, tails = size[:top], size[1:]
    leftmost = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        at = tails[:]
        for i in reversed(seeds):
            c = text[i]
            at[c] -= 1
            out[at[c]] = i
        at = heads[:]
        c = text[n - 1]
        out[at[c]] = n - 1
        at[c] += 1
        for i in out:
            if i > 0 and not smaller[i - 1]:
                c = text[i - 1]
                out[at[c]] = i - 1
                at[c] += 1
        at = tails[:]
        for k in range(n - 1, -1, -1):
            i = out[k]
            if i > 0 and smaller[i - 1]:
                c = text[i - 1]
                at[c] -= 1
                out[at[c]] = i - 1
        return out

    if not leftmost:
        return induce([])
    order = induce(leftmost)
    is_seed = bytearray(n)
    for i in leftmost:
        is_seed[i] = 1
    end = {i: j for i, j in zip(leftmost, leftmost[1:])}
    name = [-1] * n
    last, names = -1, -1
    for i in order:
        if is_seed[i] and i > 0:
            # equal substrings, from one seed to the next, get equal names; the last one is unlike all
            j, k = end.get(i, -1), end.get(last, -1)
            if last < 0 or j < 0 or k < 0 or text[i : j + 1] != text[last : k + 1]:
                names += 1
            name[i] = names
            last = i
    reduced = [name[i] for i in leftmost]
    if names + 1 < len(leftmost):
        ranks = _sort(reduced, names + 1)
    else:
        ranks = [0] * len(reduced)
        for k, x in enumerate(reduced):
            ranks[x] = k
    return induce([leftmost[k] for k in ranks])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers."""
    values, dense = np.unique(text, return_inverse=True)
    return np.array(_sort(dense.tolist(), len(values)), np.int64)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix and the one before it in the suffix array."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    # a place is reducible if both suffixes are preceded by the same value: then it has one less than the place before
    reducible = np.zeros(n, bool)
    i = np.flatnonzero((np.arange(n) > 0) & (phi > 0))
    reducible[i] = (text[i - 1] == text[phi[i] - 1]) & (phi[i - 1] == phi[i] - 1)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    k = 0
    padded = np.append(text, -1)
    while len(live):
        a, b = live + k, phi[live] + k
        same = (a < n) & (b < n)
        same[same] = padded[a[same]] == padded[b[same]]
        out[live[~same]] = k
        live = live[same]
        k += 1
    source = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return np.maximum(out[source] - (np.arange(n) - source), 0)


def _anchors(h: np.ndarray, row: np.ndarray, least: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every row's regions: row, first word, windows and anchor. A region's windows adjoin and share the anchor's place."""
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return none, none, none, np.zeros(0, U)
    g = np.zeros(len(h), U)
    for k in range(run):
        g[: len(h) - k] += h[k:] * T._C[k]
    g = T.mix(g)
    width = least - run + 1
    # least hash of each width, the last of equals, by doubling: of values with their places in the low bits
    places = len(h) - run + 1
    bits = U(max(24, int(places).bit_length()))  # the same for all but giant texts, so that equal windows agree on ties
    value = (g[:places] >> bits << bits) | (U((1 << int(bits)) - 1) - np.arange(places, dtype=U))
    span = 1
    while span * 2 <= width:
        value[: len(value) - span] = np.minimum(value[: len(value) - span], value[span:])
        value = value[: len(value) - span]
        span *= 2
    if span < width:
        value = np.minimum(value[: len(value) - (width - span)], value[width - span :])
    place = (U((1 << int(bits)) - 1) - (value & U((1 << int(bits)) - 1))).astype(np.int64)
    count = np.diff(row)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(place))
    whole = first + least <= row[1:][owner[: len(place)]]
    first, place, owner = first[whole], place[whole], owner[: len(place)][whole]
    if not len(first):
        return none, none, none, np.zeros(0, U)
    new = np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1))
    at = np.flatnonzero(new)
    return owner[at], first[at] - row[owner[at]], np.diff(np.append(at, len(first))), g[place[at]]


def _contents(h: np.ndarray, row: np.ndarray, owner: np.ndarray, first: np.ndarray, windows: np.ndarray, least: int) -> np.ndarray:
    """A hash of each region's words."""
    if not len(owner):
        return np.zeros(0, U)
    grow = np.full(len(h) + 1, GROW, U)
    shrink = np.full(len(h) + 1, pow(int(GROW), -1, 2**64), U)
    grow[0] = shrink[0] = 1
    total = np.append(U(0), np.cumsum(T.mix(h + U(1)) * np.cumprod(grow)[:-1]))
    begin, size = row[owner] + first, windows + least - 1
    return T.mix((total[begin + size] - total[begin]) * np.cumprod(shrink)[begin] + size.astype(U))


def _regions(least: int, run: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 2):
                h, _, _, row = T.words(part.column(2))
                owner, first, windows, anchor = _anchors(h, row, least, run)
                content = _contents(h, row, owner, first, windows, least)
                pick = pa.array(owner)
                columns = [part.column(0).take(pick), part.column(1).take(pick), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "p", "w", "a", "r"])

    return work


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions whose anchor occurs more than once; `first` marks the earliest of equal ones. Rows come sorted by anchor."""
    for columns in rows.whole_groups(batches, 4):
        doc, k, p, w, a, r = columns
        at = np.lexsort((p, k, doc, r, a))
        once = np.append(True, (a[at][1:] != a[at][:-1]) | (k[at][1:] != k[at][:-1]) | (p[at][1:] != p[at][:-1]))  # rows with one doc_id and text are one document
        doc, k, p, w, a, r = (x[at[once]] for x in columns)
        new = np.append(True, a[1:] != a[:-1])
        run = np.cumsum(new) - 1
        many = np.bincount(run)[run] > 1
        first = new | np.append(True, r[1:] != r[:-1])
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (doc, k, p, w, a, r, first)], ["doc_id", "k", "p", "w", "a", "r", "first"])


def _cut_out(least: int):
    """The words of each wanted region of a document: rows (a, doc_id, k, p, w, words, r), words being 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 2):
                h, _, _, row = T.words(part.column(2))
                wanted = part.column(3)
                n = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = wanted.flatten()
                p, w, a, r = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                owner = np.repeat(np.arange(len(n)), n)
                begin, size = row[owner] + p, w + least - 1
                end = np.append(0, np.cumsum(size))
                at = np.arange(end[-1]) - np.repeat(end[:-1] - begin, size)
                lists = pa.LargeListArray.from_arrays(pa.array(end), pa.array(h[at].view(np.int64))).cast(pa.list_(pa.int64()))
                pick = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(a), part.column(0).take(pick), part.column(1).take(pick), pa.array(p.astype(np.int32)), pa.array(w.astype(np.int32)), lists, pa.array(r)], ["a", "doc_id", "k", "p", "w", "words", "r"])

    return work


def shard_groups(words: np.ndarray, off: np.ndarray, windows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of a shard's regions: (group, region, offset) for every window, groups numbered from 0."""
    n_regions = len(off) - 1
    _, dense = np.unique(words, return_inverse=True)
    # a separator of its own after each region, smaller than all words
    text = np.zeros(len(words) + n_regions, np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(n_regions), np.diff(off))
    text[place] = dense + n_regions
    text[off[1:] + np.arange(n_regions)] = np.arange(n_regions)
    sa = suffix_array(text)
    plcp = permuted_prefixes(text, sa)
    starts = off[:-1] + np.arange(n_regions)
    region = np.repeat(np.arange(n_regions), np.diff(off) + 1)
    offset = np.arange(len(text)) - starts[region]
    group = np.cumsum(plcp[sa] < least)
    window = offset[sa] < windows[region[sa]]
    group, where = group[window], sa[window]
    _, group = np.unique(group, return_inverse=True)
    return group, region[where], offset[where]


def _verdicts(least: int):
    """A row (a, r, doc_id, k, spans, least_doc) for each region that stands for its equals; rows come sorted by anchor.

    spans are the runs of its windows that repeat; least_doc is the least document where one of its windows is first.
    """

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        a, k, p = (table[x].to_numpy() for x in ("a", "k", "p"))
        fresh = np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
        part = table.filter(pa.array(fresh)).combine_chunks().to_batches()[0]  # each row of a repeated document once
        lists = part.column("words")
        off = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
        windows, doc, k, p = (part.column(x).to_numpy().astype(np.int64) for x in ("w", "doc_id", "k", "p"))
        group, region, offset = shard_groups(lists.flatten().to_numpy(), off, windows, least)
        place = p[region] + offset
        order = np.lexsort((place, k[region], doc[region], group))
        group, region, place = group[order], region[order], place[order]
        again = np.append(False, group[1:] == group[:-1])
        first = doc[region[np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))]]
        least_doc = np.full(len(k), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, region, first)
        region, place, first = region[again], place[again], first[again]
        order = np.lexsort((place, region))
        region, place, first = region[order], place[order], first[order]
        begins = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (place[1:] > place[:-1] + least))) if len(region) else np.zeros(0, np.int64)
        last = np.append(begins[1:], len(place))[: len(begins)] - 1
        runs = pa.StructArray.from_arrays([pa.array(place[begins].astype(np.int32)), pa.array((place[last] + least).astype(np.int32)), pa.array(np.minimum.reduceat(first, begins) if len(begins) else first)], ["b", "e", "first_doc"])
        spans_ = pa.ListArray.from_arrays(pa.array(np.searchsorted(region[begins], np.arange(len(k) + 1)).astype(np.int32)), runs)
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("r"), part.column("doc_id"), part.column("k"), spans_, pa.array(least_doc)], ["a", "r", "doc_id", "k", "spans", "least_doc"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while batch.num_rows:
                # cut where the anchor changes
                a = batch.column("a").to_numpy()
                cut = np.flatnonzero(np.append((a[0] != held[-1].column("a")[held[-1].num_rows - 1].as_py()) if held else False, a[1:] != a[:-1]))
                total = count + np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
                before = np.append(count, total[:-1])
                full = cut[before[cut] >= SHARD_WORDS]
                if not len(full):
                    held.append(batch)
                    count = int(total[-1])
                    break
                if full[0]:
                    held.append(batch.slice(0, full[0]))
                yield from emit(held)
                held, count = [], 0
                batch = batch.slice(full[0])
        if held:
            yield from emit(held)

    return work


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or adjoining spans of a document become one; rows come sorted by k."""
    for k, doc, b, e, f in rows.whole_groups(batches):
        order = np.lexsort((b, k))
        k, doc, b, e, f = (x[order] for x in (k, doc, b, e, f))
        _, number = np.unique(k, return_inverse=True)
        far = int(e.max()) + 1
        reach = np.maximum.accumulate(number.astype(np.int64) * far + e)
        new = np.append(True, (k[1:] != k[:-1]) | (number[1:] * far + b[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(k[at]), pa.array(b[at]), pa.array(np.maximum.reduceat(e, at)), pa.array(np.minimum.reduceat(f, at))], ["doc_id", "k", "begin_word", "end_word", "first_doc"])


def spans(docs: DataFrame, least: int = LEAST, run: int = RUN) -> DataFrame:
    """Rows (doc_id, k, begin_word, end_word, first_doc): the words of repeats, and the least doc_id where one of them is first."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), rows.row_key().alias("k"), F.lower("text").alias("text"))
    found = texts.mapInArrow(T.lean(_regions(least, run)), "doc_id bigint, k bigint, p int, w int, a bigint, r bigint")
    spread = found.repartition(tasks, "a").sortWithinPartitions("a")
    many = rows.cut(spread.mapInArrow(T.lean(_repeated), "doc_id bigint, k bigint, p int, w int, a bigint, r bigint, first boolean"))
    wanted = many.where("first").groupBy("k").agg(F.collect_list(F.struct("p", "w", "a", "r")).alias("wanted"))
    once = texts.join(rows.small(wanted, 4 * F.size("wanted")), "k").select("doc_id", "k", "text", "wanted")
    cut = once.mapInArrow(T.lean(_cut_out(least)), "a bigint, doc_id bigint, k bigint, p int, w int, words array<bigint>, r bigint")
    shards = cut.repartition(tasks, "a").sortWithinPartitions("a", "doc_id", "k", "p")
    judged = rows.cut(shards.mapInArrow(T.lean(_verdicts(least)), "a bigint, r bigint, doc_id bigint, k bigint, spans array<struct<b: int, e: int, first_doc: bigint>>, least_doc bigint"))
    own = judged.select("k", "doc_id", F.explode("spans").alias("x")).select("k", "doc_id", "x.*")
    # a region equal to an earlier one repeats throughout
    copies = many.where("not first").join(judged.select("a", "r", F.col("least_doc").alias("first_doc")), ["a", "r"])
    copies = copies.select("k", "doc_id", F.col("p").alias("b"), (F.col("p") + F.col("w") + least - 1).alias("e"), "first_doc")
    both = own.union(copies).repartition(tasks, "k").sortWithinPartitions("k")
    return both.mapInArrow(T.lean(_merge), "doc_id bigint, k bigint, begin_word int, end_word int, first_doc bigint")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text without its spans, given as the last column, word numbers [begin, end)."""
    for batch in batches:
        where = batch.schema.get_field_index("text")
        for part in T.slices(batch, where):
            raw, off = T.buffers(part.column(where))
            _, start, _, row = T.words(part.column(where))
            lists = part.column(part.num_columns - 1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            begin, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            owner = np.repeat(np.arange(len(n)), n)
            first = off[owner] + start[row[owner] + begin]
            rest = row[owner] + end < row[owner + 1]
            last = np.where(rest, off[owner] + (start[np.minimum(row[owner] + end, len(start) - 1)] if len(start) else 0), off[owner + 1])
            mark = np.zeros(len(raw) + 1, np.int32)
            np.add.at(mark, first, 1)
            np.add.at(mark, last, -1)
            keep = np.cumsum(mark[:-1]) == 0
            kept = np.append(0, np.cumsum(keep))[off].astype(np.int64)
            null = part.column(where).is_null()
            texts = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(raw[keep].tobytes())]).cast(pa.string())
            texts = pa.array(texts.to_pylist(), pa.string(), mask=null.to_numpy(zero_copy_only=False)) if part.column(where).null_count else texts
            columns = part.columns[:-1]
            columns[where] = texts
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])


def clean(docs: DataFrame, least: int = LEAST, run: int = RUN) -> DataFrame:
    """docs with the spans cut from their texts; a document of which no word is left goes. n_chars, if there, follows the text."""
    found = rows.cut(spans(docs, least, run)).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("begin_word", "end_word"))).alias("__ls_spans"))
    found = rows.small(found.select(F.col("k").alias("__ls_k"), "__ls_spans"), 2 * F.size("__ls_spans"))
    keyed = docs.withColumn("__ls_row", rows.row_key()).join(found, F.col("__ls_row") == F.col("__ls_k"), "left").drop("__ls_row", "__ls_k")
    whole = keyed.where("__ls_spans is null").drop("__ls_spans")
    cut = keyed.where("__ls_spans is not null").mapInArrow(T.lean(_without), docs.schema).where(F.col("text").rlike(f"[^{T.SEPARATORS[1:-2]}]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.union(cut)


def repeats(docs: DataFrame, least: int = LEAST, run: int = RUN) -> DataFrame:
    """Rows (doc_id, begin_word, end_word, first_doc): all spans of the documents."""
    return spans(docs, least, run).drop("k")
