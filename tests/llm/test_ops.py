"""The operators against brute force, SQL and exact round trips, and on the defined edge cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import boost, kd_search, matroska, mixing, ngram_join, piece_model, quality, queries, resharding, sentencepiece_codec, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint, words string, shard string, position string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those inside operators."""
    full = [(i, t, "en", s, len(t) if t is not None else None, 1, "w", "s", "p") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("", "n", "rt", "s")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(30):
        rows.append((k, prose(rng, rng.choice([1, 3, 8, 40, 200])), f"s{k % 3}"))
    passage = prose(rng, 60)
    for k in range(30, 36):
        rows.append((k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}", "s0"))
    base = prose(rng, 300).split()
    for k in range(36, 46):
        near = list(base)
        for at in rng.sample(range(300), k - 36):
            near[at] = rng.choice(WORDS)
        rows.append((k, " ".join(near), "s1"))
    rows += [(46, rows[3][1], "s2"), (47, rows[3][1], "s2"), (3, rows[3][1], "s0")]  # copies; a repeated row
    rows += [(48, None, "s0"), (49, "", "s0"), (50, "  \n", None), (None, rows[4][1], "s0"), (51, "?!...", "s1")]
    rows += [(52, "for " * 3000, "s0"), (53, "ab " * 70, "s1"), (54, rows[30][1].upper() + "!", "s1")]
    rows += [(55, prose(rng, 20_000), "s2")]
    return rows


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower())


def gram_set(text, n=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 sharding


def brute_moved(old, new):
    """Fewest bytes that must move, by the definition."""
    rooms = dict(new)
    return sum(size - min(size, rooms.get(name, 0)) for name, size in old)


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(60):
        old = [(f"a{k}", rng.randint(0, 50)) for k in range(rng.randint(1, 6))]
        names = [f"a{k}" for k in range(rng.randint(0, 6))] + ["b0", "b1"]
        new = [(n, rng.randint(0, 30)) for n in names] + [("last", sum(s for _, s in old))]
        flows = resharding.plan(old, new)
        assert sum(e - b for a, c, b, e in flows if a != c) == brute_moved(old, new)
        for name, size in old:
            spans = sorted((b, e) for a, _, b, e in flows if a == name)
            assert spans[0][0] == 0 and spans[-1][1] == size and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        for name, room in new:
            assert sum(e - b for _, c, b, e in flows if c == name) <= room
    with pytest.raises(ValueError):
        resharding.plan([("a", 5)], [("a", 4)])


def test_network_finds_minimum_costs():
    rng = random.Random(4)
    for _ in range(40):
        n = 6
        net = resharding.Network(n)
        edges = [(a, b, rng.randint(0, 4), rng.randint(0, 5)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5]
        for e in edges:
            net.edge(*e)
        flow, cost = net.solve(0, n - 1)
        # an optimal flow leaves no cheaper cycle (Bellman-Ford on what is left) and no path to the sink
        far = [0] * n
        arcs = [(net.to[e ^ 1], net.to[e], net.cost[e]) for e in range(len(net.to)) if net.room[e]]
        for _ in range(n):
            for a, b, c in arcs:
                far[b] = min(far[b], far[a] + c)
        assert all(far[b] <= far[a] + c for a, b, c in arcs)
        reach = {0}
        for _ in range(n):
            reach |= {b for a, b, _ in arcs if a in reach}
        assert n - 1 not in reach and cost >= 0 and flow >= 0


def test_resharding_rewrites_affected_files(spark, corpus, tmp_path):
    assert resharding.reshard(docs_of(spark, corpus), F.col("source"), str(tmp_path / "all")).count() == len(corpus)
    some = [r for r in corpus if r[0] not in (52, 55)]
    got = resharding.reshard(docs_of(spark, some), F.col("source"), str(tmp_path / "out"))
    rows = got.collect()
    assert len(rows) == len(some) and any(r["moved"] for r in rows) and got.where("n_bytes is null").count() == 0
    moved = {r["new_shard"] for r in rows if r["moved"]} | {r["old_shard"] for r in rows if r["moved"]}
    files = spark.read.parquet(str(tmp_path / "out"))
    assert {r[0] or "" for r in files.select(resharding.FOLDER).distinct().collect()} <= moved and set(DOCS.replace(" bigint", "").replace(" string", "").split(", ")) <= set(files.columns)
    want = sorted((str(r["doc_id"]), r["new_shard"]) for r in rows if r["new_shard"] in moved)
    assert sorted((str(r["doc_id"]), r[resharding.FOLDER] or "") for r in files.collect()) == want
    assert resharding.reshard(empty(spark), F.col("source")).count() == 0


# 2 n-gram join


def brute_pairs(rows, t=0.8):
    sets = {}
    for i, text, _ in rows:
        if i is not None and text is not None and (g := gram_set(text)):
            sets.setdefault(g, []).append(i)
    out = set()
    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= t * len(a | b) - 1e-9:
            out.add((tuple(sorted(sets[a])), tuple(sorted(sets[b])), len(a & b)))
    return out, {tuple(sorted(v)) for v in sets.values() if len(v) > 1}


def brute_rows(rows, t):
    """The rows of the query, by definition."""
    pairs, copies = brute_pairs(rows, t)
    of, links = {}, {}
    for i, text, _ in rows:
        if i is not None and text is not None and (g := gram_set(text)):
            of.setdefault(g, []).append(i)
    group = {tuple(sorted(v)): {tuple(sorted(v))} for v in of.values()}
    for a, b, _ in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    out = [(i, min(min(x) for x in group[v]), len(v), links.get(v, 0)) for v in group for i in v]
    return sorted(map(str, out + [(i, None, 0, 0) for i, text, _ in rows if i is None or text is None or not gram_set(text)]))


@pytest.mark.parametrize("t, hot", [(0.8, 1000), (0.5, 1000), (0.4, 2)])
def test_ngram_join_equals_brute_force(spark, corpus, monkeypatch, t, hot):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot)
    docs = docs_of(spark, corpus)
    got = ngram_join.linked(docs, threshold=t).collect()
    want, _ = brute_pairs(corpus, t)
    assert sorted((r["doc_a"], r["doc_b"], r["common"]) for r in got) == sorted((*sorted((a[0], b[0])), n) for a, b, n in want)
    assert sorted(str(tuple(r)) for r in ngram_join.near_duplicates(docs, threshold=t).collect()) == brute_rows(corpus, t)
    assert ngram_join.near_duplicates(empty(spark)).count() == 0 and ngram_join.linked(empty(spark)).count() == 0


@pytest.mark.parametrize("tile, value", [("TILE_BYTES", 20_000), ("TILE_WORK", 30_000)])
def test_frequent_grams_and_tiles_lose_no_pair(spark, monkeypatch, tile, value):
    rng = random.Random(4)
    lines = [prose(rng, 40) for _ in range(4)]
    rows = [(k, f"{lines[k % 4]} {prose(rng, rng.randint(1, 60))}", "s") for k in range(400)]
    rows += [(400 + k, rows[k][1] + " " + prose(rng, rng.randint(0, 5)), "s") for k in range(0, 400, 5)]
    rows += [(1000, rows[7][1], "s")] * 30
    rows += [(2000 + k, " ".join(prose(rng, 20) if j != k % 3 else chain for j, chain in enumerate([prose(rng, 20)] * 3)), "s") for k in range(20)]
    base = [prose(rng, 30) for _ in range(120)]
    rows += [(3000 + k, f"{base[k]} {base[(k + 1) % 120]} {prose(rng, 6)}", "s") for k in range(120)]  # a long chain of lists
    want, _ = brute_pairs(rows, 0.4)
    for name, value in (("HOT_LEAST", 50), (tile, value), ("GATHER", 5000)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = docs_of(spark, rows)
    assert len(ngram_join.members(docs)[2]) > 30
    got = ngram_join.linked(docs, threshold=0.4).collect()
    assert sorted((r["doc_a"], r["doc_b"], r["common"]) for r in got) == sorted((*sorted((a[0], b[0])), n) for a, b, n in want)
    assert sorted(str(tuple(r)) for r in ngram_join.near_duplicates(docs, threshold=0.4).collect()) == brute_rows(rows, 0.4)


def test_keep_one_keeps_the_first_of_each_group(spark, corpus):
    kept = ngram_join.keep_one(docs_of(spark, corpus))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want, copies = brute_pairs(corpus, ngram_join.THRESHOLD)
    groups = [set(itertools.chain(*x[:2])) for x in want] + [set(c) for c in copies]
    merged = []
    for g in groups:
        for m in [m for m in merged if m & g]:
            merged.remove(m)
            g = g | m
        merged.append(g)
    lost = {i for g in merged for i in g if i != min(g)}
    everyone = [i for i, _, _ in corpus]
    assert sorted(map(str, ids)) == sorted(map(str, [i for i in dict.fromkeys(everyone) if i not in lost]))
    assert kept.columns == docs_of(spark, corpus).columns and ngram_join.keep_one(empty(spark)).count() == 0


def test_groups_in_one_task_and_in_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 30), (30, 25), (7, 3), (50, 50)], "ca bigint, cb bigint")
    for most in (100, 0):
        monkeypatch.setattr(ngram_join, "ONE_TASK", most)
        assert sorted(map(tuple, ngram_join.components(edges).collect())) == [*((k, 0) for k in range(10)), (20, 20), (25, 20), (30, 20), (50, 50)]
        assert ngram_join.components(edges.limit(0)).count() == 0


def test_one_identifier_with_different_texts(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "s"), (1, b, "s"), (2, a + " end", "s"), (3, b + " end", "s")]
    got = ngram_join.linked(docs_of(spark, rows)).collect()
    assert sorted((r["doc_a"], r["doc_b"]) for r in got) == [(1, 2), (1, 3)]
    assert sorted(r["text"] for r in ngram_join.keep_one(docs_of(spark, rows)).collect()) == sorted([a, b])


# 3 nearest neighbours


@pytest.mark.parametrize("shard", [40, 10_000])
def test_top_k_equals_brute_force(spark, shard):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(120, 6)), np.repeat(rng.normal(size=(3, 6)), 8, 0), rng.normal(size=(40, 6)) * 0.01 + 3])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    bad = [(900, None, 0), (None, [1.0] * 6, 0), (901, [1.0] * 5, 0), (902, [float("nan")] * 6, 0), (903, [], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, shard bigint")
    got = kd_search.top_k(df, k=5, shard=shard).toPandas().sort_values(["vec_id", "rank"])
    y = x.astype(np.float32).astype(float)
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.array([np.lexsort((np.arange(len(y)), row))[:5] for row in d])
    assert (got["neighbour"].to_numpy().reshape(len(x), 5) == want).all()
    some = kd_search.top_k(df, k=5, shard=shard, asked=F.col("vec_id") % 7 == 0).toPandas().sort_values(["vec_id", "rank"])
    assert (some["vec_id"].to_numpy()[::5] % 7 == 0).all() and (some["neighbour"].to_numpy().reshape(-1, 5) == want[::7]).all()
    assert kd_search.top_k(df, asked=F.lit(False)).count() == 0
    assert kd_search.top_k(df.limit(0)).count() == 0 and kd_search.top_k(df.where("vec_id < 3"), k=5).count() == 6


# 4 quality


def test_rules_classify_held_out_documents(spark):
    rng = random.Random(3)
    good = [(k, prose(rng, rng.randint(20, 200)).capitalize() + ".", "s") for k in range(300)]
    junk = [(300 + k, " ".join(w + rng.choice(["%%%", "&&&", "***"]) for w in prose(rng, rng.randint(20, 200)).split()), "s") for k in range(100)]
    junk += [(400 + k, "!! ".join(prose(rng, 60).upper().split()), "s") for k in range(100)]
    docs = docs_of(spark, good + junk + [(None, "", "s"), (900, None, "s")])
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 500, 2)] + [(None, 1, 0), (4, None, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.quality(docs, labels).collect()}
    held = range(1, 500, 2)
    assert len(got) == 502 and sum(got[k] == (k < 300) for k in held) / len(held) > 0.97
    kept = {r["doc_id"] for r in quality.clean(docs, labels).collect()}
    assert {k for k, v in got.items() if v} == kept
    model = quality.fit(docs, labels)
    names = list(quality.statistics())
    table = quality.measured(docs, "doc_id").select("*", model.column().alias("score")).toPandas()
    assert 0 < len(model.rules) and np.allclose(table["score"], model.score(table[names].to_numpy(), names))
    assert quality.quality(docs, labels.limit(0)).where("keep").count() == 502 and quality.quality(empty(spark), labels).count() == 0


def test_boosting_fits_and_lasso_is_sparse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    base, trees = boost.fit(x[:1000], y[:1000])
    assert ((boost.score(x[1000:], base, trees) > 0.5) == y[1000:]).mean() > 0.97
    w = quality.lasso((x > 0).astype(float), y, 0.05)
    assert (w[3:] == 0).all() and w[1] > 0


# 5 suffix arrays


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(400):
        x = np.array([rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(1, 40))])
        sa = suffix_dedup.suffix_array(x)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        plcp = suffix_dedup.permuted_prefixes(x, sa)
        for b, a in zip(sa, sa[1:]):
            n = next((k for k in range(len(x)) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]), len(x))
            assert plcp[a] == n


def brute_spans(rows, least):
    seen, again = {}, {}
    each = sorted({(i, t) for i, t, _ in rows if i is not None and t is not None})
    for i, t in each:
        w = words(t)
        for at in range(len(w) - least + 1):
            key = tuple(w[at : at + least])
            if key in seen:
                again.setdefault((i, t), []).append((at, seen[key]))
            else:
                seen[key] = i
    out = []
    for (i, _), hits in again.items():
        begin, end, first = hits[0][0], hits[0][0] + least, hits[0][1]
        for at, f in hits[1:]:
            if at > end:
                out.append((i, begin, end, first))
                begin, first = at, f
            end, first = at + least, min(first, f)
        out.append((i, begin, end, first))
    return sorted(out)


@pytest.mark.parametrize("least, run", [(50, 8), (12, 4)])
def test_repeats_equal_brute_force(spark, corpus, monkeypatch, least, run):
    monkeypatch.setattr(suffix_dedup, "SHARD_WORDS", 500)
    got = sorted(tuple(r) for r in suffix_dedup.repeats(docs_of(spark, corpus), least, run).select("doc_id", "begin_word", "end_word", "first_doc").collect())
    assert got == brute_spans(corpus, least)
    assert suffix_dedup.repeats(empty(spark)).count() == 0


def test_repeats_are_cut_from_texts(spark, corpus):
    docs = docs_of(spark, corpus)
    got = suffix_dedup.clean(docs)
    assert got.columns == docs.columns and suffix_dedup.clean(empty(spark)).count() == 0
    after = {(r["doc_id"]): r for r in got.collect()}
    spans = {}
    for i, b, e, _ in brute_spans(corpus, 50):
        spans.setdefault(i, []).append((b, e))
    for i, text, _ in corpus:
        if i not in spans:
            assert after[i]["text"] == text
            continue
        left = [w for k, w in enumerate(words(text)) if not any(b <= k < e for b, e in spans[i])]
        assert (words(after[i]["text"]) if i in after else []) == left
        assert i not in after or after[i]["n_chars"] == len(after[i]["text"])


# 6 pieces


def test_pieces_equal_the_library_and_round_trip(spark, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = random.Random(8)
    letters = "abcdeéthinger  \n\tßüñ你好🙂.,-_=012 "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(800)] + ["", " ", "    x", "a" * 900, "你" * 500, "x" * 401 + " y", " " * 40 + "z "]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "a b", "s"), (5000, None, "s")]
    docs = docs_of(spark, rows)
    got = sentencepiece_codec.encoded(docs)
    found = {r["doc_id"]: r for r in got.collect()}
    assert [list(found[k]["ids"]) for k in range(len(texts))] == library.encode(texts)
    assert all(found[k]["exact"] and found[k]["n_tokens"] == len(found[k]["ids"]) for k in range(len(texts)))
    assert found[5000]["ids"] is None and found[5000]["exact"] is None
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decoded(got).collect()}
    assert [back[k] for k in range(len(texts))] == texts and back[5000] is None
    assert sentencepiece_codec.encoded(empty(spark)).count() == 0


def test_unigram_lattice_equals_brute_force():
    pieces = {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.2, "▁a": -2.0, "ba": -1.9, "abab": -3.0, "▁ab": -3.3}
    t = piece_model.tables(sentencepiece_codec.MODEL)
    numbers = sorted(pieces, key=piece_model._hash)
    own = {k: getattr(t, k) for k in t.__dataclass_fields__}
    prefixes = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}, key=piece_model._hash)
    slots, spill = np.zeros_like(t.slots), np.zeros_like(t.spill)
    hashes = np.array([piece_model._hash(p) for p in prefixes], np.uint64)
    slots[(hashes >> np.uint64(64 - piece_model.SLOT_BITS)).astype(int)] = np.arange(len(prefixes))
    own |= {
        "hashes": np.array([piece_model._hash(p) for p in numbers], np.uint64), "length": np.array([len(p) for p in numbers]), "piece_id": np.arange(len(numbers), dtype=np.int32), "score": np.array([pieces[p] for p in numbers]),
        "alive": np.ones(len(numbers), bool), "prefixes": hashes, "prefix_piece": np.array([numbers.index(p) if p in pieces else -1 for p in prefixes], np.int32), "slots": slots, "spill": spill, "bpe": False,
    }
    coder = sentencepiece_codec.Encoder(piece_model.Tables(**own))
    for text in ("▁ab", "▁abab", "▁bababab", "▁aabb"):
        found, _ = coder.viterbi(np.array([ord(c) for c in text], np.int64), np.array([0, len(text)]))

        def best(s):
            return 0.0 if not s else max((pieces[s[:n]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in pieces), default=-np.inf)

        assert np.isclose(sum(pieces[numbers[x]] for x in found), best(text)) and "".join(numbers[x] for x in found) == text


# 7 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distances():
    terms = {"idiot": (1.0, 1), "pathetic": (1.0, 1), "disgusting": (1.0, 2), "scum": (1.0, 0), "idol": (1.0, 0)}
    a = toxicity.build(terms)
    rng = random.Random(6)
    tried = []
    for word in terms:
        for _ in range(300):
            w = list(word)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", *"aeiostdgx"])
            if w:
                tried.append("".join(w))
    row, _, _, weight, _ = toxicity.matches(a, pa.array(tried))
    got = dict(zip(row, weight))
    for k, w in enumerate(tried):
        want = max([toxicity.EDIT_WEIGHT ** distance(w, t) for t, (_, e) in terms.items() if distance(w, t) <= e], default=0.0)
        assert np.isclose(got.get(k, 0.0), want), w


def test_toxic_documents_are_found_and_quotations_spared(spark):
    rng = random.Random(9)
    learnt = [f"zork{x}" for x in "abcdef"]
    clean = [(k, prose(rng, 40), "s") for k in range(200)]
    toxic = []
    for k in range(200, 260):
        w = prose(rng, 40).split()
        for _ in range(3):
            w.insert(rng.randint(0, 40), rng.choice(learnt))
        toxic.append((k, " ".join(w), "s"))
    odd = [(300, "You stupd idiott and moron", "s"), (301, 'He said "idiot" and "moron" there', "s"), (302, "a clown came", "s"), (303, None, "s"), (304, "", "s"), (None, "idiot moron scum", "s"), (305, ("fine " * 9000) + "scum and trash", "s"), (305, ("fine " * 9000) + "scum and trash", "s")]
    docs = docs_of(spark, clean + toxic + odd)
    labels = spark.createDataFrame([(k, 1, int(k >= 200)) for k in range(0, 260, 2)] + [(None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    words_, _ = toxicity.learn(docs, labels)
    assert set(learnt) <= set(words_)
    got = toxicity.toxicity(docs, labels).collect()
    bad = {r["doc_id"] for r in got if r["toxic"]}
    assert len(got) == len(clean + toxic + odd) and bad == {*range(200, 260), 300, None, 305}
    kept = toxicity.clean(docs, labels)
    assert sorted(map(str, [r["doc_id"] for r in kept.select("doc_id").collect()])) == sorted(map(str, [*range(200), 301, 302, 303, 304])) and kept.columns == docs.columns
    assert toxicity.clean(docs, labels.limit(0)).count() > 0 and toxicity.toxicity(empty(spark), labels).count() == 0


# 8 Matroska


def test_matroska_round_trip_and_damage(spark, corpus):
    rng = random.Random(3)
    for _ in range(60):
        frames = [(rng.choice([1, 1, 1, 2, 300]), 40 * k, bytes(rng.choice([5, 0, rng.randint(0, 700)]))) for k in range(rng.randint(0, 120))]
        data = matroska.mux(frames)
        found = matroska.packets(data)
        assert [(p.track, p.timestamp_ns // 10**6, data[p.begin : p.end]) for p in found] == frames
        assert all(found[c].cue for c in range(0, len(frames), 32))
        for n in (0, 10, len(data) // 2, len(data) - 3):
            part = matroska.packets(data[:n])
            whole = [p for p in found if p.end <= n]
            assert [(*p[:4], *p[8:]) for p in part] == [(*p[:4], *p[8:]) for p in found[: len(part)]]
            assert len(part) == len(whole) or whole[len(part)].lacing != "none"  # the laced block is cut off
        matroska.packets(bytes(rng.randrange(256) for _ in range(300)))
    media = matroska.text_media(docs_of(spark, corpus))
    table = matroska.packet_table(media, "doc_id")
    sliced = table.join(media.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "packet", F.expr("cast(substring(media, cast(begin as int) + 1, cast(end - begin as int)) as string)").alias("t")).dropDuplicates(["doc_id", "packet"]).collect()
    lines = {}
    for r in sorted(sliced, key=lambda r: (r["doc_id"], r["packet"])):
        lines.setdefault(r["doc_id"], []).append(r["t"])
    for i, text, _ in corpus:
        if i is not None:
            assert "\n".join(lines.get(i, [])) == (text or "")
    assert table.where("doc_id = 48").count() == 0 and matroska.packet_table(matroska.text_media(empty(spark)), "doc_id").count() == 0


def test_matroska_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 7, b"c" * 510]
    for kind in (1, 3):
        data = matroska.laced(frames, kind)
        assert [data[a:b] for a, b in matroska.laces(data, 0, len(data), kind)] == frames
    cluster = matroska.element(matroska.TIME, b"\x05") + matroska.element(matroska.SIMPLE, b"\x81\x00\x02\x80xyz")
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    head = matroska.CLUSTER.to_bytes(4, "big") + unknown
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + unknown + head + cluster + head + cluster
    assert [(p.timestamp_ns, data[p.begin : p.end]) for p in matroska.packets(data)] == [(7_000_000, b"xyz")] * 2


# 9 URLs


def test_url_filter_on_held_out_urls(spark):
    rng = random.Random(5)
    urls = []
    for k in range(600):
        bad = k % 3 == 0
        host = f"{rng.choice(['win', 'free', 'best'])}-{rng.choice(['casino', 'pills', 'bets'])}{rng.randint(1, 99)}.{rng.choice(['xyz', 'top'])}" if bad else f"www.{rng.choice(WORDS)}{rng.choice(WORDS)}.{rng.choice(['org', 'com'])}"
        urls.append((k, f"http://{host}/{rng.choice(WORDS)}/{rng.randint(1, 9999)}" + ("?a=1&b=2" if bad else ""), int(bad)))
    labelled = spark.createDataFrame([(u, y) for k, u, y in urls if k % 2] + [(None, 1), ("x", None)], "url string, label int")
    pages = spark.createDataFrame([(k, u, "h") for k, u, _ in urls] + [(None, None, "h"), (901, "", "h"), (902, "::::?//é", "h"), (903, "http://x/" + "a" * 50_000, "h")], "page_id bigint, url string, score string")
    got = {r["page_id"]: r["keep"] for r in url_filter.url_filter(pages, labelled).collect()}
    held = [(k, y) for k, _, y in urls if k % 2 == 0]
    assert sum(got[k] == (y == 0) for k, y in held) / len(held) > 0.97 and {None, 901, 902, 903} <= set(got)
    assert url_filter.url_filter(pages, labelled.limit(0)).where("keep").count() == 604
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    broken = spark.sql("select 1L page_id, cast(unhex('61FF62') as string) url union all select 2L, 'http://a.b/c'")
    assert url_filter.url_filter(broken, broken.select("url", (F.col("page_id") - 1).cast("int").alias("label"))).count() == 2
    assert spark.createDataFrame([("http://www.casino-x.com/",), ("http://a.com/casino",), (None,)], "url string").select(url_filter.seeded()).collect() == [(1,), (0,), (None,)]


# 10 mixing


def test_positions_follow_the_schedules(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randint(1, 30)), "big" if k % 4 else "small") for k in range(800)]
    docs = docs_of(spark, rows)
    schedules = mixing.Schedules(given=(("big", 1.0, 0.0), ("small", 0.0, 1.0)))
    got = mixing.curriculum(docs, schedules, epochs=1.0).toPandas()
    total = sum(len(t.split()) for _, t, _ in rows)
    for part in range(5):  # in the middle of each fifth the sources have the weights that are due there
        here = got[(got["position"] >= total * part / 5) & (got["position"] < total * (part + 1) / 5)]
        share = here.loc[here["source"] == "small", "tokens"].sum() / here["tokens"].sum()
        assert abs(share - (part + 0.5) / 5) < 0.06
    assert got["pass"].max() >= 1 and (got["position"] < total).all()
    once = mixing.mix(docs.repartition(7), schedules)
    assert sorted(r["doc_id"] for r in once.collect()) == list(range(800)) and once.columns == docs.columns
    again = mixing.curriculum(docs.repartition(9), schedules, epochs=1.0).toPandas()
    key = ["doc_id", "pass"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))


def test_mixing_edge_cases(spark, corpus):
    docs = docs_of(spark, corpus)
    for got in (mixing.mix(docs), mixing.curriculum(docs)):
        assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, _, _ in corpus)
    assert mixing.curriculum(docs, epochs=2.0).count() > len(corpus)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.curriculum(empty(spark), epochs=1.0).count() == 0


# registered SQL


def plain(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(plain(r) for r in got.select(*columns).collect()) == sorted(map(plain, expected))
