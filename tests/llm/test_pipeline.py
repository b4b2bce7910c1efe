"""The pipeline's stages one after another against brute force, and its form."""

import random

import pytest

import corpus_pipeline
from loomspark.llm import mixing, ngram_join, sentencepiece_codec

from .test_ops import WORDS, brute_pairs, brute_spans, docs_of, prose, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    learnt = [f"zork{x}" for x in "abcd"]
    rows = [(k, prose(rng, rng.choice([2, 20, 90, 200])), f"s{k % 4}") for k in range(240)]
    for k in range(240, 280):
        w = prose(rng, 60).split()
        for _ in range(3):
            w.insert(rng.randint(0, 60), rng.choice(learnt))
        rows.append((k, " ".join(w), "s0"))
    passage = prose(rng, 70)
    rows += [(k, f"{prose(rng, 100)}\n{passage}\n{prose(rng, 100)}", "s1") for k in range(280, 286)]
    base = prose(rng, 200).split()
    for k in range(286, 294):
        near = list(base)
        near[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((k, " ".join(near), "s2"))
    rows += [(294, rows[5][1], "s3"), (295, None, "s3"), (296, "", "s3"), (297, passage, "s3")]
    folder = tmp_path_factory.mktemp("sf")
    docs_of(spark, rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k >= 240)) for k in range(0, 280, 2)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return rows, str(folder)


def test_stages_equal_brute_force(spark, tables):
    rows, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert name == "tokens" or docs.columns == columns
    not_toxic = [r for r in rows if not 240 <= r[0] < 280]
    assert sorted(kept[0]) == sorted(r[0] for r in not_toxic)
    pairs, copies = brute_pairs(not_toxic, ngram_join.THRESHOLD)
    groups = [set(a) | set(b) for a, b, _ in pairs] + [set(c) for c in copies]
    lost = set()
    for _ in rows:  # every group's least identifier, through chains
        for g in groups:
            for h in groups:
                if g & h:
                    g |= h
                    h |= g
        lost = {i for g in groups for i in g if i != min(g)}
    alone = [r for r in not_toxic if r[0] not in lost]
    assert sorted(kept[1]) == sorted(r[0] for r in alone)
    spans = {}
    for i, b, e, _ in brute_spans(alone, 50):
        spans.setdefault(i, []).append((b, e))
    assert set(range(280, 286)) & set(spans)
    left = {}
    for i, text, _ in alone:
        if i not in spans:
            left[i] = text
        else:
            w = [x for k, x in enumerate(words(text)) if not any(b <= k < e for b, e in spans[i])]
            if w:
                left[i] = w
    assert sorted(kept[2]) == sorted(left)
    for i, want in left.items():
        got = kept[2][i]["text"]
        assert got == want if i not in spans else words(got) == want
    assert {i: r["text"] for i, r in kept[3].items()} == {i: r["text"] for i, r in kept[2].items()}
    # mixing's positions decide the final ones; rows of one identifier have one text here
    due = {r["doc_id"]: r["position"] for r in mixing.order(spark.read.parquet(f"{folder}/repeated_passages.parquet")).collect()}
    final = sorted(kept[4].values(), key=lambda r: r["position"])
    assert [r["position"] for r in final] == list(range(len(final)))
    assert [due[r["doc_id"]] for r in final] == sorted(due.values()) and [r["doc_id"] for r in final] != sorted(kept[4])
    alone = corpus_pipeline.tokens(spark, spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), folder).collect()
    assert [(r["doc_id"], r["position"], r["exact"]) for r in alone] == [(1, None, True)]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for i, r in kept[4].items():
        text = kept[3][i]["text"]
        assert r["ids"] is None if text is None else list(r["ids"]) == library.encode(text) and r["exact"]


def test_run_equals_its_stages(spark, tables):
    rows, folder = tables
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "position", "ids", "n_tokens", "exact"] and 240 < got.count() < len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "tokens"]


def test_empty_documents_pass_all_stages(spark, tables, tmp_path):
    _, folder = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
