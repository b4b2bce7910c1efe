"""Copies with edited words are near duplicates, for the query and the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from loomspark.llm import ngram_join

from .test_ops import brute_pairs, docs_of, prose


@pytest.fixture(scope="module")
def edited():
    """Documents 0 to 39, and copies 100 to 139 with 5 to 10 % of their words replaced, at random places."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        w = prose(rng, 240).split()
        rows.append((k, " ".join(w), "s"))
        for i in rng.sample(range(240), rng.randint(12, 24)):
            w[i] = f"edit{i}x{k}"
        rows.append((100 + k, " ".join(w), "s"))
    return rows


def test_edited_copies_are_joined_and_dropped(spark, edited):
    docs = docs_of(spark, edited)
    got = {(r["doc_a"], r["doc_b"]) for r in ngram_join.linked(docs).collect()}
    assert got == {tuple(sorted((a[0], b[0]))) for a, b, _ in brute_pairs(edited, ngram_join.THRESHOLD)[0]}
    assert got <= {(k, 100 + k) for k in range(40)} and len(got) >= 36
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in edited} - {b for _, b in got})


@pytest.mark.parametrize("t", [0.6, 0.4, 0.3])
def test_sets_of_different_sizes_meet(spark, t):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        w = prose(rng, rng.randint(8, 120)).split()
        rows += [(3 * k, " ".join(w), "s"), (3 * k + 1, " ".join(w[: int(len(w) * rng.uniform(t, 1)) + 1]), "s"), (3 * k + 2, " ".join(w[: int(len(w) * t) + 3]), "s")]
    got = ngram_join.linked(docs_of(spark, rows), threshold=t).collect()
    want, _ = brute_pairs(rows, t)
    assert want and sorted((r["doc_a"], r["doc_b"], r["common"]) for r in got) == sorted((*sorted((a[0], b[0])), n) for a, b, n in want)
