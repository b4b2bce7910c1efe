import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import dedup, gates, grounding, split, storage


def vector(text, dim):
    import hashlib

    out = np.zeros(dim)
    for w in text.lower().split():
        h = hashlib.sha1(w.encode()).digest()
        out[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] % 2 == 0 else -1
    return out


def greedy(texts, threshold, dim):
    kept, flags = [], []
    for t in texts:
        v = vector(t, dim)
        n = v @ v
        ok = n == 0 or all(v @ k < threshold * np.sqrt(n * (k @ k)) for k in kept)
        flags.append(ok)
        if ok and n:
            kept.append(v)
    return flags


@pytest.mark.parametrize("threshold, dim, block", [(0.5, 64, 4096), (0.75, 128, 16), (0.92, 256, 4096)])
def test_diversity_equals_the_sequential_filter(spark, monkeypatch, threshold, dim, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rng = random.Random(dim)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(80)]
    df = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "at bigint, text string")
    got = {r["at"]: r["accepted"] for r in dedup.diversity(df, "at", "text", threshold, dim).collect()}
    assert [got[3 * k] for k in range(80)] == greedy(texts, threshold, dim)


def test_diversity_of_vectors_and_bounds(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "at bigint, v array<float>")
    got = {r["at"]: r["accepted"] for r in dedup.vector_diversity(df, "at", "v", 0.9).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True}
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            dedup.check_threshold(bad)


def test_similar_blocks_are_multiplied_in_strips():
    n, dim = 4096, 64
    x = np.random.default_rng(1).normal(size=(n, dim))
    block = pd.DataFrame({"at": np.arange(n), "buckets": [np.arange(dim)] * n, "counts": list(x), "block": 0})
    tracemalloc.start()
    got = dedup._similar(0.4, dim)(block, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == np.count_nonzero(np.triu(unit @ unit.T >= 0.4, 1)) and (got["early"] < got["late"]).all()
    assert peak < 64e6


def test_vectors_that_stay_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 32)
    monkeypatch.setattr(dedup, "similar_pairs", None)
    x = np.random.default_rng(2).normal(size=(200, 8)).astype("float32")
    x[150:] = x[50:100]
    df = spark.createDataFrame([(7 * k, v.tolist()) for k, v in enumerate(x)], "at bigint, v array<float>").repartition(5)
    got = {r["at"]: r["accepted"] for r in dedup.vector_diversity(df, "at", "v", 0.6).collect()}
    kept = []
    for k, v in enumerate(x.astype(float)):
        stays = all(v @ w < 0.6 * np.sqrt((v @ v) * (w @ w)) for w in kept)
        kept += [v] * stays
        assert got[7 * k] == stays


def test_grounding_and_rescue(spark):
    df = spark.createDataFrame([(0, "river water flows", "the river water flows on"), (1, "zebra", "bread"), (2, "", "bread")], "k int, o string, r string")
    got = {r["k"]: r for r in grounding.ground(df, "k", "o", "r", 0.5).collect()}
    assert [got[k]["grounded"] for k in range(3)] == [True, False, False] and got[0]["semantic"] is None
    got = {r["k"]: r for r in grounding.ground(df, "k", "o", "r", 1.1, 0.1).collect()}
    assert got[0]["grounded"] and got[0]["semantic"] > 0.5 and got[2]["semantic"] == 0
    same = grounding.semantic_scores(df.select("k", F.col("r").alias("o"), "r"), "k", "o", "r", 64).collect()
    assert all(r["semantic"] >= 0.99 for r in same)


def test_split(spark):
    items = spark.range(100).withColumnRenamed("id", "k")
    a, b = (split.train_eval_split(items.repartition(n), "k").where("part = 'eval'").select("k").collect() for n in (1, 5))
    assert len(a) == 10 and sorted(a) == sorted(b)
    assert split.train_eval_split(items, "k", 0.5, max_eval=5).where("part = 'eval'").count() == 5
    assert [split.eval_size(n, 0.1) for n in (0, 1, 2, 3, 25)] == [0, 0, 1, 1, 2]
    assert split.train_eval_split(items.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        split.eval_size(3, 1.0)


def test_rows_are_numbered_in_order(spark):
    got = storage.number_rows(spark.range(1000).repartition(7), [F.col("id")], "n").collect()
    assert all(r["n"] == r["id"] for r in got) and len(got) == 1000


def test_gates_and_target(spark):
    decisions = ["kept", "judge_rejected", "kept", "diversity_rejected", "kept", "kept"]
    df = spark.createDataFrame(list(enumerate(decisions)), "cand_idx int, decision string")
    of = lambda d: [r["decision"] for r in d.orderBy("cand_idx").collect()]
    assert of(gates.stop_at(df, "cand_idx", 2)) == decisions[:3] + ["unexamined"] * 3
    assert of(gates.stop_at(df, "cand_idx", 2, "reject")) == decisions[:4] + ["overflow"] * 2
    assert of(gates.stop_at(df, "cand_idx", 9)) == decisions
    s = gates.stats(gates.stop_at(df, "cand_idx", 2, "reject"), 7).first()
    assert (s["seeds"], s["generated"], s["judged"], s["kept"], s["judge_rejected"], s["diversity_rejected"]) == (7, 6, 5, 2, 1, 1)


def test_embeddings_are_unit_vectors_and_fall_back(spark):
    from loomspark.functions import text as X
    from loomspark.operators import embedding

    df = spark.createDataFrame([(0, "a b c d"), (1, ""), (2, "a b c d")], "k bigint, t string")
    with pytest.warns(UserWarning):
        got = {r["k"]: np.array(r["vector"]) for r in embedding.vectors(df, "k", "t", "some-model", 64).collect()}
    assert np.isclose(np.linalg.norm(got[0]), 1) and not got[1].any() and (got[0] == got[2]).all()
    want = vector("a b c d", 64)
    assert np.allclose(got[0], want / np.linalg.norm(want))
    same = grounding.model_scores(df.withColumn("r", F.col("t")), "k", "t", "r", "hash").collect()
    assert {r["k"]: r["semantic"] for r in same} == {0: 1.0, 1: 0.0, 2: 1.0}
