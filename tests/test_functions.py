import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import keys, replies
from loomspark.functions import text as X
from loomspark.operators import chunking


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


def test_normalize_collapses_blanks_and_lines(spark):
    assert one(spark, X.normalize(F.col("t")), t="  a \t b  \n\n\n\nc\r\nd  ") == "a b\n\nc\nd"
    assert one(spark, X.normalize(F.col("t")), t=" \n\t ") == ""
    assert one(spark, X.normalize(F.col("t")), t=None) is None


def test_sentences(spark):
    assert one(spark, X.split_sentences(F.col("t")), t="One here. Two now! Élan? no. 3 left") == ["One here.", "Two now!", "Élan? no.", "3 left"]


def test_chunks_cover_overlap_and_are_unique(spark):
    text = " ".join(f"Sentence number {k} is here." for k in range(50))
    got = chunking.chunk_text(spark.createDataFrame([("s", text)], "source string, text string"), "source", target_chars=200, overlap_chars=30).orderBy("index").collect()
    assert len(got) >= 3 and all(len(r.text) <= 320 for r in got) and len({r.id for r in got}) == len(got)
    for a, b in zip(got, got[1:]):
        assert b.text.split(". ")[0] in a.text
    assert chunking.chunk_text(spark.createDataFrame([("s", " \n ")], "source string, text string"), "source").count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_text(spark.createDataFrame([("s", "x")], "source string, text string"), "source", target_chars=0)


def sequential_chunks(lengths, target, overlap):
    out, buffer, size = [], [], 0
    for k, n in enumerate(lengths):
        if size + n + 1 > target and buffer:
            out.append((buffer[0], buffer[-1] + 1))
            tail, cost = [], 0
            for s in reversed(buffer):
                if cost + lengths[s] + 1 > overlap:
                    break
                tail.insert(0, s)
                cost += lengths[s] + 1
            buffer, size = tail, cost
        buffer.append(k)
        size += n + 1
    return out + ([(buffer[0], buffer[-1] + 1)] if buffer else [])


def test_chunk_bounds_equal_a_sequential_fold(spark):
    import random

    rng = random.Random(5)
    cases = [[rng.choice([5, 20, 60, 300]) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, n array<int>")
    got = {r.k: [(x.a, x.b) for x in r.b] for r in df.select("k", chunking.chunk_bounds(F.col("n"), 150, 60).alias("b")).collect()}
    assert got == {k: sequential_chunks(c, 150, 60) for k, c in enumerate(cases)}


@pytest.mark.parametrize(
    "raw, want",
    [('```json\n[1, 2]\n```', "[1, 2]"), ('well {"a": 1} then', '{"a": 1}'), ("nothing", None), ('[note] {"a":1}', "[note]"), ("", None)],
)
def test_json_blob(spark, raw, want):
    assert one(spark, replies.json_blob(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('["Explain it well", "no", " Another task here "]', ["Explain it well", "Another task here"]),
        ('[{"instruction": "", "question": "What is this?"}, {"prompt": "Tell me more"}, 7]', ["What is this?", "Tell me more"]),
        ('{"a": 1}', []), ("garbage", []), (None, []),
    ],
)
def test_seeds(spark, raw, want):
    assert one(spark, replies.seeds(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"score": 8.5, "reason": " fine "}', (8, "fine")), ('{"score": 9.5}', (10, "")), ('{"score": "8"}', (8, "")), ('{"score": true}', (1, "")), ('{"score": null, "reason": null}', (0, "None")),
        ('{"score": 99}', (10, "")), ('{"score": -3}', (0, "")), ('{"score": "x"}', (0, "")), ("no", (0, "unparseable judge response")), ("[1]", (0, "unparseable judge response")),
    ],
)
def test_verdict(spark, raw, want):
    assert tuple(one(spark, replies.verdict(F.col("t")), t=raw)) == want


@pytest.mark.parametrize(
    "raw, want",
    [("Rewritten: \"Explain trees in depth\"", "Explain trees in depth"), ("EXPLAIN TREES", None), ("hi", None), ("x" * 801, None), ("  ", None), (None, None), ("instruction: Compare trees now", "Compare trees now")],
)
def test_evolution(spark, raw, want):
    assert one(spark, replies.evolution(F.col("t"), F.lit(" explain trees ")), t=raw) == want


def talk(*roles, content="hi"):
    return json.dumps({"messages": [{"role": r, "content": content} for r in roles]})


@pytest.mark.parametrize(
    "raw, n",
    [(talk("user", "assistant", "user", "assistant"), 4), (talk("user", "user"), None), (talk("user", "assistant", "user"), None), (talk("user", "assistant", content=" "), None), ("x", None), (talk(*["user", "assistant"] * 3), 4), (talk("User ", "ASSISTANT"), 2)],
)
def test_dialogue(spark, raw, n):
    got = one(spark, replies.dialogue(F.col("t"), 4), t=raw)
    assert (None if got is None else len(got)) == n


def test_overlap(spark):
    score = X.overlap_score(F.col("a"), F.col("b"))
    assert one(spark, score, a="Rivers carry fresh water", b="Fresh water rivers carry it") > 0.7
    assert one(spark, score, a="Quantum chips", b="Bread recipe") < 0.2
    assert one(spark, score, a="", b="x") == 0 == one(spark, score, a="words", b=None)


def test_keys(spark):
    key = lambda t: keys.cache_key(F.lit("m"), F.lit(t), F.lit(10), F.lit(None).cast("string"), F.col("p"))
    assert one(spark, key(0.7), p="x") == one(spark, key(0.70000), p="x") != one(spark, key(0.8), p="x")
    assert one(spark, keys.language_code(F.col("p")), p=" Italian ") == "it" and one(spark, keys.language_code(F.col("p")), p="klingon") == "en"
    got = [keys.size_bucket(F.lit(n)) for n in (999, 1000, 10_000, 100_000, 1_000_000)]
    assert list(spark.range(1).select(*got).first()) == ["n<1K", "1K<n<10K", "10K<n<100K", "100K<n<1M", "n>1M"]
    a, b = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in ("abc", "cba"))
    assert keys.ids_hash(a, "id") == keys.ids_hash(b, "id") == keys.ids_hash(a, "id", at_once=1) != keys.ids_hash(a.limit(2), "id")
    assert keys.slug("  Hello, World! ") == "hello--world" and keys.slug("!!") == "run"
