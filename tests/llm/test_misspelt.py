"""Misspelt terms: which forms the labels exempt."""

import random

from loomspark.llm import toxicity

from .test_ops import docs_of, prose


def test_few_or_quoting_clean_documents_exempt_no_form(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, 40), "s") for k in range(120)]
    rows[0] = (0, rows[0][1] + " idiut", "s")
    rows[1:9] = [(k, f'{rows[k][1]} "such an idiat" {prose(rng, 3)}', "s") for k in range(1, 9)]
    rows[10:20] = [(k, f"{prose(rng, 9)} verein {prose(rng, 9)}", "s") for k in range(10, 20)]
    rows[20:25] = [(k, f"{prose(rng, 9)} scumbat {prose(rng, 9)}", "s") for k in range(20, 25)]
    rows += [(k, f"{prose(rng, 9)} scumbat {prose(rng, 9)}", "s") for k in range(120, 128)]
    rows += [(200, "you idiut, you idiat", "s"), (201, "verein verein verein", "s")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k >= 120)) for k in range(128)], "doc_id bigint, quality int, toxic int")
    assert "verein" in toxicity.learn(docs, labels)[1] and not {"idiut", "idiat"} & set(toxicity.learn(docs, labels)[1])
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    assert got[200] and not got[201] and not got[10]
