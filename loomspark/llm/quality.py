"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are fitted to a bounded sample of labelled documents; each path from a root to a node is a rule, a
conjunction of thresholds. A logistic model with a lasso penalty (accelerated proximal gradient, its
strength chosen on held-out rows) keeps few of them, and these are compiled into one Spark column
expression: the statistics, the rules and the score are computed in the JVM, without Python.

Defined cases: a null or empty text has all statistics 0 and is judged by them; repeated rows are judged alike;
a null doc_id is carried; labels without a document, null labels and labels that contradict each other
(the least quality counts) are handled; with no labels, or one kind only, every document is kept with
the constant score; an empty table gives no rows; other columns are carried along whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost, rows

#: Most labelled documents that the model is fitted to; beyond it, those of the lowest key hashes.
TRAIN_ROWS = 20_000
#: Documents of a lower score are of low quality.
LIMIT = 0.5


def _runs(pattern: str) -> Column:
    return F.regexp_count("__ls_t", F.lit(pattern))


def _times(mark: str) -> Column:
    return F.length("__ls_t") - F.length(F.replace(F.col("__ls_t"), F.lit(mark), F.lit("")))


def statistics() -> dict[str, Column]:
    """Statistics of a text __ls_t with __ls_n words; each is a number."""
    n = F.greatest(F.col("__ls_n"), F.lit(1))
    chars = F.greatest(F.length("__ls_t"), F.lit(1))
    lines = F.split("__ls_t", "\n")
    return {
        "words": F.least(F.col("__ls_n"), F.lit(1_000_000)).cast("double"),
        "word_length": F.length("__ls_t") / n,
        "different_words": F.size(F.array_distinct(F.split("__ls_t", " "))) / n,
        "different_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.length("__ls_t") / F.size(lines),
        "capital_words": _runs(r"\p{Lu}{2,}") / n,
        "symbol_runs": _runs(r"[^\p{L}\p{N}\s.,]+") / n,
        "digit_runs": _runs(r"[0-9]+") / n,
        "exclamations": _times("!") / chars,
        "bars": _times("|") / chars,
        "stops": (_times(".") + _times(",")) / n,
        "spaces": _times(" ") / chars,
    }


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the statistics of each document."""
    text = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__ls_t"))
    text = text.withColumn("__ls_n", _runs(r"\S+"))
    return text.select(*keep, *[c.cast("double").alias(name) for name, c in statistics().items()])


Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = None
            for name, sign, at in rule:
                one = F.col(name) <= at if sign == "<=" else F.col(name) > at
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """The same in numpy."""
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * _holds(rule, x, names)
        return boost.sigmoid(z)


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, at in rule:
        column = x[:, names.index(name)]
        out &= column <= at if sign == "<=" else column > at
    return out


def paths(trees: list[boost.Tree], names: list[str]) -> list[Rule]:
    """Each tree's paths from the root to its nodes, with one bound a side for each statistic, without repeats."""
    found: dict[Rule, None] = {}
    for tree in trees:
        work: list[tuple[int, dict[tuple[str, str], float]]] = [(0, {})]
        while work:
            node, bounds = work.pop()
            if bounds:
                found[tuple((name, sign, at) for (name, sign), at in sorted(bounds.items()))] = None
            if tree.feature[node] >= 0:
                name, at = names[tree.feature[node]], tree.threshold[node]
                low, high = (name, "<="), (name, ">")
                work.append((tree.left[node], bounds | {low: min(at, bounds.get(low, np.inf))}))
                work.append((tree.right[node], bounds | {high: max(at, bounds.get(high, -np.inf))}))
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Weights (bias first) that minimise the mean logistic loss and strength times the others' sum of magnitudes."""
    x = np.concatenate([np.ones((len(r), 1)), r], 1)
    size = 0.25 * np.linalg.norm(x, 2) ** 2 / len(x)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = x.T @ (boost.sigmoid(x @ v) - y) / len(x)
        new = v - g / size
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - strength / size, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < 1e-4
        w, t = new, t2
        if done:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 1) -> Model:
    """A model of statistics x and labels y (1 is good)."""
    if len(y) == 0 or y.min() == y.max():
        return Model(6.0, ())
    _, trees = boost.fit(x, y, trees=30, depth=3, rate=0.3, bins=48, least=max(5, len(y) // 400), seed=seed)
    rules = paths(trees, names)
    hold = np.random.default_rng(seed).random(len(y)) < 0.25
    r = np.stack([_holds(rule, x, names) for rule in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    share = r.mean(0)
    use = (share > 0.002) & (share < 0.998)
    rules, r = [rule for rule, u in zip(rules, use) if u], r[:, use]
    scale = np.sqrt(r.mean(0) * (1 - r.mean(0)))
    r = r / scale
    best, w = np.inf, None
    for strength in (0.01, 0.003, 0.001, 0.0003):
        w = lasso(r[~hold], y[~hold], strength, w)
        p = np.clip(boost.sigmoid(np.concatenate([np.ones((hold.sum(), 1)), r[hold]], 1) @ w), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[hold] * np.log(p) + (1 - y[hold]) * np.log(1 - p)) if hold.any() else 0.0
        if loss < best * 0.98:
            best, chosen = loss, strength
    w = lasso(r, y, chosen, w)
    kept = [(rule, float(c / s)) for rule, c, s in zip(rules, w[1:], scale) if abs(c) > 1e-6]
    return Model(float(w[0]), tuple(kept))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    names = list(statistics())
    # joined with texts by one copy of each labelled document
    got = measured(sample, "doc_id", "good").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return train(got[names].to_numpy(float), (got["good"].to_numpy() > 0).astype(float), names)


def quality(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """A row (doc_id, score, keep) for every document."""
    model = fit(docs, labels)
    return measured(docs, "doc_id").select("doc_id", F.round(model.column(), 6).alias("score")).withColumn("keep", F.col("score") >= limit)


def clean(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """docs less those of low quality."""
    keyed = docs.select(rows.row_key().alias("k"), "text")
    bad = measured(keyed, "k").where(F.round(fit(docs, labels).column(), 6) < limit).select("k").distinct()
    return rows.without(docs, rows.cut(bad))
