"""Exact nearest neighbours of all vectors, or of those asked for, by KD-trees, one a shard.

Vectors are put into spatial shards by the median splits of a bounded sample (the result doesn't depend on
them, only the pruning does). Each shard is a KD-tree: median splits on the widest dimension down to leaves of
LEAF vectors, every node with the tight bounding box of what it holds. First each shard answers its own queries
best-first: of the nodes that wait, the one whose box is nearest to any query that needs it is next; a node goes with
those queries only that its box is within the k-th distance so far of, and is left out with all below it if there are none. Queries
are taken a leaf at a time, so that distances are matrix products. Then each query's k-th distance is propagated: a query visits another shard only if its
distance to the shard's box is below it, and carries its bound along, and the answers are merged.

Distances are recomputed in double precision for the vectors that single precision can't decide; equal
distances are ordered by identifier.

Defined cases: null vectors, null identifiers, vectors with null or non-finite numbers and those of another
length than most (ties: the shorter) take no part; of rows with one identifier the least vector counts; equal
vectors are at distance 0 and ordered by identifier; a vector is not its own neighbour; with fewer than k
others all are given; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows

K, LEAF = 10, 256
#: Vectors that a shard should have, and those of the sample that splits are taken from.
SHARD, SAMPLE = 16_384, 100_000
#: Queries that visit a shard in one task, about.
BLOCK = 65_536


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits (dimension, threshold) of a complete tree of that depth, in heap order."""
    out = [(0, 0.0)] * (2**depth - 1)

    def cut(node: int, part: np.ndarray) -> None:
        if node >= len(out):
            return
        if len(part):
            d = int((part.max(0) - part.min(0)).argmax())
            at = float(np.median(part[:, d]))
            out[node] = (d, at)
            goes = part[:, d] <= at
            cut(2 * node + 1, part[goes])
            cut(2 * node + 2, part[~goes])
        else:
            cut(2 * node + 1, part)
            cut(2 * node + 2, part)

    cut(0, sample)
    return out


def route(x: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """Leaf number of each vector."""
    node = np.zeros(len(x), np.int64)
    if tree:
        dims, at = np.array([d for d, _ in tree]), np.array([t for _, t in tree])
        while node[0:1].size and node[0] < len(tree):
            node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > at[node])
    return node - len(tree)


class Tree:
    """A KD-tree of vectors with double-precision copies: nodes as ranges of one order, their boxes and children (none: a leaf)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes = [(0, len(ids))] if len(ids) else []
        self.below: list[tuple[int, ...]] = []
        for a, b in self.nodes:  # which grows
            if b - a <= leaf:
                self.below.append(())
                continue
            part = x[order[a:b]]
            d = int((part.max(0) - part.min(0)).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
            self.below.append((len(self.nodes), len(self.nodes) + 1))
            self.nodes += [(a, a + mid), (a + mid, b)]
        self.bounds = sorted(x for x, below in zip(self.nodes, self.below) if not below)
        self.ids, self.x = ids[order], x[order]
        self.single = self.x.astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.single, self.single)
        self.low = np.array([self.x[a:b].min(0) for a, b in self.nodes])
        self.high = np.array([self.x[a:b].max(0) for a, b in self.nodes])

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest others of each query: numbers of queries, identifiers and squared distances, in any order.

        bound: squared distances beyond which a query needs no neighbour.
        """
        n = len(q)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        if not n or not self.bounds:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        single = q.astype(np.float32)
        norm = np.einsum("ij,ij->i", single, single)
        reach = bound.copy()
        waiting = [(0.0, 0, np.arange(n), np.zeros(n))]
        while waiting:
            _, node, live, near = heapq.heappop(waiting)
            ok = near <= reach[live]  # their k-th distances may have shrunk since
            live = live[ok]
            if not len(live):
                continue
            if self.below[node]:
                for child in self.below[node]:
                    gap = np.maximum(0, np.maximum(self.low[child] - q[live], q[live] - self.high[child]))
                    far = np.einsum("ij,ij->i", gap, gap)
                    ok = far <= reach[live]
                    if ok.any():
                        heapq.heappush(waiting, (float(far[ok].min()), child, live[ok], far[ok]))
                continue
            a, b = self.nodes[node]
            d = norm[live, None] + self.norm[None, a:b] - 2 * (single[live] @ self.single[a:b].T)
            # single precision errs by less than this
            slack = 1e-5 * (norm[live, None] + self.norm[None, a:b]) + 1e-9
            d[ids[live, None] == self.ids[None, a:b]] = np.inf
            maybe = d - slack <= reach[live, None]
            if b - a > k:
                # no more than the k least upper bounds of the leaf can matter
                top = np.partition(d + slack, k - 1, axis=1)[:, k - 1 : k]
                maybe &= d - slack <= top
            r, c = np.nonzero(maybe & np.isfinite(d))
            if not len(r):
                continue
            exact = ((self.x[a + c] - q[live[r]]) ** 2).sum(1)
            many = np.bincount(r, minlength=len(live))
            place = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            width = int(many.max())
            new_d, new_i = np.full((len(live), width), np.inf), np.full((len(live), width), np.iinfo(np.int64).max)
            new_d[r, place], new_i[r, place] = exact, self.ids[a + c]
            all_d, all_i = np.concatenate([best_d[live], new_d], 1), np.concatenate([best_i[live], new_i], 1)
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best_d[live], best_i[live] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            reach[live] = np.minimum(reach[live], best_d[live, k - 1] * (1 + 1e-12))
        r, c = np.nonzero(np.isfinite(best_d))
        return r, best_i[r, c], best_d[r, c]


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, size))


def _asked(tree: Tree, q: Tree, bound: np.ndarray, k: int) -> pd.DataFrame:
    """Queries q, a leaf at a time, in a shard's tree; bound follows q's order."""
    out = [pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "d2": np.zeros(0)})]
    for a, b in q.bounds:
        r, i, d = tree.search(q.ids[a:b], q.x[a:b], k, bound[a:b])
        out.append(pd.DataFrame({"id": q.ids[a:b][r], "neighbour": i, "d2": d}))
    return pd.concat(out)


def _own(k: int, size: int):
    """Neighbours of a shard's queries among its vectors."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        ids, x, asked = held["id"].to_numpy(), _matrix(held["v"], size), held["asked"].to_numpy()
        tree = Tree(ids, x)
        q = tree if asked.all() else Tree(ids[asked], x[asked])
        return _asked(tree, q, np.full(len(q.ids), np.inf), k)

    return run


def _visited(k: int, size: int):
    """Neighbours of the visitors from other shards, within their bounds."""

    def run(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(held["id"].to_numpy(), _matrix(held["v"], size))
        q = Tree(np.arange(len(queries)), _matrix(queries["v"], size))
        bound, ids = queries["kth"].to_numpy()[q.ids], queries["id"].to_numpy()[q.ids]
        q.ids = ids
        return _asked(tree, q, bound, k)

    return run


def _route(tree: list[tuple[int, float]], size: int):
    def run(batches):
        for batch in batches:
            yield batch.assign(shard=route(_matrix(batch["v"], size), tree) if len(batch) else np.zeros(0, np.int64))

    return run


def _visits(shards: np.ndarray, low: np.ndarray, high: np.ndarray):
    """A row (shard, id, v, kth) for each other shard whose box is within a query's k-th distance."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch["v"], low.shape[1])
            for s, a, b in zip(shards, low, high):
                gap = np.maximum(0, np.maximum(a - q, q - b))
                go = (np.einsum("ij,ij->i", gap, gap) <= batch["kth"].to_numpy() * (1 + 1e-12)) & (batch["shard"].to_numpy() != s)
                if go.any():
                    yield batch[go].assign(shard=s)[["shard", "id", "v", "kth"]]

    return run


def top_k(vectors: DataFrame, k: int = K, shard: int = SHARD, ident: str = "vec_id", column: str = "embedding", asked: Column | None = None) -> DataFrame:
    """Rows (vec_id, rank, neighbour, distance): the k nearest others, of all vectors, by Euclidean distance; for every vector, or those of which the identifier meets `asked`."""
    spark = vectors.sparkSession
    clean = vectors.where(F.col(ident).isNotNull() & F.col(column).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v"), (F.lit(True) if asked is None else asked).alias("asked"))
    clean = clean.where(F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & (F.size("v") > 0))
    clean = clean.groupBy("id").agg(F.min("v").alias("v"), F.coalesce(F.bool_or("asked"), F.lit(False)).alias("asked"))
    sizes = clean.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    answer = "id bigint, neighbour bigint, d2 double"
    if sizes is None:
        found = spark.createDataFrame([], answer)
    else:
        size, count = sizes
        clean = rows.cut(clean.where(F.size("v") == size))
        depth = max(0, int(np.ceil(np.log2(max(1, count / shard)))))
        sample = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas() if depth else None
        tree = splits(_matrix(sample["v"], size), depth) if depth else []
        held = rows.cut(clean.mapInPandas(_route(tree, size), "id bigint, v array<double>, asked boolean, shard bigint"))
        found = rows.cut(held.groupBy("shard").applyInPandas(_own(k, size), answer))
        if depth:
            kth = found.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(float("inf")).alias("kth"))
            boxes = held.select("shard", F.posexplode("v").alias("i", "e")).groupBy("shard", "i").agg(F.min("e").alias("low"), F.max("e").alias("high"))
            boxes = boxes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("b")).orderBy("shard").collect()
            low, high = (np.array([[e[x] for e in row["b"]] for row in boxes]) for x in (1, 2))
            bounded = held.where("asked").join(kth, "id", "left").select("shard", "id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
            out = bounded.mapInPandas(_visits(np.array([row["shard"] for row in boxes]), low, high), "shard bigint, id bigint, v array<double>, kth double")
            blocks = -(-held.where("asked").count() // BLOCK) or 1
            out = rows.cut(out.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
            # a shard goes to the blocks that visit it
            met = rows.small(out.select(F.col("shard").alias("s"), F.col("block").alias("b")).distinct())
            hosts = held.join(met, F.col("shard") == F.col("s")).select("shard", "id", "v", F.col("b").alias("block"))
            more = out.groupBy("shard", "block").cogroup(hosts.groupBy("shard", "block")).applyInPandas(_visited(k, size), answer)
            found = found.union(rows.cut(more))
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "neighbour"))), 1, k).alias("best"))
    flat = best.select("id", F.posexplode("best").alias("at", "x"))
    return flat.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), F.round(F.sqrt("x.d2"), 6).alias("distance"))
