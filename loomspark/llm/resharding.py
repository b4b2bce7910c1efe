"""Minimum-cost-flow resharding: move the fewest bytes that fit old shards into new capacities.

The flow network is sparse: source -> old shard (its bytes), old shard -> new shard of the same name
(cost 0 a byte: the bytes stay), old shard -> exchange -> new shard (cost 1 a byte: the bytes move),
new shard -> sink (its capacity). Its size follows the number of shards, never that of the data, and
successive shortest paths solve it exactly on the driver. Flow through the exchange is split into
transfers in shard order. Documents are indivisible: within its old shard a document belongs to the
flow in which its first byte falls, so a new shard is over its capacity by at most a document per
transfer into it.

Defined cases: a null text has 0 bytes and goes with its shard's first bytes; an empty text as well; a
null shard name is the shard "" of its own; repeated rows (same doc_id and text) move together; a null
doc_id comes first in its shard's order; an empty table gives no transfers and no rows; other columns are carried
along, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows

#: New shards beyond the old ones, and spare room in each, of the registered query.
EXTRA_SHARDS, SLACK_PERCENT = 4, 2
#: Name of the written folders, FOLDER=SHARD.
FOLDER = "__ls_shard"


class Network:
    """Minimum-cost flow by successive shortest paths with potentials; capacities and costs are integers."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def _paths(self, source: int, price: list[int]) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] and d + self.cost[e] + price[x] - price[y] < far[y]:
                    far[y] = d + self.cost[e] + price[x] - price[y]
                    heapq.heappush(heap, (far[y], y))
        return far

    def solve(self, source: int, sink: int) -> tuple[int, int]:
        """Total flow and its cost: each phase saturates every shortest path of one length."""
        price = [0] * len(self.out)
        flow = cost = 0
        while True:
            far = self._paths(source, price)
            if far[sink] == float("inf"):
                return flow, cost
            price = [p + int(min(f, far[sink])) for p, f in zip(price, far)]
            at = [0] * len(self.out)
            seen = [False] * len(self.out)
            path: list[int] = []
            x = source
            seen[x] = True
            while True:
                if x == sink:
                    got = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= got
                        self.room[e ^ 1] += got
                        cost += got * self.cost[e]
                    flow += got
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    for e in path[cut:]:
                        seen[self.to[e]] = False
                    path = path[:cut]
                    x = self.to[path[-1]] if path else source
                elif at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    y = self.to[e]
                    if self.room[e] and not seen[y] and self.cost[e] + price[x] - price[y] == 0:
                        path.append(e)
                        seen[y] = True
                        x = y
                    else:
                        at[x] += 1
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def plan(old: Sequence[tuple[str, int]], new: Sequence[tuple[str, int]]) -> list[tuple[str, str, int, int]]:
    """Flows (old shard, new shard, first byte, end byte) within the old shard's order, what stays first.

    old: names and bytes; new: names and capacities. Raises ValueError where the bytes don't fit.
    """
    n, m = len(old), len(new)
    source, exchange, sink = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    place = {name: j for j, (name, _) in enumerate(new)}
    total = sum(size for _, size in old)
    if total > sum(capacity for _, capacity in new):
        raise ValueError("the new capacities are less than the bytes there are")
    stays, leaves, enters = {}, [], []
    for i, (name, size) in enumerate(old):
        net.edge(source, i, size, 0)
        if name in place:
            stays[i] = net.edge(i, n + place[name], size, 0)
        leaves.append(net.edge(i, exchange, size, 1))
    for j, (_, capacity) in enumerate(new):
        enters.append(net.edge(exchange, n + j, total, 0))
        net.edge(n + j, sink, capacity, 0)
    net.solve(source, sink)
    sent = lambda e: net.room[e ^ 1]
    rooms = [[j, sent(e)] for j, e in enumerate(enters) if sent(e)]
    out = []
    for i, (name, size) in enumerate(old):
        at = 0
        if i in stays and sent(stays[i]) or not size and i in stays:
            at = sent(stays[i])
            out.append((name, name, 0, at))
        left = sent(leaves[i])
        while left:
            got = min(left, rooms[0][1])
            out.append((name, new[rooms[0][0]][0], at, at + got))
            at, left = at + got, left - got
            rooms[0][1] -= got
            if not rooms[0][1]:
                rooms.pop(0)
        if not size and i not in stays and new:
            out.append((name, new[0][0], 0, 0))
    return out


def assign(docs: DataFrame, shard: Column, new: Sequence[tuple[str, int]] | None = None) -> tuple[DataFrame, list]:
    """A row (k, doc_id, n_bytes, old_shard, new_shard, moved, copies) for each distinct document, and the plan.

    Only identifiers and lengths are sorted, by range, so a hot shard is spread over partitions.
    Without `new`: the old shards and EXTRA_SHARDS more, of equal capacity with SLACK_PERCENT to spare.
    """
    spark = docs.sparkSession
    each = docs.select(rows.row_key().alias("k"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("one"), F.coalesce(shard.cast("string"), F.lit("")).alias("old_shard"))
    base = each.groupBy("k", "doc_id", "one", "old_shard").agg(F.count("*").alias("copies"))
    base = base.select("k", "doc_id", (F.col("one") * F.col("copies")).alias("n_bytes"), "old_shard", F.col("copies").cast("int").alias("copies"))
    placed, totals = rows.offsets(base, "old_shard", ["doc_id", "k"], "n_bytes")
    old = sorted(totals.items())
    if new is None:
        count = len(old) + EXTRA_SHARDS
        room = -(-sum(size for _, size in old) * (100 + SLACK_PERCENT) // (100 * count))
        new = [(name, room) for name, _ in old] + [(f"new{j}", room) for j in range(EXTRA_SHARDS)]
    flows = plan(old, new)
    if not flows:
        return placed.select("k", "doc_id", "n_bytes", "old_shard", F.col("old_shard").alias("new_shard"), F.lit(False).alias("moved"), "copies"), flows
    steps = spark.createDataFrame(flows, "f_old string, new_shard string, f_begin bigint, f_end bigint")
    steps = steps.groupBy("f_old").agg(F.array_sort(F.collect_list(F.struct("f_begin", "f_end", "new_shard"))).alias("flows"))
    # the last flow that begins at or before the document's first byte; empty flows sort first
    joined = placed.join(F.broadcast(steps), F.col("old_shard") == F.col("f_old"))
    to = F.element_at(F.filter("flows", lambda f: f.f_begin <= F.col("before")), -1).new_shard
    return joined.select("k", "doc_id", "n_bytes", "old_shard", to.alias("new_shard"), (to != F.col("old_shard")).alias("moved"), "copies"), flows


def reshard(docs: DataFrame, shard: Column, path: str | None = None, new: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Rewrites the affected new shards below `path` (a folder of the shared one by default), a folder
    __ls_shard=NAME each, and gives a row (doc_id, n_bytes, old_shard, new_shard, moved) for every document.

    A new shard is affected if documents enter it or left it; all others keep their old files.
    """
    spark = docs.sparkSession
    placed, _ = assign(docs, shard, new)
    placed = rows.cut(placed)
    affected = sorted({x for pair in placed.where("moved").select("old_shard", "new_shard").distinct().collect() for x in pair})
    if affected:
        path = path or f"{rows.checkpoint_dir(spark)}/reshard-{uuid.uuid4().hex}"
        names = spark.createDataFrame([(x,) for x in affected], "__ls_touched string")
        # what stays in an affected shard needs no lookup: only moved documents are named by key
        moved = rows.small(placed.where("moved").select(F.col("k").alias("__ls_k"), F.col("old_shard").alias("__ls_old"), F.col("new_shard").alias("__ls_to")))
        keyed = docs.withColumn("__ls_from", F.coalesce(shard.cast("string"), F.lit(""))).join(F.broadcast(names), F.col("__ls_from") == F.col("__ls_touched"), "left_semi")
        sent = keyed.withColumn("__ls_row", rows.row_key()).join(moved, (F.col("__ls_row") == F.col("__ls_k")) & (F.col("__ls_from") == F.col("__ls_old")), "left")
        sent = sent.withColumn(FOLDER, F.coalesce("__ls_to", "__ls_from")).drop("__ls_row", "__ls_k", "__ls_old", "__ls_to", "__ls_from")
        sent.write.partitionBy(FOLDER).mode("overwrite").parquet(path)
    each = placed.withColumn("one", F.explode(F.expr("array_repeat(n_bytes div copies, copies)")))
    return each.select("doc_id", F.col("one").alias("n_bytes"), "old_shard", "new_shard", "moved")
