"""Optimal one-to-one assignment inside groups, by augmenting paths with potentials, a group at a time as its rows stream past."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold


class Assigner:
    """The assignment of greatest total weight between two sides of one group; either side may stay unmatched.

    Rows arrive sorted by the left side. Each new left item searches the cheapest alternating path over reduced costs (Dijkstra over the edges that
    exist, no dense matrix) to a free right item, or to staying unmatched, itself or any left item on the way; potentials keep reduced costs from falling
    below zero. Memory: edges of one group. Left and right items are taken in their order, so equal input gives equal output; among assignments of one
    total the choice is that of this order. Weights of zero and below, and null ones, are no edges.
    """

    def __init__(self) -> None:
        self.edges: dict = {}
        self.left: dict = {}  # right item -> its left item
        self.right: dict = {}  # left item -> its right item
        self.high: dict = {}  # potentials of left items
        self.low: dict = {}  # and of right items
        self.now: object = None

    def step(self, i, j, weight) -> list[tuple]:
        if weight is None or weight <= 0 or i is None or j is None:
            return []
        if self.edges and i != self.now:
            self._insert(self.now)
        self.now = i
        own = self.edges.setdefault(i, {})
        own[j] = max(weight, own.get(j, 0))
        return []

    def close(self) -> list[tuple]:
        if self.edges:
            self._insert(self.now)
        return [(i, j, self.edges[i][j]) for i, j in sorted(self.right.items())]

    def _insert(self, i) -> None:
        """Potentials satisfy high[i] + low[j] >= weight of every edge and >= 0 everywhere, with equality on matched edges and zero at unmatched items."""
        self.high[i] = max(w - self.low.get(j, 0) for j, w in self.edges[i].items())
        self.high[i] = max(self.high[i], 0)
        dist, back, heap, done = {}, {}, [], {}
        best, end = self.high[i], ("left", i)  # staying unmatched costs the potential
        reach = {i: 0}
        stack = [(0, i)]
        while True:
            while stack:
                d, u = stack.pop()
                if d + self.high[u] < best:
                    best, end = d + self.high[u], ("left", u)
                for j, w in self.edges[u].items():
                    step = d + self.high[u] + self.low.get(j, 0) - w
                    if j not in done and step < dist.get(j, best):
                        dist[j], back[j] = step, u
                        heapq.heappush(heap, (step, j))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, j = heapq.heappop(heap)
            done[j] = d
            if j not in self.left:
                if d + self.low.get(j, 0) < best:
                    best, end = d + self.low.get(j, 0), ("right", j)
                continue
            u = self.left[j]
            reach[u] = d
            stack.append((d, u))
        for u, d in reach.items():
            self.high[u] -= max(best - d, 0)
        for j, d in done.items():
            if d < best:
                self.low[j] = self.low.get(j, 0) + best - d
        side, at = end
        if side == "left":
            j = self.right.pop(at, None)
            if j is None:
                return  # the new item itself stays unmatched
        else:
            j = at
        while True:
            u = back[j]
            before = self.right.get(u)
            self.right[u], self.left[j] = j, u
            if u == i:
                return
            j = before


def optimal_pairs(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Of candidates (group, i, j, weight) the one-to-one choice of greatest total weight in each group. Of repeated candidates the greatest weight counts."""
    rows = candidates.select(*group, "i", "j", "weight")
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("i", "j", "weight"))
    return fold(rows, group, ["i", "j"], Assigner, kind)


def grouping_difference(items: DataFrame, group: list[str], one: str, two: str) -> DataFrame:
    """Two groupings of the same items compared whatever their labels: labels are matched so that as many items as possible agree.

    ``items`` has the label of an item in both groupings, null where it has none. Adds ``differs``: the item's labels are not a matched pair.
    An item without label in both agrees. Counts of label pairs are made before the matching, so a group of many items costs its label pairs only.
    """
    both = items.filter(F.col(one).isNotNull() & F.col(two).isNotNull())
    counts = both.groupBy(*group, F.col(one).alias("i"), F.col(two).alias("j")).agg(F.count("*").alias("weight"))
    matched = optimal_pairs(counts, group).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("i").alias(one), F.col("j").alias("_two"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    joined = items.join(matched.withColumnRenamed(one, "_one"), [*same, F.col(one) == F.col("_one")], "left")
    differs = F.when(F.col(one).isNull() & F.col(two).isNull(), False).otherwise(~F.coalesce(F.col("_two") == F.col(two), F.lit(False)))
    return joined.withColumn("differs", differs).drop("_one", "_two", *[f"_{g}" for g in group])
