"""KD-tree: a binary name tree with n leaves, split at ranks, x and y in turn."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geom import col
from trackloom.operators.partition.base import Area, Partitioner, at_ranks, located, sampled
from trackloom.operators.scratch import cut, drop


def leaves_below(node: int, n: int) -> int:
    """Leaves of the name tree (inner nodes 1..n-1, leaves n..2n-1) below a node."""
    low = high = node
    count = 0
    while low < 2 * n:
        count += max(0, min(high, 2 * n - 1) - max(low, n) + 1)
        low, high = 2 * low, 2 * high + 1
    return count


@dataclass
class KdTree(Partitioner):
    """splits[node] is the coordinate at which inner node 1..n-1 is cut."""

    area: Area
    splits: dict[int, float]
    n: int
    kind = "kd"

    @classmethod
    def build(cls, points: DataFrame, area: Area, n: int, x: str = "x", y: str = "y", sample: int = 100_000) -> KdTree:
        """Exact splits: from an array of up to `sample` points, by counts beyond."""
        rows = located(points, x, y)
        count = rows.count()
        if count <= sample:
            return cls.from_array(sampled(points, x, y, sample), area, n)
        return cls._counted(rows, count, area, n, sample)

    @classmethod
    def _counted(cls, points: DataFrame, count: int, area: Area, n: int, few: int) -> KdTree:
        """Level by level, each split the point of its rank. Points of one coordinate are in the order of a hash, equal points in any."""
        points = cut(points.withColumn("id", F.monotonically_increasing_id()))
        rows = points.select(F.lit(1).cast("long").alias("g"), "x", "y", F.xxhash64("x", "y").alias("h"), "id")
        splits, sizes, level = {}, {1: count}, 0
        while nodes := [k for k in sizes if k.bit_length() == level + 1 and k < n]:
            axis, ranks = level % 2, {}
            for k in nodes:
                one, two = leaves_below(2 * k, n), leaves_below(2 * k + 1, n)
                sizes[2 * k] = sizes[k] * one // (one + two)
                sizes[2 * k + 1] = sizes[k] - sizes[2 * k]
                if sizes[k]:
                    ranks[k] = [min(sizes[2 * k], sizes[k] - 1)]
                else:
                    splits[k] = (area[axis] + area[axis + 2]) / 2
            rows = rows.where(F.col("g") < n)
            keys = ["xy"[axis], "h", "id"]
            found = [(k, *v, sizes[2 * k] == sizes[k]) for (k, _), v in at_ranks(rows, ranks, keys, few).items()] if ranks else []
            splits |= {f[0]: float(f[1]) for f in found}
            at = rows.sparkSession.createDataFrame(found, "g long, _v double, _h long, _id long, _all boolean")
            below = F.struct(*keys) < F.struct("_v", "_h", "_id")
            rows = rows.join(F.broadcast(at), "g").select((F.col("g") * 2 + F.when(F.col("_all") | below, 0).otherwise(1)).alias("g"), "x", "y", "h", "id")
            level += 1
        drop(points)
        return cls(area, splits, n)

    @classmethod
    def from_array(cls, p: np.ndarray, area: Area, n: int) -> KdTree:
        splits: dict[int, float] = {}
        # Points of one coordinate stay in the order of p.
        queue = deque([(1, np.arange(len(p)), 0)])
        while queue:
            node, part, axis = queue.popleft()
            if node >= n:
                continue
            one, two = leaves_below(2 * node, n), leaves_below(2 * node + 1, n)
            # the rank at which the points divide as the leaves do
            at = len(part) * one // (one + two)
            ordered = part[np.argsort(p[part, axis], kind="stable")]
            if len(ordered):
                splits[node] = float(p[ordered[min(at, len(ordered) - 1)], axis])
            else:
                splits[node] = (area[axis] + area[axis + 2]) / 2
            queue.append((2 * node, np.sort(ordered[:at]), 1 - axis))
            queue.append((2 * node + 1, np.sort(ordered[at:]), 1 - axis))
        return cls(area, splits, n)

    @classmethod
    def restored(cls, area: Area, state: dict) -> KdTree:
        return cls(area, {int(k): v for k, v in state["splits"].items()}, state["n"])

    def _state(self) -> dict:
        return {"splits": {str(k): v for k, v in self.splits.items()}, "n": self.n}

    def cells(self):
        out = []
        stack = [(1, *self.area, 0)]
        while stack:
            node, x1, y1, x2, y2, axis = stack.pop()
            if node >= self.n:
                out.append((node, x1, y1, x2, y2))
                continue
            s = self.splits[node]
            if axis == 0:
                stack += [(2 * node, x1, y1, s, y2, 1), (2 * node + 1, s, y1, x2, y2, 1)]
            else:
                stack += [(2 * node, x1, y1, x2, s, 0), (2 * node + 1, x1, s, x2, y2, 0)]
        return sorted(out)

    def assign(self, x, y) -> Column:
        """Descends level by level: the splits are one literal array, the node an index into it."""
        x, y = col(x), col(y)
        at = F.array(*(F.lit(self.splits.get(i, 0.0)) for i in range(1, max(2, self.n))))
        axes = [level % 2 for level in range(max(1, (2 * self.n - 1).bit_length()))]

        def down(node: Column, axis: Column) -> Column:
            v = F.when(axis == 0, x).otherwise(y)
            split = F.element_at(at, F.least(node, F.lit(max(1, self.n - 1))))
            return F.when(node < self.n, node * 2 + F.when(v < split, 0).otherwise(1)).otherwise(node)

        node = F.aggregate(F.array(*map(F.lit, axes)), F.lit(1), down)
        return F.when(self.inside(x, y), node).otherwise(-1).cast("long")

    def assign_by_cells(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """The same by a join with the cells' rectangles; for trees of many levels."""
        from trackloom.operators.joins import locate

        return locate(points, self.frame(points.sparkSession), x, y, out="cell_id")
