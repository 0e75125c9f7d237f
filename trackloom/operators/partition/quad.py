"""Quad-tree over Morton codes: a leaf is a range of codes."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import zorder
from trackloom.operators.partition.base import Area, Partitioner, located, sampled

#: Levels below the root at most; child ids then stay below 2**32.
DEPTH = 15


def morton(p: np.ndarray, area: Area) -> np.ndarray:
    """Morton codes of an array of points, as zorder.encode gives them."""
    top = float(zorder.TOP)
    out = np.zeros(len(p), np.int64)
    for axis, shift in ((0, 1), (1, 0)):
        place = np.clip((p[:, axis] - area[axis]) * top / (area[axis + 2] - area[axis]), 0, top).astype(np.int64)
        for bit in range(31):
            out |= (place >> bit & 1) << (2 * bit + shift)
    return out


@dataclass
class QuadTree(Partitioner):
    """leaves: ids in base 4 below the root 1; children 0 low-low, 1 low x high y, 2 high x low y, 3 high-high."""

    area: Area
    leaves: list[int]
    counts: dict[int, int] = field(default_factory=dict)
    kind = "quad"

    @classmethod
    def build(cls, points: DataFrame, area: Area, n: int, x: str = "x", y: str = "y", sample: int = 100_000) -> QuadTree:
        """Exact leaves: from an array of up to `sample` points, from counts of code prefixes beyond."""
        rows = located(points, x, y)
        count = rows.count()
        if count <= sample:
            return cls.from_array(sampled(points, x, y, sample), area, n)
        return cls._counted(rows.select(zorder.encode("x", "y", area).alias("z")), count, area, n)

    @classmethod
    def _counted(cls, codes: DataFrame, count: int, area: Area, n: int, depth: int = DEPTH, most_counts: int = 1 << 17) -> QuadTree:
        """Counts some levels at once, then only within the nodes that are still too full: fewer than n + 1 on a level."""
        most, spark = max(1, count // n), codes.sparkSession
        leaves, counts, full, level = [], {}, [1], 0
        if count <= most or not depth:
            return cls(area, [1], {1: count})
        while full:
            low = level + 1
            while low < depth and len(full) * 4 ** (low + 1 - level) <= most_counts:
                low += 1
            node = lambda at: F.shiftright("z", 62 - 2 * at) + F.lit(4**at)
            inside = codes.join(F.broadcast(spark.createDataFrame([(k,) for k in full], "_node long")), node(level) == F.col("_node")) if level else codes
            held = Counter()
            for r in inside.groupBy(node(low).alias("node")).agg(F.count(F.lit(1)).alias("n")).collect():
                for up in range(low - level + 1):
                    held[r["node"] >> 2 * up] += r["n"]
            queue, full, at_low = deque((k * 4 + i for k in full for i in range(4))), [], 4**low
            while queue:
                k = queue.popleft()
                if held[k] <= most or k >= 4**depth:
                    leaves.append(k)
                    counts[k] = held[k]
                elif k >= at_low:
                    full.append(k)
                else:
                    queue += [k * 4 + i for i in range(4)]
            level = low
        return cls(area, sorted(leaves), counts)

    @classmethod
    def from_array(cls, p: np.ndarray, area: Area, n: int, depth: int = DEPTH) -> QuadTree:
        codes = np.sort(morton(p, area))
        most = max(1, len(codes) // n)
        leaves, counts, queue = [], {}, deque([(1, 0, 0)])
        while queue:
            node, level, low = queue.popleft()
            width = 1 << (62 - 2 * level)
            a, b = np.searchsorted(codes, [low, low + width])
            if b - a <= most or level >= depth:
                leaves.append(node)
                counts[node] = int(b - a)
                continue
            queue += [(node * 4 + i, level + 1, low + i * (width >> 2)) for i in range(4)]
        return cls(area, sorted(leaves), counts)

    def _state(self) -> dict:
        return {"leaves": self.leaves, "counts": {str(k): v for k, v in self.counts.items()}}

    @classmethod
    def restored(cls, area: Area, state: dict) -> QuadTree:
        return cls(area, state["leaves"], {int(k): v for k, v in state["counts"].items()})

    def code_range(self, leaf: int) -> tuple[int, int]:
        """Least code of a leaf, and the first after it."""
        level = (leaf.bit_length() - 1) // 2
        width = 1 << (62 - 2 * level)
        low = (leaf - (1 << 2 * level)) * width
        return low, low + width

    def cells(self):
        out = []
        for leaf in self.leaves:
            x1, y1, x2, y2 = self.area
            level = (leaf.bit_length() - 1) // 2
            for step in range(level - 1, -1, -1):
                quarter = leaf >> 2 * step & 3
                mx, my = (x1 + x2) / 2, (y1 + y2) / 2
                x1, x2 = (mx, x2) if quarter & 2 else (x1, mx)
                y1, y2 = (my, y2) if quarter & 1 else (y1, my)
            out.append((leaf, x1, y1, x2, y2))
        return out

    def assign(self, x, y) -> Column:
        """The leaf whose range holds the point's code: a search in two literal arrays."""
        ranges = sorted((self.code_range(leaf)[0], leaf) for leaf in self.leaves)
        lows, ids = F.array(*(F.lit(r[0]) for r in ranges)), F.array(*(F.lit(r[1]).cast("long") for r in ranges))
        code = F.least(zorder.encode(x, y, self.area), F.lit((1 << 62) - 1))
        place = _count_at_most(lows, code, len(ranges))
        return F.when(self.inside(x, y), F.element_at(ids, place)).otherwise(-1)


def _count_at_most(ordered: Column, value: Column, n: int) -> Column:
    """How many entries of an ascending literal array are <= value, by binary search; value is computed once."""
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)] or [1]
    start = F.struct(value.cast("long").alias("v"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        nxt = acc["at"] + s
        over = (nxt <= n) & (F.element_at(ordered, F.least(nxt, F.lit(n))) <= acc["v"])
        return F.struct(acc["v"].alias("v"), F.when(over, nxt).otherwise(acc["at"]).alias("at"))

    return F.aggregate(F.array(*map(F.lit, steps)), start, step, lambda a: a["at"])


class QuadTreeIndex:
    """A tree in memory, rebuilt from a list of leaf rectangles."""

    def __init__(self, x1: float, y1: float, x2: float, y2: float, depth: int = 0):
        self.bounds, self.depth, self.cell, self.children = (x1, y1, x2, y2), depth, None, []

    def insert(self, cell_id: int, x1: float, y1: float, x2: float, y2: float) -> None:
        """Descend by the rectangle's centre until a node equals it within 1e-6."""
        node, want, centre = self, (x1, y1, x2, y2), ((x1 + x2) / 2, (y1 + y2) / 2)
        while any(abs(a - b) > 1e-6 for a, b in zip(node.bounds, want, strict=True)):
            if node.depth > 64:
                raise ValueError("the rectangle is no quadrant of the tree")
            if not node.children:
                node._split()
            mx, my = (node.bounds[0] + node.bounds[2]) / 2, (node.bounds[1] + node.bounds[3]) / 2
            east, south = centre[0] >= mx, centre[1] < my
            node = node.children[2 * south + east]
        node.cell = cell_id

    def _split(self) -> None:
        x1, y1, x2, y2 = self.bounds
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        # north-west, north-east, south-west, south-east
        for b in ((x1, my, mx, y2), (mx, my, x2, y2), (x1, y1, mx, my), (mx, y1, x2, my)):
            self.children.append(QuadTreeIndex(*b, self.depth + 1))

    def leaves(self) -> Iterator[tuple[int, int]]:
        """(cell, depth) in pre-order."""
        if self.cell is not None:
            yield self.cell, self.depth
        for child in self.children:
            yield from child.leaves()

    def find(self, x: float, y: float) -> int | None:
        node = self
        while node.children:
            mx, my = (node.bounds[0] + node.bounds[2]) / 2, (node.bounds[1] + node.bounds[3]) / 2
            node = node.children[2 * (y < my) + (x >= mx)]
        return node.cell
