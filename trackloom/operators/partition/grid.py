"""Uniform grids in the plane and in space-time. Assignment is arithmetic: no join, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geom import BOX, col
from trackloom.operators.joins import meeting
from trackloom.operators.partition.base import Area, Partitioner


def dimensions(extents: list[float], n: int) -> list[int]:
    """Numbers of cells along each axis: the axis with the longest cells gets one more until there are n."""
    counts = [1] * len(extents)

    def total() -> int:
        out = 1
        for c in counts:
            out *= c
        return out

    while total() < n:
        sides = [e / c for e, c in zip(extents, counts, strict=True)]
        longest = max(sides)
        # of equal sides the last axis grows
        counts[max(i for i, s in enumerate(sides) if s == longest)] += 1
    return counts


@dataclass
class Grid(Partitioner):
    """Cells are numbered from 1, row by row; the last column and row end at the area's edge."""

    area: Area
    columns: int
    rows: int
    kind = "grid"

    @classmethod
    def build(cls, points: DataFrame | None, area: Area, n: int, x: str = "x", y: str = "y", sample: int = 0) -> Grid:
        return cls(area, *dimensions([area[2] - area[0], area[3] - area[1]], n))

    @property
    def step(self) -> tuple[float, float]:
        return (self.area[2] - self.area[0]) / self.columns, (self.area[3] - self.area[1]) / self.rows

    def _state(self) -> dict:
        return {"columns": self.columns, "rows": self.rows}

    def cells(self):
        (x1, y1, x2, y2), (dx, dy) = self.area, self.step
        edge = lambda lo, hi, d, i, n: hi if i == n else lo + d * i
        return [
            (r * self.columns + c + 1, edge(x1, x2, dx, c, self.columns), edge(y1, y2, dy, r, self.rows), edge(x1, x2, dx, c + 1, self.columns), edge(y1, y2, dy, r + 1, self.rows))
            for r in range(self.rows)
            for c in range(self.columns)
        ]

    def bounds(self, cell) -> tuple[Column, Column, Column, Column]:
        """A cell's rectangle as columns."""
        (x1, y1, x2, y2), (dx, dy) = self.area, self.step
        cell = col(cell) - 1
        c, r = F.pmod(cell, F.lit(self.columns)), F.floor(cell / self.columns)
        right = F.when(c == self.columns - 1, F.lit(x2)).otherwise(F.lit(x1) + (c + 1) * F.lit(dx))
        top = F.when(r == self.rows - 1, F.lit(y2)).otherwise(F.lit(y1) + (r + 1) * F.lit(dy))
        return F.lit(x1) + c * F.lit(dx), F.lit(y1) + r * F.lit(dy), right, top

    def _place(self, v, low: float, step: float, n: int) -> Column:
        return F.least(F.floor((col(v) - F.lit(low)) / F.lit(step)), F.lit(n - 1))

    def assign(self, x, y) -> Column:
        c, r = self._place(x, self.area[0], self.step[0], self.columns), self._place(y, self.area[1], self.step[1], self.rows)
        return F.when(self.inside(x, y), r * self.columns + c + 1).otherwise(-1).cast("long")

    def overlaps(self, r: Column) -> Column:
        """Array of the ids of all cells that a rectangle overlaps."""
        (x1, y1, _, _), (dx, dy) = self.area, self.step

        def span(low: Column, high: Column, start: float, step: float, n: int) -> Column:
            first = F.greatest(F.floor((low - F.lit(start)) / F.lit(step)), F.lit(0)).cast("int")
            last = F.least(F.ceil((high - F.lit(start)) / F.lit(step)), F.lit(n)).cast("int") - 1
            return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

        across = span(r["x1"], r["x2"], x1, dx, self.columns)
        up = span(r["y1"], r["y2"], y1, dy, self.rows)
        return F.flatten(F.transform(up, lambda j: F.transform(across, lambda i: (j * self.columns + i + 1).cast("long"))))


@dataclass
class BoxGrid:
    """A grid over x, y and z; ids from 1, layer by layer, row by row."""

    area: tuple[float, float, float, float, float, float]
    columns: int
    rows: int
    layers: int

    @classmethod
    def build(cls, area, n: int) -> BoxGrid:
        return cls(area, *dimensions([area[3] - area[0], area[4] - area[1], area[5] - area[2]], n))

    @property
    def step(self) -> tuple[float, float, float]:
        counts = (self.columns, self.rows, self.layers)
        return tuple((self.area[i + 3] - self.area[i]) / counts[i] for i in range(3))

    def frame(self, spark) -> DataFrame:
        """spaces(space_id, x1, y1, z1, x2, y2, z2)."""
        n = self.columns * self.rows * self.layers
        ids = spark.range(1, n + 1).withColumnRenamed("id", "space_id")
        return ids.select("space_id", *(c.alias(k) for k, c in zip(BOX, self.bounds("space_id"), strict=True)))

    def bounds(self, space) -> list[Column]:
        s = col(space) - 1
        counts = (self.columns, self.rows, self.layers)
        place = (F.pmod(s, F.lit(self.columns)), F.pmod(F.floor(s / self.columns), F.lit(self.rows)), F.floor(s / (self.columns * self.rows)))
        low = [F.lit(self.area[i]) + place[i] * F.lit(self.step[i]) for i in range(3)]
        high = [F.when(place[i] == counts[i] - 1, F.lit(self.area[i + 3])).otherwise(F.lit(self.area[i]) + (place[i] + 1) * F.lit(self.step[i])) for i in range(3)]
        return [*low, *high]

    def assign(self, x, y, z) -> Column:
        """Id of a point's space, -1 outside (half-open)."""
        counts, values = (self.columns, self.rows, self.layers), [col(v) for v in (x, y, z)]
        inside, place = F.lit(True), []
        for i, v in enumerate(values):
            inside = inside & (v >= self.area[i]) & (v < self.area[i + 3])
            place.append(F.least(F.floor((v - F.lit(self.area[i])) / F.lit(self.step[i])), F.lit(counts[i] - 1)))
        return F.when(inside, place[2] * (self.columns * self.rows) + place[1] * self.columns + place[0] + 1).otherwise(-1).cast("long")

    def overlapping(self, shapes: DataFrame) -> DataFrame:
        """Each shape beside each space that its box overlaps."""
        spaces = self.frame(shapes.sparkSession)
        return meeting(shapes, spaces.select("space_id", *BOX))
