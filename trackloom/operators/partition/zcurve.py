"""Z-curve: cells are ranges of Morton codes of equal counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import zorder
from trackloom.operators.partition.base import Area, Partitioner, at_ranks, located, sampled
from trackloom.operators.partition.quad import _count_at_most, morton


@dataclass
class ZCurve(Partitioner):
    """splits: the upper code of each cell, the last the area's highest. A code equal to a split is in the cell that ends there."""

    area: Area
    splits: list[int]
    kind = "zcurve"

    @classmethod
    def build(cls, points: DataFrame, area: Area, n: int, x: str = "x", y: str = "y", sample: int = 100_000) -> ZCurve:
        """Exact splits: from an array of up to `sample` points, from counts of codes beyond."""
        rows = located(points, x, y)
        count = rows.count()
        if count <= sample:
            return cls.from_array(sampled(points, x, y, sample), area, n)
        ranks = cls._ranks(count, n)
        codes = rows.select(F.lit(0).alias("g"), zorder.encode("x", "y", area).alias("z"))
        found = at_ranks(codes, {0: ranks}, ["z"], sample) if ranks else {}
        return cls(area, [*(found[0, r][0] for r in ranks), cls._last(area)])

    @classmethod
    def from_array(cls, p: np.ndarray, area: Area, n: int) -> ZCurve:
        codes = np.sort(morton(p, area))
        last = cls._last(area)
        return cls(area, [*(int(codes[r]) if len(codes) else last for r in cls._ranks(len(codes), n)), last])

    @staticmethod
    def _last(area: Area) -> int:
        return int(morton(np.array([[area[2], area[3]]], float), area)[0])

    @staticmethod
    def _ranks(count: int, n: int) -> list[int]:
        return [min(count - 1, (i + 1) * count // n) for i in range(n - 1)]

    def _state(self) -> dict:
        return {"splits": self.splits}

    def cells(self):
        out, low = [], 0
        for i, high in enumerate(self.splits):
            out.append((i, *self._rectangle(low, high)))
            low = high
        return out

    def _rectangle(self, low: int, high: int) -> tuple[float, float, float, float]:
        """The smallest quadrant that holds both codes, in coordinates."""
        mask = (1 << (low ^ high).bit_length()) - 1
        corner = []
        for code in (low & ~mask, high | mask):
            for axis, shift in ((0, 1), (1, 0)):
                place = sum((code >> (2 * b + shift) & 1) << b for b in range(31))
                corner.append(self.area[axis] + place * (self.area[axis + 2] - self.area[axis]) / zorder.TOP)
        return tuple(corner)

    def assign(self, x, y) -> Column:
        """Number of splits below the point's code."""
        splits = F.array(*(F.lit(s) for s in self.splits))
        code = zorder.encode(x, y, self.area)
        below = _count_at_most(splits, code - 1, len(self.splits))
        return F.when(self.inside(x, y), F.least(below, F.lit(len(self.splits) - 1))).otherwise(-1).cast("long")
