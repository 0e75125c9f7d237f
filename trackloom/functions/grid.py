"""Cells of uniform grids and their neighbours as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.geom import col


@dataclass(frozen=True)
class MiningGrid:
    """Grid of the call-log analysis; ids are column + columns * row, from 0, in single precision."""

    x1: float = 120.7
    y1: float = 30.62
    x2: float = 122.2
    y2: float = 31.82
    columns: int = 100
    rows: int = 100

    def place(self, v, low: float, high: float, n: int) -> Column:
        """Place along one axis. Single precision decides on which side of an edge a tower falls."""
        step = F.lit(high - low).cast("float") / F.lit(n).cast("float")
        return F.floor(((col(v).cast("float") - F.lit(low).cast("float")) / step.cast("float")).cast("float")).cast("int")

    def column(self, lon) -> Column:
        return self.place(lon, self.x1, self.x2, self.columns)

    def row(self, lat) -> Column:
        return self.place(lat, self.y1, self.y2, self.rows)

    def cell(self, lon, lat) -> Column:
        """Id of the cell of a place, null outside the grid."""
        c, r = self.column(lon), self.row(lat)
        inside = (c >= 0) & (c < self.columns) & (r >= 0) & (r < self.rows)
        return F.when(inside, c + self.columns * r)

    def centre(self, cell) -> tuple[Column, Column]:
        cell = col(cell)
        c, r = F.pmod(cell, F.lit(self.columns)), F.floor(cell / self.columns)
        return F.lit(self.x1) + (c + 0.5) * ((self.x2 - self.x1) / self.columns), F.lit(self.y1) + (r + 0.5) * ((self.y2 - self.y1) / self.rows)

    def neighbours(self, cell) -> Column:
        """Array of up to eight neighbours; the edge of the grid cuts, it does not wrap."""
        return F.filter(self.around(cell), lambda n: n != col(cell))

    def around(self, cell) -> Column:
        """Array of a cell and its neighbours."""
        cell = col(cell).cast("int")
        c, r = F.pmod(cell, F.lit(self.columns)), F.floor(cell / self.columns).cast("int")
        every = [F.when(((c + dx).between(0, self.columns - 1)) & ((r + dy).between(0, self.rows - 1)), cell + dx + dy * self.columns) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return F.array_compact(F.array(*every))
