"""What all partitioners share."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.geom import col, rect
from trackloom.operators.joins import meeting

Area = tuple[float, float, float, float]
CELLS = "cell_id long, x1 double, y1 double, x2 double, y2 double"


class Partitioner(ABC):
    """Cells that cover an area without overlapping."""

    kind: str
    area: Area

    @classmethod
    @abstractmethod
    def build(cls, points: DataFrame, area: Area, n: int, x: str = "x", y: str = "y", sample: int = 100_000) -> Partitioner: ...

    @abstractmethod
    def cells(self) -> list[tuple[int, float, float, float, float]]:
        """(id, x1, y1, x2, y2) of every cell."""

    @abstractmethod
    def assign(self, x, y) -> Column:
        """Id of the cell of a point; -1 outside the area."""

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.cells(), CELLS)

    def spec(self) -> str:
        """The partitioner as JSON, for a job that did not build it."""
        return json.dumps({"kind": self.kind, "area": self.area, **self._state()})

    def _state(self) -> dict:
        return {}

    @classmethod
    def restored(cls, area: Area, state: dict) -> Partitioner:
        """The partitioner of what _state() gave."""
        return cls(area, **{k: v for k, v in state.items() if k not in ("kind", "area")})

    def inside(self, x, y) -> Column:
        x, y = col(x), col(y)
        return (x >= self.area[0]) & (x < self.area[2]) & (y >= self.area[1]) & (y < self.area[3])


def located(points: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of the points that have both."""
    return points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")


def sampled(points: DataFrame, x: str, y: str, limit: int) -> np.ndarray:
    """At most `limit` points as rows of x and y, in an order that does not depend on the input's."""
    rows = located(points, x, y)
    h, n = F.xxhash64("x", "y"), rows.count()
    if n > 8 * limit:
        # Hashes below a bound that some 4 * limit points have: tasks then send few points. Not if those are too few after all.
        some = rows.where(h < F.lit(int(-(1 << 63) + (1 << 64) * (4 * limit / n))))
        rows = some if some.limit(limit).count() == limit else rows
    kept = (rows if n <= limit else rows.orderBy(h, "x", "y").limit(limit)).select("x", "y", h.alias("h")).toArrow()
    x, y, h = (kept.column(c).to_numpy() for c in ("x", "y", "h"))
    return np.column_stack([x, y])[np.lexsort((y, x, h))]


def at_ranks(rows: DataFrame, ranks: dict[int, list[int]], keys: list[str], few: int = 100_000, most: int = 1 << 18) -> dict[tuple[int, int], tuple]:
    """{(g, rank): keys} of the rows that have these ranks, from 0, in the order of keys within their group g of rows(g, *keys).

    Bins of a key are counted, and only the bins that hold a rank go on, as
    groups of their own, with bins between their least and greatest value. At
    most `most` bins and `few` rows come to the driver at once, whatever the table.
    """
    spark, kinds = rows.sparkSession, [dict(rows.dtypes)[k] for k in keys]
    at = {(g, r): (g, r) for g, some in ranks.items() for r in some}
    out: dict[tuple[int, int], tuple] = {t: () for t in at}
    rows = rows.select(F.col("g").cast("long").alias("g"), *keys)
    for place, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
        spans = {r["g"]: (r["low"], r["high"], r["n"]) for r in rows.groupBy("g").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).collect()}
        while True:
            held = {g for g, _ in at.values()}
            if sum(spans[g][2] for g in held) <= few:
                return {t: out[t] + v for t, v in _picked(rows, at, keys[place:], held).items()}
            if all(spans[g][0] == spans[g][1] for g in held):
                out = {t: (*out[t], spans[at[t][0]][0]) for t in at}
                break
            bins = max(2, min(4096, most // len(held)))
            known = spark.createDataFrame([(g, *spans[g][:2]) for g in sorted(held)], f"g long, low {kind}, high {kind}")
            # Every step keeps the order of values, so a bin is all rows between its least and greatest value.
            share = (F.col(key).cast("double") / 2 - F.col("low").cast("double") / 2) / (F.col("high").cast("double") / 2 - F.col("low").cast("double") / 2)
            bin_ = F.when(F.col(key) == F.col("low"), -1).when(F.col(key) == F.col("high"), bins).otherwise(F.least(F.floor(share * bins), F.lit(bins)))
            rows = rows.join(F.broadcast(known), "g").select("g", *keys, F.coalesce(bin_, F.lit(0)).cast("int").alias("_bin"))
            found = defaultdict(list)
            for r in rows.groupBy("g", "_bin").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).collect():
                found[r["g"]].append((r["_bin"], r["low"], r["high"], r["n"]))
            named, spans = {}, {}
            for t, (g, r) in at.items():
                for b, low, high, n in sorted(found[g]):
                    if r < n:
                        new = named.setdefault((g, b), len(named))
                        spans[new], at[t] = (low, high, n), (new, r)
                        break
                    r -= n
            into = spark.createDataFrame([(*k, v) for k, v in named.items()], "g long, _bin int, _new long")
            rows = rows.join(F.broadcast(into), ["g", "_bin"]).select(F.col("_new").alias("g"), *keys)
    return out


def _picked(rows: DataFrame, at: dict, keys: list[str], held: set[int]) -> dict[tuple[int, int], tuple]:
    """at_ranks() of few rows, on the driver."""
    of = defaultdict(list)
    for r in rows.where(F.col("g").isin(sorted(held))).collect() if len(held) < 1000 else rows.collect():
        of[r["g"]].append(tuple(r[k] for k in keys))
    for some in of.values():
        some.sort()
    return {t: of[g][r] for t, (g, r) in at.items()}


def overlapping(shapes: DataFrame, cells: DataFrame, r: Column | None = None) -> DataFrame:
    """Every shape beside every cell that it overlaps; many cells meet the shapes in the bins of a grid.

    shapes has x1..y2 unless r gives its rectangle; cells' columns get the prefix c_.
    """
    corners = ("x1", "y1", "x2", "y2")
    r, flat = rect() if r is None else r, {"z1": F.lit(0.0), "z2": F.lit(1.0)}
    packed = shapes.select(F.struct("*").alias("_row"), *(r[c].alias(c) for c in corners)).withColumns(flat)
    met = meeting(packed, cells.select("cell_id", *corners).withColumns(flat))
    return met.select("_row.*", "cell_id", *(F.col(f"s_{c}").alias(f"c_{c}") for c in corners))


def assign_points(points: DataFrame, partitioner: Partitioner, x: str = "x", y: str = "y", out: str = "cell_id") -> DataFrame:
    return points.withColumn(out, partitioner.assign(x, y))
