"""Packed R-trees: Sort-Tile-Recursive by ranks, and the node table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geom import BOX
from trackloom.operators.scratch import cut


def tree_shape(n: int, degree: int) -> dict[str, int]:
    """Height, leaves and nodes of a packed tree of n shapes."""
    height = 1
    while degree**height < n:
        height += 1
    leaves = degree ** (height - 1)
    # a level less where leaves would hold fewer than two shapes
    if height > 1 and n < 2 * leaves:
        height -= 1
        leaves //= degree
    return {"height": height, "leaves": leaves, "nodes": (degree**height - 1) // (degree - 1) if degree > 1 else height}


def slice_of(rank: Column, n: Column, parts: int) -> Column:
    """Slice of the 0-based rank among n rows cut at the ranks floor(i * n / parts)."""
    return F.floor(((rank + 1) * parts - 1) / n).cast("int")


def pack(shapes: DataFrame, degree: int, key: str, levels: int | None = None, n: int | None = None) -> DataFrame:
    """shapes(x1..z2) with `leaf`, the leaf's path of slices read as a number, root first.

    Each level sorts a node's shapes by centre, by x, then y, then z and again,
    and cuts them in `degree` slices. The ties are ordered by key. Every level
    ranks all shapes by one range sort, a node's by their ranks less its least
    one, so that no task holds a node.
    """
    n = shapes.count() if n is None else n
    levels = tree_shape(n, degree)["height"] - 1 if levels is None else levels
    centres = [((F.col(a) + F.col(b)) / 2).alias(f"_c{i}") for i, (a, b) in enumerate((("x1", "x2"), ("y1", "y2"), ("z1", "z2")))]
    rows = shapes.select("*", *centres).withColumn("leaf", F.lit(0).cast("long"))
    for level in range(levels):
        rows = _ranked(rows, ["leaf", f"_c{level % 3}", key])
        if level == 0:
            rows = rows.withColumns({"_s": F.lit(0), "_n": F.lit(n)})
        else:
            own = rows.groupBy("leaf").agg(F.min("_r").alias("_s"), F.count(F.lit(1)).alias("_n"))
            rows = rows.join(own, "leaf")
        rows = rows.withColumn("leaf", F.col("leaf") * degree + slice_of(F.col("_r") - F.col("_s"), F.col("_n"), degree)).drop("_r", "_s", "_n")
    return rows.drop("_c0", "_c1", "_c2").select(*shapes.columns, "leaf")


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _r, the 0-based rank over the whole table.

    Sorted by range and written, as ranks must not change when a task runs
    again; a partition's rows begin after those of the partitions before it.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for p, k in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += k
    offsets = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_r", F.col("_start") + low).drop("_p", "_at", "_start")


def nodes(packed: DataFrame, degree: int, levels: int) -> DataFrame:
    """(level, node, n, x1..z2): boxes of the nodes of every level, root level 0."""
    out = None
    for level in range(levels + 1):
        node = F.floor(F.col("leaf") / degree ** (levels - level)).cast("long").alias("node")
        boxes = packed.groupBy(node).agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in BOX[:3]), *(F.max(c).alias(c) for c in BOX[3:]))
        boxes = boxes.select(F.lit(level).alias("level"), "node", "n", *BOX)
        out = boxes if out is None else out.unionByName(boxes)
    return out


def expected_height(n: int, degree: int) -> int:
    return max(1, math.ceil(math.log(n, degree))) if n > 1 else 1
