"""Spatial joins: point to cell, shape to partition, nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geom import BOX, box, box_intersection, box_volume, boxes_overlap, col, planar_distance, rect, rect_has_point
from trackloom.operators.scratch import cut

#: Cells up to which each row is compared with all of them; beyond, both sides meet in a coarse grid.
FEW_CELLS = 2000
#: Cells, at 40 bytes or so each, up to which the table of cells is broadcast.
BROADCAST_CELLS = 1_000_000


def locate(points: DataFrame, cells: DataFrame, x: str = "lng", y: str = "lat", out: str = "cell_id", order: str = "cell_id", missing: int | None = -1, bins: int = 256) -> DataFrame:
    """Each point's cell: half-open containment, the first in `order` if several hold it, `missing` if none.

    A few cells are broadcast and compared with every point. More are cut into
    the bins of a coarse grid over their common area, so that the join is an
    equality on the bin with a test of the cells in it; that table is broadcast
    while its counted size allows and joined by a shuffle beyond.
    """
    names = {c: f"_{c}" for c in ("x1", "y1", "x2", "y2")}
    small = cells.select(F.col("cell_id").alias("_cell"), F.col(order).alias("_order"), *(F.col(c).alias(n) for c, n in names.items()))
    stats = small.agg(F.count(F.lit(1)).alias("n"), *(f(n).alias(n) for f, n in zip((F.min, F.min, F.max, F.max), names.values(), strict=True))).first()
    if not stats["n"]:
        return points.withColumn(out, F.lit(missing).cast("long"))
    if stats["n"] <= FEW_CELLS:
        inside = rect_has_point(rect("_x1", "_y1", "_x2", "_y2"), x, y)
        joined = points.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(small), inside, "left")
    else:
        x1, y1 = stats["_x1"], stats["_y1"]
        dx, dy = (stats["_x2"] - x1) / bins or 1.0, (stats["_y2"] - y1) / bins or 1.0
        bin_of = lambda v, low, d: F.floor((col(v) - F.lit(low)) / F.lit(d)).cast("int")
        spread = small.withColumn("_bx", F.explode(F.sequence(bin_of("_x1", x1, dx), bin_of("_x2", x1, dx)))).withColumn("_by", F.explode(F.sequence(bin_of("_y1", y1, dy), bin_of("_y2", y1, dy))))
        rows = points.withColumn("_row", F.monotonically_increasing_id()).withColumn("_px", bin_of(x, x1, dx)).withColumn("_py", bin_of(y, y1, dy))
        spread = F.broadcast(spread) if stats["n"] <= BROADCAST_CELLS else spread
        inside = (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by")) & rect_has_point(rect("_x1", "_y1", "_x2", "_y2"), x, y)
        joined = rows.join(spread, inside, "left").drop("_px", "_py", "_bx", "_by")
    # Cells that do not overlap give one row for each point; else the first in order is kept.
    if not _disjoint(cells, stats["n"]):
        first = Window.partitionBy("_row").orderBy(F.col("_order").asc_nulls_last())
        joined = joined.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    found = F.col("_cell").cast("long")
    return joined.withColumn(out, found if missing is None else F.coalesce(found, F.lit(missing))).drop("_row", "_cell", "_order", *names.values())


def _disjoint(cells: DataFrame, n: int) -> bool:
    """Whether no two cells overlap, tested for tables of a bounded size only."""
    if n > FEW_CELLS:
        return False
    a = cells.select(F.col("cell_id").alias("i"), *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = cells.select(F.col("cell_id").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    on = (F.col("i") < F.col("j")) & (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2"))
    return a.join(F.broadcast(b), on).limit(1).count() == 0


def meeting(shapes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Each shape (x1..z2) beside each space whose box overlaps its own; the space's box gets the prefix s_.

    A few spaces are broadcast and compared with every shape. More are cut, like
    the shapes, into the bins of a coarse grid over their common area, joined on
    the bin, and a pair comes out in the bin of the low corner of its common box.
    """
    named = spaces.withColumnsRenamed({c: f"s_{c}" for c in BOX})
    other = [f"s_{c}" for c in BOX]
    overlap = boxes_overlap(box(), box(*other))
    s = named.agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in other[:3]), *(F.max(c).alias(c) for c in other[3:])).first()
    if s["n"] <= FEW_CELLS:
        return shapes.join(F.broadcast(named), overlap)
    bins = max(1, min(64, round(s["n"] ** (1 / 3))))
    low = [s[c] for c in other[:3]]
    step = [(s[h] - w) / bins or 1.0 for h, w in zip(other[3:], low, strict=True)]

    def bin_of(v: Column, i: int) -> Column:
        return F.least(F.greatest(F.floor((v - F.lit(low[i])) / F.lit(step[i])), F.lit(0)), F.lit(bins - 1)).cast("int")

    def binned(rows: DataFrame, box_names: list[str]) -> DataFrame:
        for i in range(3):
            rows = rows.withColumn(f"_b{i}", F.explode(F.sequence(bin_of(F.col(box_names[i]), i), bin_of(F.col(box_names[i + 3]), i))))
        return rows

    near = shapes.where(boxes_overlap(box(), box(*(F.lit(s[c]) for c in other))))
    spread = binned(named, other)
    spread = F.broadcast(spread) if spread.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else spread
    here = overlap
    for i, (a, b) in enumerate(zip(BOX[:3], other[:3], strict=True)):
        here = here & (bin_of(F.greatest(F.col(a), F.col(b)), i) == F.col(f"_b{i}"))
    return binned(near, list(BOX)).join(spread, ["_b0", "_b1", "_b2"]).where(here).drop("_b0", "_b1", "_b2")


def replicate(shapes: DataFrame, spaces: DataFrame, source: str | None = None) -> DataFrame:
    """Each shape (x1..z2) with every space_id that its box overlaps.

    source names a struct column, the box of the partition that a shape was
    read from: then only the copy whose low corner lies in that partition is
    passed on, so that shapes stored several times come out once for each space.
    """
    if source:
        low = F.col(source)
        shapes = shapes.where((F.col("x1") >= low["x1"]) & (F.col("x1") < low["x2"]) & (F.col("y1") >= low["y1"]) & (F.col("y1") < low["y2"]) & (F.col("z1") >= low["z1"]) & (F.col("z1") < low["z2"]))
    return meeting(shapes, spaces.select("space_id", *BOX)).drop(*(f"s_{c}" for c in BOX))


def most_overlap(shapes: DataFrame, spaces: DataFrame, key: str) -> DataFrame:
    """Each shape with the one space_id of the largest common volume, the least id of equals; null without overlap.

    Rows that repeat a key stand for one shape.
    """
    pairs = meeting(shapes.select(key, *BOX), spaces.select("space_id", *BOX))
    volume = box_volume(box_intersection(box(), box(*(f"s_{c}" for c in BOX))))
    best = pairs.groupBy(key).agg(F.max(F.struct(volume.alias("v"), (-F.col("space_id")).alias("s"))).alias("best"))
    return shapes.dropDuplicates([key]).join(best.select(key, (-F.col("best.s")).alias("space_id")), key, "left").select(*shapes.columns, "space_id")


def partition_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of partitions of two stores whose boxes overlap: (a_id, b_id)."""
    met = meeting(a.select(F.col("space_id").alias("a_id"), *BOX), b.select(F.col("space_id").alias("b_id"), *BOX))
    return met.select("a_id", "b_id")


def spatial_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, spaces: DataFrame) -> DataFrame:
    """(a_key, b_key) of all shapes whose boxes overlap.

    Both sides are dealt to the spaces that they overlap and joined within each;
    a pair comes out in the space that holds the low corner of its common box.
    Shapes travel with their spaces' boxes, so no other join is needed; adaptive
    execution splits a space that holds a large share of the shapes.
    """
    at = [F.col(f"s_{c}") for c in BOX]
    one = meeting(a.select(F.col(a_key).alias("_a"), *BOX), spaces.select("space_id", *BOX)).select("_a", "space_id", *(F.col(c).alias(f"a_{c}") for c in BOX), *at)
    two = meeting(b.select(F.col(b_key).alias("_b"), *BOX), spaces.select("space_id", *BOX)).select("_b", "space_id", *(F.col(c).alias(f"b_{c}") for c in BOX))
    met = one.join(two, "space_id").where(boxes_overlap(box(*(f"a_{c}" for c in BOX)), box(*(f"b_{c}" for c in BOX))))
    corner = F.lit(True)
    for axis in "xyz":
        low = F.greatest(f"a_{axis}1", f"b_{axis}1")
        corner = corner & (low >= F.col(f"s_{axis}1")) & (low < F.col(f"s_{axis}2"))
    return met.where(corner).select(F.col("_a").alias(a_key if a_key != b_key else f"a_{a_key}"), F.col("_b").alias(b_key if a_key != b_key else f"b_{b_key}"))


def nearest(points: DataFrame, x: float, y: float, k: int, key: str, px: str = "lng", py: str = "lat") -> DataFrame:
    """The k points nearest to a place, with their distance; equals in order of key."""
    return points.withColumn("distance", planar_distance(px, py, x, y)).orderBy("distance", key).limit(k)


def nearest_join(queries: DataFrame, points: DataFrame, k: int, q_key: str, p_key: str, x: str = "lng", y: str = "lat", per_cell: int | None = None) -> DataFrame:
    """(q_key, p_key, distance, rank): each query's k nearest points, whatever the number of queries.

    Points are dealt to a grid over their area of some per_cell points a cell. A
    query first asks the smallest square of cells around its own that holds k
    points; its k-th distance there bounds the answer, which then lies in the
    cells that a circle of that radius meets. Both steps join on the cell. Squares
    are found in a table of counts by cell, by rings of cells that double. Queries and
    points without coordinates have no neighbours.
    """
    points = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(p_key).alias("_p"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    q = queries.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(q_key).alias("_q"), F.col(x).alias("_qx"), F.col(y).alias("_qy"))
    s = points.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("x1"), F.min("_y").alias("y1"), F.max("_x").alias("x2"), F.max("_y").alias("y2")).first()
    side = max(1, math.ceil(math.sqrt(s["n"] / (per_cell or 2 * k))))
    x1, y1 = s["x1"] or 0.0, s["y1"] or 0.0
    dx, dy = ((s["x2"] or 0.0) - x1) / side or 1.0, ((s["y2"] or 0.0) - y1) / side or 1.0
    # Queries outside the points' area belong to the cell at its edge; the same clamped order holds for points.
    cell = lambda v, low, d: F.least(F.greatest(F.floor((v - F.lit(low)) / F.lit(d)), F.lit(0)), F.lit(side - 1)).cast("int")
    placed = points.select("*", cell(F.col("_x"), x1, dx).alias("_cx"), cell(F.col("_y"), y1, dy).alias("_cy"))
    asked = q.select("*", cell(F.col("_qx"), x1, dx).alias("_ax"), cell(F.col("_qy"), y1, dy).alias("_ay"))

    def around(rows: DataFrame, xs: tuple[Column, Column], ys: tuple[Column, Column]) -> DataFrame:
        clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(side - 1)).cast("int")
        rows = rows.withColumn("_cx", F.explode(F.sequence(clip(xs[0]), clip(xs[1]))))
        return rows.withColumn("_cy", F.explode(F.sequence(clip(ys[0]), clip(ys[1]))))

    counts = placed.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    homes = asked.select("_ax", "_ay").distinct()
    reach, ring = None, 0
    while True:
        near = around(homes, (F.col("_ax") - ring, F.col("_ax") + ring), (F.col("_ay") - ring, F.col("_ay") + ring))
        held = near.join(counts, ["_cx", "_cy"]).groupBy("_ax", "_ay").agg(F.sum("_n").alias("_n"))
        full = (held if ring >= side else held.where(F.col("_n") >= k)).select("_ax", "_ay", F.lit(ring).alias("_ring"))
        full = cut(full)
        reach = full if reach is None else reach.unionByName(full)
        homes = cut(homes.join(full, ["_ax", "_ay"], "left_anti"))
        if ring >= side or homes.isEmpty():
            break
        ring = 2 * ring or 1
    asked = asked.join(reach, ["_ax", "_ay"])
    far = planar_distance("_x", "_y", "_qx", "_qy")
    order = Window.partitionBy("_q").orderBy("distance", "_p")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.join(placed, ["_cx", "_cy"]).withColumn("distance", far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ranked(around(asked, (F.col("_ax") - F.col("_ring"), F.col("_ax") + F.col("_ring")), (F.col("_ay") - F.col("_ring"), F.col("_ay") + F.col("_ring"))))
    # A little more than the k-th distance, for rounding; with fewer than k points all cells were asked.
    bound = first.groupBy("_q").agg((F.max("distance") * (1 + 1e-9) + 1e-12).alias("_r"))
    asked = q.join(bound, "_q")
    span = lambda v, low, d: (cell(F.col(v) - F.col("_r"), low, d), cell(F.col(v) + F.col("_r"), low, d))
    out = ranked(around(asked, span("_qx", x1, dx), span("_qy", y1, dy)))
    return out.select(F.col("_q").alias(q_key), F.col("_p").alias(p_key), "distance", "rank")


def lookup_towers(calls: DataFrame, towers: DataFrame, *columns: Column) -> DataFrame:
    """Calls with their tower's columns; calls of unknown towers drop out. The planner chooses the join by size."""
    return calls.join(towers.select("bid", *columns) if columns else towers, "bid")
