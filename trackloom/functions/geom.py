"""Column functions on points, rectangles (x1, y1, x2, y2) and boxes (x1, y1, z1, x2, y2, z2).

Shapes are flat columns or structs with these field names, so that filters and
column pruning reach the scan. Boundary rules differ by predicate on purpose:
point in rectangle is half-open, point in box closed, overlaps are strict (shared
edges do not count), and the area filters of trajectory queries are open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
RECT, BOX = ("x1", "y1", "x2", "y2"), ("x1", "y1", "z1", "x2", "y2", "z2")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, for expressions that would double at every step."""
    return F.transform(F.array(value), body)[0]


def rect(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.struct(*(col(v).alias(n) for n, v in zip(RECT, (x1, y1, x2, y2), strict=True)))


def box(x1="x1", y1="y1", z1="z1", x2="x2", y2="y2", z2="z2") -> Column:
    return F.struct(*(col(v).alias(n) for n, v in zip(BOX, (x1, y1, z1, x2, y2, z2), strict=True)))


# distances


def planar_distance(ax, ay, bx, by) -> Column:
    return F.sqrt(F.pow(col(ax) - col(bx), 2) + F.pow(col(ay) - col(by), 2))


def spatial_distance(ax, ay, az, bx, by, bz) -> Column:
    return F.sqrt(F.pow(col(ax) - col(bx), 2) + F.pow(col(ay) - col(by), 2) + F.pow(col(az) - col(bz), 2))


def haversine(lng1, lat1, lng2, lat2, whole_metres: bool = True, swap_axes: bool = False) -> Column:
    """Great-circle distance in metres, cut to whole metres by default.

    swap_axes reads each pair as (latitude, longitude), as older data does.
    """
    lng1, lat1, lng2, lat2 = map(col, (lat1, lng1, lat2, lng2) if swap_axes else (lng1, lat1, lng2, lat2))
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng1) - F.radians(lng2)) / 2), 2)
    metres = 2 * F.asin(F.sqrt(h)) * EARTH_RADIUS
    if not whole_metres:
        return metres
    scaled = F.floor(metres * 10000 + 0.5).cast("long")
    return F.floor(scaled / 10000).cast("long")


# rectangles


def rect_has_point(r: Column, x, y) -> Column:
    x, y = col(x), col(y)
    return (x >= r["x1"]) & (x < r["x2"]) & (y >= r["y1"]) & (y < r["y2"])


def rect_has_rect(r: Column, s: Column) -> Column:
    return (s["x1"] >= r["x1"]) & (s["x2"] <= r["x2"]) & (s["y1"] >= r["y1"]) & (s["y2"] <= r["y2"])


def rects_overlap(r: Column, s: Column) -> Column:
    return (s["x2"] > r["x1"]) & (r["x2"] > s["x1"]) & (s["y2"] > r["y1"]) & (r["y2"] > s["y1"])


def in_area(x, y, area: tuple[float, float, float, float]) -> Column:
    """Strictly inside (x1, y1, x2, y2)."""
    x, y = col(x), col(y)
    return (x > F.lit(area[0])) & (x < F.lit(area[2])) & (y > F.lit(area[1])) & (y < F.lit(area[3]))


def rect_centre(r: Column) -> tuple[Column, Column]:
    return (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2


def rect_size(r: Column) -> tuple[Column, Column]:
    return r["x2"] - r["x1"], r["y2"] - r["y1"]


def rect_buffer(r: Column, dx, dy) -> Column:
    dx, dy = col(dx), col(dy)
    return rect(r["x1"] - dx, r["y1"] - dy, r["x2"] + dx, r["y2"] + dy)


def rect_translate(r: Column, dx, dy) -> Column:
    dx, dy = col(dx), col(dy)
    return rect(r["x1"] + dx, r["y1"] + dy, r["x2"] + dx, r["y2"] + dy)


def _gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(lo2 - hi1, lo1 - hi2, F.lit(0.0))


def _reach(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(hi2 - lo1, hi1 - lo2)


def rect_point_min(r: Column, x, y) -> Column:
    x, y = col(x), col(y)
    return F.sqrt(F.pow(_gap(r["x1"], r["x2"], x, x), 2) + F.pow(_gap(r["y1"], r["y2"], y, y), 2))


def rect_point_max(r: Column, x, y) -> Column:
    x, y = col(x), col(y)
    return F.sqrt(F.pow(F.greatest(F.abs(x - r["x1"]), F.abs(x - r["x2"])), 2) + F.pow(F.greatest(F.abs(y - r["y1"]), F.abs(y - r["y2"])), 2))


def rect_rect_min(r: Column, s: Column) -> Column:
    return F.sqrt(F.pow(_gap(r["x1"], r["x2"], s["x1"], s["x2"]), 2) + F.pow(_gap(r["y1"], r["y2"], s["y1"], s["y2"]), 2))


def rect_rect_max(r: Column, s: Column) -> Column:
    return F.sqrt(F.pow(_reach(r["x1"], r["x2"], s["x1"], s["x2"]), 2) + F.pow(_reach(r["y1"], r["y2"], s["y1"], s["y2"]), 2))


# boxes


def box_has_point(b: Column, x, y, z) -> Column:
    x, y, z = col(x), col(y), col(z)
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"]) & z.between(b["z1"], b["z2"])


def box_has_box(b: Column, c: Column) -> Column:
    return (c["x1"] >= b["x1"]) & (c["x2"] <= b["x2"]) & (c["y1"] >= b["y1"]) & (c["y2"] <= b["y2"]) & (c["z1"] >= b["z1"]) & (c["z2"] <= b["z2"])


def box_meets_point(b: Column, x, y, z) -> Column:
    """Half-open in all three directions."""
    z = col(z)
    return rect_has_point(b, x, y) & (z >= b["z1"]) & (z < b["z2"])


def boxes_overlap(b: Column, c: Column) -> Column:
    return rects_overlap(b, c) & (c["z2"] > b["z1"]) & (b["z2"] > c["z1"])


def box_intersection(b: Column, c: Column) -> Column:
    """The common box, null where there is none."""
    low = [F.greatest(b[k], c[k]) for k in ("x1", "y1", "z1")]
    high = [F.least(b[k], c[k]) for k in ("x2", "y2", "z2")]
    return F.when(boxes_overlap(b, c), box(*low, *high))


def box_union(b: Column, c: Column) -> Column:
    return box(*(F.least(b[k], c[k]) for k in ("x1", "y1", "z1")), *(F.greatest(b[k], c[k]) for k in ("x2", "y2", "z2")))


def box_volume(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) * (b["z2"] - b["z1"])


def box_centre(b: Column) -> tuple[Column, Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, (b["z1"] + b["z2"]) / 2


def box_valid(b: Column) -> Column:
    """False for a null box and for the NaN marker of invalid shapes."""
    return F.coalesce(~F.isnan(b["x1"]), F.lit(False))


def ulp(x) -> Column:
    """Distance from |x| to the next larger double, for normal numbers."""
    x = F.abs(col(x))
    guess = F.floor(F.log2(x))
    exponent = F.when(F.pow(F.lit(2.0), guess) > x, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= x, guess + 1).otherwise(guess)
    return F.when(x == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), exponent - 52))


def point_box(x, y, z) -> Column:
    """A point's box, with a positive extent of one ulp."""
    x, y, z = col(x), col(y), col(z)
    return box(x, y, z, x + ulp(x), y + ulp(y), z + ulp(z))


# orders of shapes: struct columns to sort by


def point_order(x="x", y="y", z="z") -> Column:
    return F.struct(col(z).alias("z"), col(x).alias("x"), col(y).alias("y"))


def rect_order(r: Column) -> Column:
    return F.struct(*(r[k].alias(k) for k in RECT))


def box_order(b: Column) -> Column:
    return F.struct(*(b[k].alias(k) for k in ("z1", "x1", "y1", "z2", "x2", "y2")))


# text forms


def to_csv(*columns) -> Column:
    """Comma-separated text of a shape, an id or further fields put before or after."""
    return F.concat_ws(",", *(col(c).cast("string") for c in columns))


def from_csv(text, kind: str) -> Column:
    """Struct of a shape's text form; kind: point, rect, box or a list of fields "name type, ..."."""
    fields = {"point": "x double, y double, z double", "rect": "x1 double, y1 double, x2 double, y2 double", "box": "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"}
    return F.from_csv(col(text), fields.get(kind, kind))
