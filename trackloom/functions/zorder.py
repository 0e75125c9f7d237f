"""Morton codes as column arithmetic: x on odd bits, y on even bits, 31 bits each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.geom import col, let

TOP = (1 << 31) - 1
#: Masks of the bit spread, widest first (fixed values).
_MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(v: Column) -> Column:
    for shift, mask in _MASKS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _squeeze(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_MASKS[-1][1]))
    for (shift, _), (_, mask) in zip(_MASKS[::-1], [*_MASKS[-2::-1], (0, 0x00000000FFFFFFFF)], strict=True):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
    return v


def interleave(x, y) -> Column:
    """Morton code of two integers from 0 to 2**31 - 1."""
    return F.shiftleft(_spread(col(x).cast("long")), 1).bitwiseOR(_spread(col(y).cast("long")))


def deinterleave(z) -> tuple[Column, Column]:
    return _squeeze(F.shiftrightunsigned(col(z), 1)), _squeeze(col(z))


def scaled(v, low: float, high: float) -> Column:
    """v's place in [low, high] as an integer from 0 to 2**31 - 1, cut off at both ends."""
    place = (col(v) - F.lit(float(low))) * F.lit(float(TOP)) / F.lit(float(high) - float(low))
    return F.greatest(F.least(place, F.lit(float(TOP))), F.lit(0.0)).cast("long")


def encode(x, y, area: tuple[float, float, float, float]) -> Column:
    """Morton code of a point inside the area (x1, y1, x2, y2)."""
    return interleave(scaled(x, area[0], area[2]), scaled(y, area[1], area[3]))


def decode(z, area: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """The point at the low corner of a code's place."""
    ix, iy = deinterleave(z)
    x = F.lit(float(area[0])) + ix * F.lit(area[2] - area[0]) / F.lit(float(TOP))
    y = F.lit(float(area[1])) + iy * F.lit(area[3] - area[1]) / F.lit(float(TOP))
    return x, y


def fill_right(v) -> Column:
    """All bits from the highest set one down."""

    def spread(shift: int):
        return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, shift))

    v = col(v)
    for shift in (1, 2, 4, 8, 16, 32):
        v = let(v, spread(shift))
    return v


def range_cell(z_min, z_max) -> tuple[Column, Column, Column, Column]:
    """Integer corners of the smallest quadrant that holds both codes (common prefix)."""
    z_min, z_max = col(z_min), col(z_max)
    mask = fill_right(z_min.bitwiseXOR(z_max))

    def corners(low: Column, m: Column) -> Column:
        x1, y1 = deinterleave(low.bitwiseAND(F.bitwise_not(m)))
        x2, y2 = deinterleave(low.bitwiseOR(m))
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    out = let(z_min, lambda low: let(mask, lambda m: corners(low, m)))
    return out["x1"], out["y1"], out["x2"], out["y2"]


def significant_bits(v) -> Column:
    v = col(v).cast("long")
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def log2_floor(v) -> Column:
    return significant_bits(v) - 1
