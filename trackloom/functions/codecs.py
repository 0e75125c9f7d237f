"""Row keys, byte and text forms of numbers, dates and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.geom import col

#: Region of points outside every cell.
OUTSIDE = (1 << 63) - 1
SALT = 7


def salted_region(cell, car, salt: int = SALT) -> Column:
    """Cell in the upper half, the car's remainder in the lower; OUTSIDE where the cell is null or negative."""
    cell = col(cell).cast("long")
    return F.when(cell.isNull() | (cell < 0), F.lit(OUTSIDE)).otherwise(F.shiftleft(cell, 32) + F.pmod(col(car).cast("long"), F.lit(salt)))


def hex_key(value, digits: int) -> Column:
    """Big-endian hexadecimal of a non-negative number."""
    return F.lpad(F.hex(col(value).cast("long")), digits, "0")


def row_key(region, car, time) -> Column:
    """Binary key: 8 bytes region, 4 bytes car, 8 bytes time, big-endian."""
    return F.unhex(F.concat(hex_key(region, 16), hex_key(car, 8), hex_key(time, 16)))


def reverse_bytes(hexed) -> Column:
    """Hexadecimal with its bytes in the other order."""
    pairs = F.regexp_extract_all(col(hexed), F.lit("(..)"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def pad_bytes(text, size: int = 16) -> Column:
    """Text cut or filled with blanks to a number of characters."""
    return F.rpad(col(text), size, " ")


def from_hex(text) -> Column:
    return F.conv(col(text), 16, 10).cast("long")


def map_text(m) -> Column:
    """[k#v,k#v] of a map, in order of keys."""
    entries = F.array_sort(F.map_entries(col(m)))
    return F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: F.concat_ws("#", e["key"], e["value"])), ","), F.lit("]"))


def text_map(text) -> Column:
    inside = F.regexp_replace(col(text), r"^\[|\]$", "")
    return F.when(inside == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(inside, F.lit(","), F.lit("#")))


def list_text(items) -> Column:
    """a;b;c; of an array, in ascending order."""
    return F.array_join(F.transform(F.array_sort(col(items)), lambda x: F.concat(x.cast("string"), F.lit(";"))), "")


def text_list(text) -> Column:
    return F.filter(F.split(col(text), ";"), lambda x: x != "")


def date_key(ts) -> Column:
    """y-m-d without padding."""
    return F.concat_ws("-", F.year(ts).cast("string"), F.month(ts).cast("string"), F.day(ts).cast("string"))


def seconds(ts) -> Column:
    """Whole seconds since 1970, as a long."""
    ts = col(ts)
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def size_bytes(text: str) -> int:
    """Bytes of a size such as 10, 3.5k, 2m, 1.g or 1t."""
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    text = text.strip().lower()
    if text and text[-1] in units:
        return int(float(text[:-1]) * (1 << units[text[-1]]))
    return int(float(text))
