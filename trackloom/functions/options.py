"""Options of command lines: paths, key:value pairs, flags, and sizes with a unit."""

from __future__ import annotations

#: Bytes of the units of a size (fixed values).
UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def size(text: str) -> int:
    """Bytes of a whole number, or of one with a unit set apart by a point: `4096`, `64.m`, `2.G`."""
    number, _, unit = text.strip().partition(".")
    unit = unit.lower()[:1]
    if not number.isdigit() or unit not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(number) * UNITS[unit]


def parse(args: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """Paths in their order, and options: `key:value`, `-flag` for true, `-no-flag` for false; the last of equal names holds.

    What has a colon followed by a slash is a path with a scheme.
    """
    paths: list[str] = []
    found: dict[str, str | bool] = {}
    for arg in args:
        name, colon, value = arg.partition(":")
        if arg.startswith("-no-") and len(arg) > 4:
            found[arg[4:].lower()] = False
        elif arg.startswith("-") and len(arg) > 1:
            found[arg[1:].lower()] = True
        elif colon and name and not value.startswith("/"):
            found[name.lower()] = value
        else:
            paths.append(arg)
    return paths, found
