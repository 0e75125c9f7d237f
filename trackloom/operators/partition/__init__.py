"""Spatial partitioners: built on the driver from a bounded sample, applied as columns or joins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from trackloom.operators.partition.base import Partitioner, assign_points, overlapping
from trackloom.operators.partition.grid import BoxGrid, Grid
from trackloom.operators.partition.kd import KdTree
from trackloom.operators.partition.quad import QuadTree, QuadTreeIndex
from trackloom.operators.partition.rtree import pack, tree_shape
from trackloom.operators.partition.zcurve import ZCurve

KINDS = {"grid": Grid, "kd": KdTree, "quad": QuadTree, "zcurve": ZCurve}
#: Policies whose partitions are bounded by their content, and whose shapes are in every cell that they meet; see sinks.bounded (fixed values).
PACKED = ("heap", "rtree", "r+tree", "str", "str+")
REPLICATED = ("grid", "r+tree", "str+")


def build_index(kind: str, points: DataFrame, area: tuple[float, float, float, float], n: int, x: str = "x", y: str = "y", sample: int = 100_000) -> Partitioner:
    """A partitioner of about n cells from at most `sample` points."""
    if kind not in KINDS:
        raise ValueError(f"unknown index {kind!r}; one of {', '.join(KINDS)}")
    return KINDS[kind].build(points, area, n, x, y, sample)


def load(spec: str) -> Partitioner:
    """The partitioner that spec() wrote, in another job."""
    state = json.loads(spec)
    if state["kind"] not in KINDS:
        raise ValueError(f"unknown index {state['kind']!r}")
    return KINDS[state["kind"]].restored(tuple(state["area"]), state)


def partition_count(size: int, block: int, overhead: float = 0.1) -> int:
    """Partitions of at most a block each, with room for the index."""
    return max(1, -(-int(size * (1 + overhead)) // block))


__all__ = [
    "KINDS",
    "PACKED",
    "REPLICATED",
    "BoxGrid",
    "Grid",
    "KdTree",
    "Partitioner",
    "QuadTree",
    "QuadTreeIndex",
    "ZCurve",
    "assign_points",
    "build_index",
    "load",
    "overlapping",
    "pack",
    "partition_count",
    "tree_shape",
]
