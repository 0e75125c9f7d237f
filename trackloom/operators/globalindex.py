"""The table of a store's partitions (the master table) and what it answers without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geom import BOX, box, boxes_overlap

MASTER = "space_id int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, record_count long, size long, filename string"


def master_of(rows: DataFrame, by: str = "cell_id", size: Column | None = None) -> DataFrame:
    """Bounds, rows and bytes of each partition; rows has x1..z2 and the partition's column."""
    size = F.lit(0) if size is None else size
    return rows.groupBy(F.col(by).alias("space_id")).agg(*(F.min(c).alias(c) for c in BOX[:3]), *(F.max(c).alias(c) for c in BOX[3:]), F.count(F.lit(1)).alias("record_count"), F.sum(size).cast("long").alias("size"))


def range_query(master: DataFrame, x1: float, y1: float, z1: float, x2: float, y2: float, z2: float) -> DataFrame:
    """Partitions whose bounds overlap a box."""
    return master.where(boxes_overlap(box(), box(x1, y1, z1, x2, y2, z2)))


def bounds(master: DataFrame) -> DataFrame:
    """One row: the box of all partitions, their number, rows and bytes."""
    return master.agg(*(F.min(c).alias(c) for c in BOX[:3]), *(F.max(c).alias(c) for c in BOX[3:]), F.count(F.lit(1)).alias("partitions"), F.sum("record_count").alias("record_count"), F.sum("size").alias("size"))


def prune(rows: DataFrame, master: DataFrame, area: tuple[float, float, float, float, float, float], by: str = "cell_id") -> DataFrame:
    """rows of a store partitioned by `by`, read only where the master table says that the box may be met.

    The ids become a literal list, so that the partitions are chosen when the
    query is planned. The master table has a row for each partition, whose number the store bounds.
    """
    ids = [r["space_id"] for r in range_query(master, *area).select("space_id").collect()]
    return rows.where(F.col(by).isin(ids)) if ids else rows.where(F.lit(False))


def clip(master: DataFrame, cells: DataFrame) -> DataFrame:
    """Bounds cut to the partitions' cells, for stores that replicate shapes."""
    named = cells.select("space_id", *(F.col(c).alias(f"c_{c}") for c in BOX))
    low = [F.greatest(c, f"c_{c}").alias(c) for c in BOX[:3]]
    high = [F.least(c, f"c_{c}").alias(c) for c in BOX[3:]]
    rest = [c for c in master.columns if c not in (*BOX, "space_id")]
    return master.join(named, "space_id").select("space_id", *low, *high, *rest)


def expand(master: DataFrame, cells: DataFrame) -> DataFrame:
    """Bounds that hold the partitions' cells and what is in them, for stores whose shapes reach beyond their cell."""
    named = cells.select("space_id", *(F.col(c).alias(f"c_{c}") for c in BOX))
    low = [F.least(c, f"c_{c}").alias(c) for c in BOX[:3]]
    high = [F.greatest(c, f"c_{c}").alias(c) for c in BOX[3:]]
    rest = [c for c in master.columns if c not in (*BOX, "space_id")]
    return master.join(named, "space_id").select("space_id", *low, *high, *rest)
