"""Samples, density grids and thinning of point sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geom import col
from trackloom.operators.partition.grid import Grid


def bernoulli(rows: DataFrame, ratio: float = 0.01, seed: int = 1) -> DataFrame:
    return rows.sample(withReplacement=False, fraction=min(1.0, ratio), seed=seed)


def exact(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows at random, all if there are fewer."""
    return rows.orderBy(F.rand(seed)).limit(n)


def by_bytes(rows: DataFrame, text: str, budget: int, key: str, seed: int = 1, buckets: int = 256) -> DataFrame:
    """Rows in random order for as long as their texts fit the budget of bytes.

    The order is a hash of key and seed. Bytes are summed by its bucket first;
    whole buckets are taken, and rows one by one in the bucket that the budget ends in.
    """
    size = F.octet_length(F.col(text)) + 1
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 40))
    placed = rows.withColumns({"_h": h, "_size": size}).withColumn("_b", F.floor(F.col("_h") * buckets / F.lit(1 << 40)))
    sums = placed.groupBy("_b").agg(F.sum("_size").alias("_w"))
    sums = sums.withColumn("_cum", F.sum("_w").over(Window.orderBy("_b")))
    sums = sums.select("_b", (F.col("_cum") - F.col("_w")).alias("_before"), "_cum").where(F.col("_before") < budget)
    near = placed.join(F.broadcast(sums), "_b")
    whole = near.where(F.col("_cum") <= budget)
    edge = near.where(F.col("_cum") > budget)
    order = Window.partitionBy("_b").orderBy("_h", key)
    edge = edge.where(F.col("_before") < budget).withColumn("_sum", F.col("_before") + F.sum("_size").over(order)).where(F.col("_sum") <= budget)
    return whole.select(*rows.columns).unionByName(edge.select(*rows.columns))


def density(points: DataFrame, area: tuple[float, float, float, float], columns: int, rows: int, x: str = "x", y: str = "y") -> DataFrame:
    """(col, row, n, cx, cy) of the cells of a grid that hold points; the far edges belong to the last cells."""
    dx, dy = (area[2] - area[0]) / columns, (area[3] - area[1]) / rows
    place = lambda v, low, d, n: F.least(F.floor((col(v) - F.lit(low)) / F.lit(d)), F.lit(n - 1)).cast("int")
    inside = col(x).between(area[0], area[2]) & col(y).between(area[1], area[3])
    cells = points.where(inside).select(place(x, area[0], dx, columns).alias("col"), place(y, area[1], dy, rows).alias("row"))
    counted = cells.groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"cx": F.lit(area[0]) + (F.col("col") + 0.5) * F.lit(dx), "cy": F.lit(area[1]) + (F.col("row") + 0.5) * F.lit(dy)})


def densest(cells: DataFrame, rate: float) -> DataFrame:
    """The top share of density()'s cells, by count, then column, then row."""
    n = cells.count()
    return cells.orderBy(F.desc("n"), "col", "row").limit(int(n * rate))


def count_percentiles(cells: DataFrame, percents: list[int]) -> DataFrame:
    """(percent, n): count at rank int(cells * percent / 100) in ascending order."""
    total = cells.count()
    ranks = [(p, min(total - 1, int(total * p / 100))) for p in percents] if total else []
    # Equal counts are one row here, so few rows are ranked whatever the number of cells.
    sums = cells.groupBy("n").agg(F.count(F.lit(1)).alias("cells"))
    order = Window.orderBy("n")
    sums = sums.withColumn("upto", F.sum("cells").over(order)).withColumn("from", F.col("upto") - F.col("cells"))
    at = cells.sparkSession.createDataFrame(ranks, "percent int, rank long")
    return F.broadcast(at).join(sums, (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))).select("percent", "n")


def proportional_points(cells: DataFrame, grid: Grid, rate: int, seed: int = 1) -> DataFrame:
    """Random points in density()'s cells, (n + rate div 2) div rate of them in each."""
    dx, dy = grid.step
    k = F.floor((F.col("n") + rate // 2) / rate).cast("int")
    some = cells.withColumn("_k", k).where("_k > 0").withColumn("i", F.explode(F.expr("sequence(1, _k)")))
    return some.select("col", "row", "i", (F.col("cx") + (F.rand(seed) - 0.5) * F.lit(dx)).alias("x"), (F.col("cy") + (F.rand(seed + 1) - 0.5) * F.lit(dy)).alias("y"))
