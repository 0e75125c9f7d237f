"""Windowed queries on GPS streams. Every function takes a batch or a streaming frame with a timestamp `ts`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import trajectory


@dataclass(frozen=True)
class Span:
    """Length and slide of a window in seconds."""

    length: int
    slide: int


#: Windows of the known workloads (fixed values).
WORKLOADS = {"report": Span(100, 20), "sql": Span(10, 1), "short": Span(8, 2), "tumbling": Span(3, 3), "uneven": Span(10, 3), "long": Span(200, 20)}
LATE = "10 seconds"


def windowed(gps: DataFrame, span: Span, late: str = LATE) -> DataFrame:
    """gps with w_start and w_end, a row for each window that holds it; streams get a watermark."""
    rows = gps.withWatermark("ts", late) if gps.isStreaming else gps
    w = F.window("ts", f"{span.length} seconds", f"{span.slide} seconds")
    return rows.withColumn("window", w)


def flat(rows: DataFrame) -> DataFrame:
    """The window's ends as columns w_start and w_end in place of the struct."""
    return rows.withColumns({"w_start": F.col("window.start"), "w_end": F.col("window.end")}).drop("window")


def count_by_car(gps: DataFrame, span: Span, area=trajectory.SQL_AREA) -> DataFrame:
    return flat(trajectory.count_by_car(windowed(gps, span), area, top=0, by=("window",)))


def speed_by_car(gps: DataFrame, span: Span, area=trajectory.SQL_AREA, speed: float = trajectory.SQL_SPEED) -> DataFrame:
    return flat(trajectory.speed_by_car(windowed(gps, span), area, speed, by=("window",)))


def distinct_cars(gps: DataFrame, span: Span) -> DataFrame:
    """Cars in each window, exact: each car's first row in a window is kept, and those are counted."""
    once = windowed(gps, span).select("window", "car_id").dropDuplicates(["window", "car_id"])
    return flat(once.groupBy("window").agg(F.count("car_id").alias("cars")))


def object_trajectories(gps: DataFrame, span: Span, ids=trajectory.OBJECTS) -> DataFrame:
    """Points of the given objects in each window (continuous report)."""
    return flat(windowed(trajectory.of_objects(gps, ids), span))


def rectangle_report(gps: DataFrame, span: Span, area=trajectory.WINDOW_AREA) -> DataFrame:
    """(w_start, w_end, car_id, avg_speed) for each window and car in a rectangle; the pack's other answers follow from it."""
    return flat(trajectory.averages_inside(windowed(gps, span), area, by=("window",)))


def rectangle_summary(gps: DataFrame, span: Span, area=trajectory.WINDOW_AREA, limit: float = trajectory.WINDOW_SPEED) -> DataFrame:
    """One row for each window: cars, mean of means, fastest and slowest car, cars at the limit or above. For batches, or in foreachBatch."""
    per_car = rectangle_report(gps, span, area)
    best = F.max(F.struct("avg_speed", (-F.col("car_id")).alias("c")))
    least = F.min(F.struct("avg_speed", "car_id"))
    return per_car.groupBy("w_start", "w_end").agg(
        F.count(F.lit(1)).alias("cars"),
        F.avg("avg_speed").alias("avg_speed"),
        (-best["c"]).alias("fastest"),
        least["car_id"].alias("slowest"),
        F.count_if(F.col("avg_speed") >= limit).alias("high_speed_cars"),
    )


def registered(gps: DataFrame, queries: DataFrame) -> DataFrame:
    """Points of the objects in a table of registered queries (query_id, car_id), which is read anew for each micro-batch."""
    return gps.join(queries, "car_id")
