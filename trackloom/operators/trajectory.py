"""Area, object and speed queries over GPS points, for batch and streaming frames alike.

gps(time or ts, car_id, lng, lat, speed). Functions that take `by` group by
further columns, such as a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geom import in_area

#: Default areas (x1, y1, x2, y2), speed limits and objects (fixed values).
SQL_AREA, SQL_SPEED = (116.2, 39.85, 116.5, 40.1), 80
MBR_AREA, MBR_SPEED = (116.232656, 39.869983, 116.544261, 40.021769), 80
WINDOW_AREA, WINDOW_SPEED = (116.392086, 39.907109, 116.414651, 39.920944), 40
OBJECTS = (9997, 9566, 5116, 10909, 12211)


def of_objects(gps: DataFrame, ids=OBJECTS) -> DataFrame:
    return gps.where(F.col("car_id").isin(list(ids)))


def inside(gps: DataFrame, area=MBR_AREA) -> DataFrame:
    return gps.where(in_area("lng", "lat", area))


def fast_inside(gps: DataFrame, area=SQL_AREA, speed: float = SQL_SPEED) -> DataFrame:
    return inside(gps, area).where(F.col("speed") > speed)


def count_by_car(gps: DataFrame, area=SQL_AREA, top: int = 100, by: tuple = ()) -> DataFrame:
    """Points of each car in the area, most first, ties by car."""
    out = inside(gps, area).groupBy(*by, "car_id").agg(F.count(F.lit(1)).alias("total"))
    return out.orderBy(F.desc("total"), "car_id").limit(top) if top else out


def speed_by_car(gps: DataFrame, area=SQL_AREA, speed: float = SQL_SPEED, by: tuple = ()) -> DataFrame:
    """Average speed of each car among its fast points in the area.

    The average is sum over count of whole numbers, the same on any engine.
    """
    return fast_inside(gps, area, speed).groupBy(*by, "car_id").agg(_mean("speed").alias("avg_speed"))


def _mean(name: str) -> Column:
    return F.sum(name).cast("double") / F.count(name)


def speed_summary(gps: DataFrame, area=SQL_AREA, speed: float = SQL_SPEED) -> DataFrame:
    """Average, greatest and least of the cars' averages."""
    return speed_by_car(gps, area, speed).agg(F.avg("avg_speed").alias("avg_of_avg"), F.max("avg_speed").alias("max_avg"), F.min("avg_speed").alias("min_avg"))


# The pack of queries on one rectangle


def cars_inside(gps: DataFrame, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    return inside(gps, area).select(*by, "car_id").distinct()


def averages_inside(gps: DataFrame, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    return inside(gps, area).groupBy(*by, "car_id").agg(_mean("speed").alias("avg_speed"))


def average_of(gps: DataFrame, car: int, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    return averages_inside(gps.where(F.col("car_id") == car), area, by)


def average_over_cars(gps: DataFrame, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    """Mean of the cars' means."""
    return averages_inside(gps, area, by).groupBy(*by).agg(F.avg("avg_speed").alias("avg_speed"))


def fastest(gps: DataFrame, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    """The car with the greatest average, the least id of equals; no row without points."""
    best = F.max(F.struct("avg_speed", (-F.col("car_id")).alias("c"))).alias("m")
    return averages_inside(gps, area, by).groupBy(*by).agg(best).where("m is not null").select(*by, (-F.col("m.c")).alias("car_id"), "m.avg_speed")


def slowest(gps: DataFrame, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    least = F.min(F.struct("avg_speed", "car_id")).alias("m")
    return averages_inside(gps, area, by).groupBy(*by).agg(least).where("m is not null").select(*by, "m.car_id", "m.avg_speed")


def at_least(gps: DataFrame, limit: float = MBR_SPEED, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    return averages_inside(gps, area, by).where(F.col("avg_speed") >= limit)


def speed_extremes(gps: DataFrame, area=MBR_AREA, by: tuple = ()) -> DataFrame:
    """Greatest and least speed of single points."""
    return inside(gps, area).groupBy(*by).agg(F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"))
