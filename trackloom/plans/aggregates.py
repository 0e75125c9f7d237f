"""Filters and aggregations over GPS points, areas and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import trajectory as tr
from trackloom.plans.registry import query

_AREA = "lng > 116.2E0 AND lng < 116.5E0 AND lat > 39.85E0 AND lat < 40.1E0"
_MBR = "lng > 116.232656E0 AND lng < 116.544261E0 AND lat > 39.869983E0 AND lat < 40.021769E0"
_MEAN = "CAST(SUM(speed) AS DOUBLE) / COUNT(speed)"
_AVGS = f"SELECT car_id, {_MEAN} AS avg_speed FROM gps WHERE {_MBR} GROUP BY car_id"


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("flt1_objects", "SELECT event_id, car_id, lng, lat, speed FROM gps WHERE car_id IN (7, 42, 99)")
def objects(v):
    return tr.of_objects(v.gps, (7, 42, 99)).select("event_id", "car_id", "lng", "lat", "speed")


@query("flt2_point_in_area", f"SELECT event_id, car_id, lng, lat FROM gps WHERE {_MBR}")
def in_mbr(v):
    return tr.inside(v.gps).select("event_id", "car_id", "lng", "lat")


@query("flt3_area_and_speed", f"SELECT event_id, car_id, speed FROM gps WHERE {_AREA} AND speed > 80")
def area_speed(v):
    return tr.fast_inside(v.gps).select("event_id", "car_id", "speed")


@query("agg_ag1_count_by_car", f"SELECT car_id, COUNT(*) AS total FROM gps WHERE {_AREA} GROUP BY car_id HAVING COUNT(*) > 0 ORDER BY total DESC, car_id LIMIT 100")
def ag1(v):
    return tr.count_by_car(v.gps)


@query("agg_ag2_avg_speed_area", f"SELECT car_id, {_MEAN} AS avg_speed FROM gps WHERE {_AREA} AND speed > 80 GROUP BY car_id")
def ag2(v):
    return tr.speed_by_car(v.gps)


@query("agg_ag3_two_level", f"SELECT round(AVG(a), 6) AS avg_of_avg, MAX(a) AS max_avg, MIN(a) AS min_avg FROM (SELECT {_MEAN} AS a FROM gps WHERE {_AREA} AND speed > 80 GROUP BY car_id) t")
def ag3(v):
    return _round(tr.speed_summary(v.gps), "avg_of_avg")


@query("agg_ag4_count", f"SELECT COUNT(car_id) AS n FROM gps WHERE {_AREA} AND speed > 80")
def ag4(v):
    return tr.fast_inside(v.gps).agg(F.count("car_id").alias("n"))


@query("agg_ag5_count_distinct", "SELECT COUNT(DISTINCT car_id) AS n FROM gps")
def ag5(v):
    return v.gps.agg(F.count_distinct("car_id").alias("n"))


@query("agg_ag6_distinct", f"SELECT DISTINCT car_id FROM gps WHERE {_AREA}")
def ag6(v):
    return tr.cars_inside(v.gps, tr.SQL_AREA)


@query("agg_ag7_global_speed", f"SELECT {_MEAN} AS avg_speed, MAX(speed) AS max_speed, MIN(speed) AS min_speed FROM gps")
def ag7(v):
    return v.gps.agg((F.sum("speed").cast("double") / F.count("speed")).alias("avg_speed"), F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"))


@query("agg_ag7_count_below_id", "SELECT car_id, COUNT(car_id) AS n FROM gps WHERE car_id < 100 GROUP BY car_id")
def ag7_ids(v):
    return v.gps.where("car_id < 100").groupBy("car_id").agg(F.count("car_id").alias("n"))


@query("agg_ag7_fast_points", "SELECT event_id, car_id, speed FROM gps WHERE speed > 80")
def ag7_fast(v):
    return v.gps.where("speed > 80").select("event_id", "car_id", "speed")


@query("agg_ag7_slow_points", "SELECT event_id, car_id, speed FROM gps WHERE speed < 50")
def ag7_slow(v):
    return v.gps.where("speed < 50").select("event_id", "car_id", "speed")


@query("agg_ag11_word_count", "SELECT word, COUNT(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL) t GROUP BY word")
def word_count(v):
    from trackloom.sources.readers import words

    return words(v.documents, "text")


@query("agg_ag19_limits", "SELECT MAX(x1) AS max_x, MAX(y1) AS max_y, MAX(z1) AS max_z, MIN(x1) AS min_x, MIN(y1) AS min_y, MIN(z1) AS min_z, COUNT(*) AS n FROM boxes")
def ag19(v):
    from trackloom.sources.readers import limits

    return limits(v.boxes.select(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z")))


@query("agg_ag21_cars_in_area", f"SELECT DISTINCT car_id FROM gps WHERE {_MBR}")
def ag21_cars(v):
    return tr.cars_inside(v.gps)


@query("agg_ag21_car_average", f"SELECT car_id, {_MEAN} AS avg_speed FROM gps WHERE {_MBR} AND car_id = 42 GROUP BY car_id")
def ag21_one(v):
    return tr.average_of(v.gps, 42)


@query("agg_ag21_mean_of_means", f"SELECT round(AVG(avg_speed), 6) AS avg_speed FROM ({_AVGS}) t")
def ag21_mean(v):
    return _round(tr.average_over_cars(v.gps), "avg_speed")


@query("agg_ag21_fastest", f"SELECT car_id, avg_speed FROM ({_AVGS}) t ORDER BY avg_speed DESC, car_id LIMIT 1")
def ag21_fastest(v):
    return tr.fastest(v.gps)


@query("agg_ag21_slowest", f"SELECT car_id, avg_speed FROM ({_AVGS}) t ORDER BY avg_speed, car_id LIMIT 1")
def ag21_slowest(v):
    return tr.slowest(v.gps)


@query("agg_ag21_high_speed", f"SELECT car_id, avg_speed FROM ({_AVGS}) t WHERE avg_speed >= 80")
def ag21_high(v):
    return tr.at_least(v.gps)


@query("agg_ag22_speed_extremes", f"SELECT MAX(speed) AS max_speed, MIN(speed) AS min_speed FROM gps WHERE {_MBR}")
def ag22(v):
    return tr.speed_extremes(v.gps)


@query("sort_so1_top", "SELECT car_id, COUNT(*) AS total FROM gps GROUP BY car_id ORDER BY total DESC, car_id LIMIT 10")
def so1(v):
    return v.gps.groupBy("car_id").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "car_id").limit(10)


@query("sort_so6_argmax", "SELECT car_id, MAX(speed) AS speed, MIN(event_id) FILTER (WHERE speed = m) AS event_id FROM (SELECT *, MAX(speed) OVER (PARTITION BY car_id) AS m FROM gps) t GROUP BY car_id")
def so6(v):
    best = F.max(F.struct("speed", (-F.col("event_id")).alias("e")))
    return v.gps.groupBy("car_id").agg(best.alias("m")).select("car_id", "m.speed", (-F.col("m.e")).alias("event_id"))


@query("set_set1_distinct_days", "SELECT DISTINCT car_id, sec // 86400 AS day FROM gps")
def set1(v):
    return v.gps.select("car_id", F.floor(F.col("sec") / 86400).alias("day")).distinct()


@query("set_set2_difference", f"SELECT DISTINCT car_id FROM gps WHERE car_id NOT IN (SELECT car_id FROM gps WHERE {_MBR})")
def set2(v):
    return v.gps.select("car_id").distinct().join(tr.cars_inside(v.gps), "car_id", "left_anti")


@query("set_set3_union", "SELECT event_id, speed FROM gps WHERE speed < 5 UNION ALL SELECT event_id, speed FROM gps WHERE speed > 300")
def set3(v):
    g = v.gps.select("event_id", "speed")
    return g.where("speed < 5").unionByName(g.where("speed > 300"))


@query("wf_wf1_previous_and_rank", 'SELECT event_id, lag(speed) OVER w AS prev_speed, CAST(SUM(speed) OVER w AS BIGINT) AS running, row_number() OVER w AS rn FROM gps WINDOW w AS (PARTITION BY car_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)')
def wf1(v):
    from pyspark.sql import Window

    w = Window.partitionBy("car_id").orderBy("sec", "event_id")
    return v.gps.select("event_id", F.lag("speed").over(w).alias("prev_speed"), F.sum("speed").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.row_number().over(w).cast("long").alias("rn"))
