"""Sliding and tumbling windows, in batch form and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import trajectory as tr
from trackloom.plans.partitions import _store
from trackloom.plans.registry import query
from trackloom.plans.views import epoch
from trackloom.streaming import jobs, windows
from trackloom.streaming.windows import WORKLOADS, Span

_AREA = "lng > 116.2E0 AND lng < 116.5E0 AND lat > 39.85E0 AND lat < 40.1E0"


def _sql(span: Span, select: str, where: str = "TRUE", group: str = "") -> str:
    """A query over rows `g` joined with their windows w_start, w_end."""
    k = -(-span.length // span.slide)
    steps = ", ".join(f"({i})" for i in range(k))
    rows = f"SELECT g.*, (sec // {span.slide}) * {span.slide} - i * {span.slide} AS w_start, (sec // {span.slide}) * {span.slide} - i * {span.slide} + {span.length} AS w_end FROM gps g, (VALUES {steps}) k(i)"
    return f"SELECT {select} FROM ({rows}) w WHERE sec < w_end AND {where} {group}"


def _ends(df):
    return df.withColumns({"w_start": epoch("w_start"), "w_end": epoch("w_end")})


def _workload(name: str, label: str) -> None:
    span = WORKLOADS[name]

    @query(f"stream_{label}", _sql(span, "w_start, w_end, car_id, COUNT(*) AS total", _AREA, "GROUP BY 1, 2, 3"))
    def run(v):
        return _ends(windows.count_by_car(v.stream_ts, span))


_workload("report", "ws1_window_100_20")
_workload("sql", "ws2_window_10_1")
_workload("short", "ws3_window_8_2")
_workload("tumbling", "ws4_window_3_3")
_workload("uneven", "ws5_window_10_3")
_workload("long", "ws6_window_200_20")


@query("stream_ws8_window_avg_speed", _sql(WORKLOADS["report"], "w_start, w_end, car_id, CAST(SUM(speed) AS DOUBLE) / COUNT(speed) AS avg_speed", f"{_AREA} AND speed > 80", "GROUP BY 1, 2, 3"))
def ws8(v):
    return _ends(windows.speed_by_car(v.stream_ts, WORKLOADS["report"]))


@query("stream_ws8_window_distinct", _sql(WORKLOADS["report"], "w_start, w_end, COUNT(DISTINCT car_id) AS cars", "TRUE", "GROUP BY 1, 2"))
def ws8_distinct(v):
    return _ends(windows.distinct_cars(v.stream_ts, WORKLOADS["report"]))


@query("stream_ws9_objects", _sql(WORKLOADS["report"], "w_start, w_end, event_id, car_id, speed", "car_id IN (7, 42, 99)"))
def ws9(v):
    return _ends(windows.object_trajectories(v.stream_ts, WORKLOADS["report"], (7, 42, 99))).select("w_start", "w_end", "event_id", "car_id", "speed")


@query("stream_ws13_object_window", _sql(WORKLOADS["short"], "w_start, w_end, event_id", "car_id = 42"))
def ws13(v):
    return _ends(windows.object_trajectories(v.stream_ts, WORKLOADS["short"], (42,))).select("w_start", "w_end", "event_id")


_WIDE = (116.2, 39.85, 116.5, 40.1)
_PER_CAR = _sql(Span(86400, 86400), "w_start, w_end, car_id, CAST(SUM(speed) AS DOUBLE) / COUNT(speed) AS avg_speed", _AREA, "GROUP BY 1, 2, 3")


@query("stream_ws11_rectangle_summary", f"SELECT w_start, w_end, COUNT(*) AS cars, round(AVG(avg_speed), 6) AS avg_speed, arg_max(car_id, (avg_speed, -car_id)) AS fastest, arg_min(car_id, (avg_speed, car_id)) AS slowest, COUNT(*) FILTER (WHERE avg_speed >= 40) AS high_speed_cars FROM ({_PER_CAR}) p GROUP BY 1, 2")
def ws11(v):
    out = windows.rectangle_summary(v.stream_ts, Span(86400, 86400), _WIDE)
    return _ends(out).withColumn("avg_speed", F.round("avg_speed", 6))


@query("stream_ws10_history", f"SELECT * FROM ({_sql(Span(86400, 86400), 'w_start, w_end, COUNT(*) AS n', 'TRUE', 'GROUP BY 1, 2')}) t ORDER BY w_start DESC LIMIT 10")
def ws10(v):
    rows = windows.flat(windows.windowed(v.stream_ts, Span(86400, 86400)).groupBy("window").agg(F.count(F.lit(1)).alias("n")))
    return _ends(jobs.last_windows(rows, 10)).select("w_start", "w_end", "n")


@query("stream_ws12_registered", "SELECT q.query_id, g.event_id FROM gps g JOIN (SELECT car_id, CAST(MIN(event_id) AS BIGINT) AS query_id FROM gps GROUP BY 1) q ON g.car_id = q.car_id")
def ws12(v):
    """A query registered for each car that the table holds."""
    asked = v.gps.groupBy("car_id").agg(F.min("event_id").alias("query_id"))
    return windows.registered(v.gps, asked).select("query_id", "event_id")


@query("stream_src1_replay", "SELECT car_id, COUNT(*) AS n FROM gps GROUP BY 1")
def replay(v):
    """The points replayed as a stream of files and counted."""
    from trackloom.sources.readers import replay_files, replay_stream

    rows, path, out = v.stream_ts, _store(v, "replay"), _store(v, "replayed")
    replay_files(rows, path, 4, "sec")
    stream = replay_stream(v.spark, path, rows.schema).groupBy("car_id").agg(F.count(F.lit(1)).alias("n"))
    put = lambda batch, number: batch.write.mode("overwrite").parquet(out)
    q = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", _store(v, "replay-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out)


@query("stream_ws7_store_ingest", "SELECT car_id % 7 AS salt, COUNT(*) AS n FROM gps WHERE lng >= 116E0 AND lng < 116.5E0 AND lat >= 39.75E0 AND lat < 40E0 GROUP BY 1")
def ws7(v):
    """Points streamed into the keyed store and counted there by salt."""
    from trackloom.sources.readers import replay_files, replay_stream

    rows = v.stream_ts.withColumn("time", F.col("sec"))
    path, out = _store(v, "ingest"), _store(v, "ingested")
    replay_files(rows, path, 2, "sec")
    cells = v.spark.createDataFrame([(1, 116.0, 39.75, 116.25, 40.0), (2, 116.25, 39.75, 116.5, 40.0)], "cell_id int, x1 double, y1 double, x2 double, y2 double")
    jobs.ingest(replay_stream(v.spark, path, rows.schema), cells, out, _store(v, "ingest-log")).awaitTermination()
    stored = v.spark.read.parquet(out)
    return stored.groupBy((F.col("region") % (1 << 32)).cast("int").alias("salt")).agg(F.count(F.lit(1)).alias("n"))
