"""Scans and round trips through the writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.plans.partitions import _store
from trackloom.plans.registry import query
from trackloom.sources import readers, sinks


@query("src_src2_replay_groups", "SELECT sec // 86400 AS time, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS recs FROM gps GROUP BY 1")
def src2(v):
    rows = v.gps.select(F.floor(F.col("sec") / 86400).alias("time"), F.col("event_id").alias("rec"))
    return readers.replay_groups(rows).select("time", F.array_join(F.col("recs").cast("array<string>"), ",").alias("recs"))


@query("src_src3_text_lines", "SELECT CAST(event_id AS VARCHAR) AS value FROM gps")
def src3(v):
    path = _store(v, "lines")
    v.gps.select(F.col("event_id").cast("string").alias("value")).write.text(path)
    return v.spark.read.text(path)


@query("src_src5_store_count", "SELECT COUNT(*) AS n FROM gps WHERE event_id % 10 <> 0")
def src5(v):
    path = _store(v, "keyed")
    cell = F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("event_id") % 5)
    rows = v.gps.withColumn("cell_id", cell).withColumn("time", F.col("sec"))
    sinks.keyed(rows.where("cell_id >= 0")).write.partitionBy("region").parquet(f"{path}/data")
    return readers.store(v.spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("src_src6_row_keys", "SELECT upper(lpad(to_hex((CAST(event_id % 5 AS BIGINT) << 32) + car_id % 7), 16, '0') || lpad(to_hex(CAST(car_id AS BIGINT)), 8, '0') || lpad(to_hex(sec), 16, '0')) AS row_key FROM gps")
def src6(v):
    rows = v.gps.withColumn("cell_id", F.col("event_id") % 5).withColumn("time", F.col("sec"))
    return sinks.keyed(rows).select(F.hex("row_key").alias("row_key"))


@query("src_src10_master_lines", "SELECT CAST(id AS INT) AS space_id, x1, z2, id * 2 AS record_count FROM boxes")
def src10(v):
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("id", "x1", "y1", "z1", "x2", "y2", "z2")), (F.col("id") * 2).cast("string"), F.lit("0"), F.lit("part"))
    return readers.master_lines(v.boxes.select(line.alias("value"))).select("space_id", "x1", "z2", "record_count")


@query("src_src15_lines_with_bounds", "SELECT COUNT(*) AS n, COUNT(DISTINCT id % 4) AS files FROM boxes")
def src15(v):
    """Lines read back from a store's files, each beside its file's partition."""
    path = _store(v, "text")
    rows = v.boxes.select(F.concat_ws(",", "id", "x1").alias("value"), (F.col("id") % 4).alias("cell_id"))
    rows.repartition(4, "cell_id").write.partitionBy("cell_id").text(path)
    back = v.spark.read.text(path).withColumn("cell_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("files"))


@query("src_src16_shape_text", "SELECT CAST(x1 AS DOUBLE) AS x1, y1, x2, y2 FROM boxes")
def src16(v):
    path = _store(v, "shapes")
    v.boxes.select(F.concat_ws(",", "x1", "y1", "x2", "y2").alias("value")).write.text(path)
    return readers.shapes(v.spark, path, "rect")


@query("src_src19_point_text", "SELECT x1 AS x, y1 AS y FROM boxes")
def src19(v):
    path = _store(v, "points")
    sinks.point_lines(v.boxes, "x1", "y1").write.text(path)
    return readers.points(v.spark, path)


@query("src_src20_day_range", 'SELECT CAST("user" AS VARCHAR) AS "user", sec, CAST(bid AS VARCHAR) AS bid FROM calls WHERE sec // 86400 - 19723 + 20240101 BETWEEN 20240105 AND 20240110')
def src20(v):
    """Gzipped logs under day folders; only the range's folders are read."""
    path = _store(v, "logs")
    day = F.date_format(F.timestamp_seconds("sec"), "yyyyMMdd")
    line = F.concat_ws(",", F.col("user").cast("string"), F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm:ss"), F.col("bid").cast("string"))
    v.calls.select(line.alias("value"), day.alias("day")).repartition("day").write.option("compression", "gzip").partitionBy("day").text(path)
    return readers.call_logs(v.spark, path, "20240105", "20240110").select("user", "sec", "bid")


@query("src_src21_recorded_days", "SELECT COUNT(DISTINCT sec // 86400) AS n FROM calls WHERE sec // 86400 - 19723 + 20240101 BETWEEN 20240105 AND 20240110")
def src21(v):
    path = _store(v, "days")
    v.calls.select(F.date_format(F.timestamp_seconds("sec"), "yyyyMMdd").alias("day"), F.col("bid").cast("string").alias("value")).repartition("day").write.option("compression", "gzip").partitionBy("day").text(path)
    n = readers.recorded_days(v.spark, path, "20240105", "20240110")
    return v.spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("src_src22_tower_file", "SELECT CAST(bid AS VARCHAR) AS bid, region FROM towers")
def src22(v):
    path = _store(v, "towers")
    v.towers.select("bid", "lon", "lat", "region").write.csv(path, sep="\t")
    return readers.towers(v.spark, path).select("bid", "region")


@query("snk_snk5_user_outputs", 'SELECT "user", COUNT(DISTINCT region) AS districts FROM live_at GROUP BY 1')
def snk5(v):
    path = _store(v, "users")
    report = v.live_at.groupBy("user").agg(F.array_sort(F.collect_set("region")).alias("districts"), F.array_sort(F.collect_set(F.struct("lon", "lat"))).alias("locations"), F.array_sort(F.collect_set("bid")).alias("bids"))
    sinks.user_outputs(report, path)
    return v.spark.read.parquet(f"{path}/districts").select("user", F.size("districts").cast("long").alias("districts"))


@query("snk_snk15_count_lines", "SELECT CAST(car_id AS VARCHAR) || chr(9) || CAST(COUNT(*) AS VARCHAR) AS value FROM gps GROUP BY car_id")
def snk15(v):
    return sinks.tsv(v.gps.groupBy("car_id").agg(F.count(F.lit(1)).alias("n")))


@query("snk_snk6_store_rows", "SELECT id, x1, z2 FROM boxes WHERE x1 < 500")
def snk6(v):
    """Rows written by cell come back whole."""
    path = _store(v, "cells")
    sinks.write_store(v.boxes.withColumn("cell_id", (F.col("id") % 7).cast("long")), path)
    return readers.store(v.spark, path).where("x1 < 500").select("id", "x1", "z2")
