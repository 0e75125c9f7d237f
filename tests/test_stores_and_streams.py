"""Stores read only what a query can meet; streams give what batches give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import globalindex, joins
from trackloom.operators.partition import BoxGrid
from trackloom.sources import readers, sinks
from trackloom.streaming import jobs, windows
from trackloom.streaming.windows import Span


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(5)
    rows = [(i, x := float(rng.randrange(100)), y := float(rng.randrange(100)), z := float(rng.randrange(10)), x + rng.randrange(1, 9), y + rng.randrange(1, 9), z + 1.0) for i in range(500)]
    return spark.createDataFrame(rows, "id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")


GRID = BoxGrid.build((0.0, 0.0, 0.0, 110.0, 110.0, 12.0), 20)


def test_range_query_reads_fewer_files(spark, boxes, tmp_path):
    placed = boxes.withColumn("cell_id", GRID.assign("x1", "y1", "z1"))
    master = sinks.write_store(placed, f"{tmp_path}/store")
    assert master.agg(F.sum("record_count")).first()[0] == 500
    stored = spark.read.parquet(f"{tmp_path}/store/data")
    area = (0.0, 0.0, 0.0, 20.0, 20.0, 3.0)
    hit = "x2 > 0 and x1 < 20 and y2 > 0 and y1 < 20 and z2 > 0 and z1 < 3"
    some = globalindex.prune(stored, master, area)
    assert {r.id for r in some.where(hit).collect()} == {r.id for r in boxes.where(hit).collect()}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell_id" in plan.replace("isnotnull(", "").replace("#", " ") or "cell_id" in plan.split("PartitionFilters")[1][:80]
    assert globalindex.range_query(master, *area).count() < master.count()


def test_repeated_replication_comes_out_once(spark, boxes):
    spaces = GRID.frame(spark)
    stored = joins.replicate(boxes, spaces)
    part = spaces.select("space_id", F.struct("x1", "y1", "z1", "x2", "y2", "z2").alias("part"))
    again = joins.replicate(stored.join(part, "space_id").drop("space_id"), spaces, "part")
    assert sorted((r.id, r.space_id) for r in again.collect()) == sorted((r.id, r.space_id) for r in stored.collect())


def test_many_cells_use_bins(spark):
    rng = random.Random(6)
    cells = [(i, x := (i % 60) * 1.0, y := (i // 60) * 1.0, x + 1, y + 1) for i in range(3000)]
    points = [(i, rng.uniform(-1, 61), rng.uniform(-1, 51)) for i in range(500)]
    got = joins.locate(spark.createDataFrame(points, "id long, lng double, lat double"), spark.createDataFrame(cells, "cell_id long, x1 double, y1 double, x2 double, y2 double")).collect()
    for r in got:
        inside = 0 <= r.lng < 60 and 0 <= r.lat < 50
        assert r.cell_id == (int(r.lat) * 60 + int(r.lng) if inside else -1)


def gps(spark, n=300):
    rng, start = random.Random(7), datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=i * 3), rng.randrange(5), 116.2 + rng.random() * 0.4, 39.8 + rng.random() * 0.4, rng.randrange(120)) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp, car_id int, lng double, lat double, speed int")


def test_stream_equals_batch(spark, tmp_path):
    rows, span = gps(spark), Span(100, 20)
    readers.replay_files(rows, f"{tmp_path}/in", 6, "ts")
    stream = readers.replay_stream(spark, f"{tmp_path}/in", rows.schema)
    q = windows.speed_by_car(stream, span).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.w_start, r.w_end, r.car_id, r.avg_speed)
    got = {key(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {key(r) for r in windows.speed_by_car(rows, span).collect()}
    last = max(r.ts for r in rows.collect()) - datetime.timedelta(seconds=10)
    assert got <= want
    assert {w for w in want if w[1] <= last} <= got


def test_ingest_again_replaces_its_batches(spark, tmp_path):
    rows = gps(spark).withColumn("time", F.unix_timestamp("ts"))
    readers.replay_files(rows, f"{tmp_path}/in", 2, "ts")
    cells = spark.createDataFrame([(1, 116.2, 39.8, 116.4, 40.2)], "cell_id int, x1 double, y1 double, x2 double, y2 double")
    for log in ("one", "two"):
        stream = readers.replay_stream(spark, f"{tmp_path}/in", rows.schema)
        jobs.ingest(stream, cells, f"{tmp_path}/store", f"{tmp_path}/{log}", outside=True).awaitTermination()
    inside, outside = spark.read.parquet(f"{tmp_path}/store").count(), spark.read.parquet(f"{tmp_path}/store-outside").count()
    assert inside + outside == 300 and inside == rows.where("lng >= 116.2 and lng < 116.4 and lat >= 39.8 and lat < 40.2").count()


def test_sql_on_each_batch(spark, tmp_path):
    rows, found = gps(spark), []
    readers.replay_files(rows, f"{tmp_path}/in", 3, "ts")
    stream = readers.replay_stream(spark, f"{tmp_path}/in", rows.schema)
    jobs.each_batch_sql(stream, "select count(distinct car_id) as n from taxi_messages", lambda df, i: found.append(df.first().n), f"{tmp_path}/log").awaitTermination()
    assert len(found) == 3 and all(1 <= n <= 5 for n in found)


def test_command_line(capsys):
    from trackloom.__main__ import main

    assert main(["list"]) == 0
    assert "agg_ag2_avg_speed_area" in capsys.readouterr().out
