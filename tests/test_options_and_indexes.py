"""Options, counters, partitioners from their text, store bounds and spills, joins over many spaces."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import options
from trackloom.operators import joins
from trackloom.operators.counters import Counters
from trackloom.operators.partition import KINDS, build_index, load, pack, tree_shape
from trackloom.operators.partition.base import overlapping, sampled
from trackloom.sources import readers, sinks
from trackloom.streaming import jobs, windows
from trackloom.streaming.windows import Span

BOXES = "id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"


def boxes(spark, n=400, seed=3, wide=6):
    rng = random.Random(seed)
    rows = [(i, x := rng.uniform(0, 100), y := rng.uniform(0, 100), z := rng.uniform(0, 100), x + rng.uniform(0.1, wide), y + rng.uniform(0.1, wide), z + rng.uniform(0.1, wide)) for i in range(n)]
    return spark.createDataFrame(rows, BOXES), rows


def meet(a, b):
    return all(a[i] < b[i + 3] and b[i] < a[i + 3] for i in range(3))


def test_sizes_and_options():
    assert [options.size(t) for t in ("7", "10.k", "3.M", "2.g", "1.tb")] == [7, 10240, 3 << 20, 2 << 30, 1 << 40]
    for bad in ("", "k", "1.5", "-3", "2.x"):
        with pytest.raises(ValueError):
            options.size(bad)
    paths, found = options.parse(["/in", "shape:rect", "-overwrite", "-no-local", "hdfs://host/x", "k:1", "k:2", "-"])
    assert paths == ["/in", "hdfs://host/x", "-"] and found == {"shape": "rect", "overwrite": True, "local": False, "k": "2"}


def test_counters_count_what_passes(spark, tmp_path):
    counters = Counters()
    rows = counters.watch(spark.range(100), "rows", even=F.col("id") % 2 == 0)
    some = counters.watch(rows.where("id < 30"), "some")
    some.write.parquet(f"{tmp_path}/out")
    got = counters.values()
    assert got["some"] == 30 and got["rows"] >= 30 and got["rows.even"] * 2 == got["rows"]


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_partitioner_read_from_its_text(spark, kind):
    rng = random.Random(1)
    points = spark.createDataFrame([(rng.uniform(0, 10), rng.gauss(5, 1)) for _ in range(300)], "x double, y double")
    built = build_index(kind, points, (0.0, 0.0, 10.0, 10.0), 16)
    again = load(built.spec())
    assert again == built and again.cells() == built.cells()
    both = points.select(built.assign("x", "y").alias("a"), again.assign("x", "y").alias("b"))
    assert both.where("a <> b").count() == 0 and both.select("a").distinct().count() > 3
    with pytest.raises(ValueError):
        load('{"kind": "none", "area": []}')


def test_many_spaces_meet_in_bins(spark, monkeypatch):
    shapes, rows = boxes(spark)
    cells, spaces = boxes(spark, 300, 4, 30)
    cells = cells.withColumnRenamed("id", "space_id")
    want = sorted((a[0], b[0]) for a in rows for b in spaces if meet(a[1:], b[1:]))
    volume = lambda a, b: (min(a[4], b[4]) - max(a[1], b[1])) * (min(a[5], b[5]) - max(a[2], b[2])) * (min(a[6], b[6]) - max(a[3], b[3]))
    most = {a[0]: max(((volume(a, b), -b[0]) for b in spaces if meet(a[1:], b[1:])), default=(0, None))[1] for a in rows}
    pairs = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a[1:], b[1:]))
    tiles = spark.range(1000).select((F.col("id") + 1).alias("space_id"), *(((F.floor(F.col("id") / 10**i) % 10 + j) * 11.0).alias(f"{c}{j + 1}") for j in (0, 1) for i, c in enumerate("xyz")))
    for few in (10, 2000):
        monkeypatch.setattr(joins, "FEW_CELLS", few)
        assert sorted((r.id, r.space_id) for r in joins.replicate(shapes, cells).collect()) == want
        assert {r.id: r.space_id for r in joins.most_overlap(shapes, cells, "id").collect()} == {k: None if v is None else -v for k, v in most.items()}
        assert sorted(tuple(r) for r in joins.partition_pairs(shapes.withColumnRenamed("id", "space_id"), cells).collect()) == want
        assert sorted(tuple(r) for r in joins.spatial_join(shapes, shapes, "id", "id", tiles).where("a_id < b_id").collect()) == pairs
        flat = overlapping(shapes, cells.withColumnRenamed("space_id", "cell_id"))
        assert flat.count() == sum(a[1] < b[4] and b[1] < a[4] and a[2] < b[5] and b[2] < a[5] for a in rows for b in spaces)
    monkeypatch.setattr(joins, "FEW_CELLS", 10)
    assert "NestedLoop" not in joins.replicate(shapes, cells)._jdf.queryExecution().toString()


def test_packed_tree_equals_plain_slices(spark):
    shapes, rows = boxes(spark, 300)
    degree = 4

    def plain(part, level, levels, name):
        if level == levels:
            return {r[0]: name for r in part}
        part = sorted(part, key=lambda r: ((r[1 + level % 3] + r[4 + level % 3]) / 2, r[0]))
        ends = [i * len(part) // degree for i in range(degree + 1)]
        out = {}
        for i in range(degree):
            out |= plain(part[ends[i] : ends[i + 1]], level + 1, levels, name * degree + i)
        return out

    levels = tree_shape(300, degree)["height"] - 1
    assert levels >= 2
    assert {r.id: r.leaf for r in pack(shapes, degree, "id").collect()} == plain(rows, 0, levels, 0)


def test_sample_of_many_points_is_that_of_all(spark):
    points = spark.range(5000).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") * 7 % 1009).cast("double").alias("y"))
    small = sampled(points, "x", "y", 100)
    kept = points.orderBy(F.xxhash64("x", "y"), "x", "y").limit(100).collect()
    assert small.tolist() == [[r.x, r.y] for r in kept]
    same = points.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert len(sampled(same, "x", "y", 100)) == 100


@pytest.mark.parametrize("policy", [None, "grid", "str", "str+", "kd"])
def test_bounds_follow_the_policy(spark, tmp_path, policy):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 12.0, 2.0, 1.0), (2, 3.0, 4.0, 0.0, 5.0, 6.0, 1.0)], BOXES).withColumn("cell_id", F.lit(7))
    cells = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 10.0, 10.0, 1.0)], "space_id int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    m = sinks.write_store(rows, f"{tmp_path}/s", cells=cells, policy=policy, file_rows=1).first()
    want = {None: (1, 1, 10, 6), "str+": (1, 1, 10, 6), "str": (1, 1, 12, 6), "grid": (0, 0, 10, 10), "kd": (0, 0, 12, 10)}
    assert (m.x1, m.y1, m.x2, m.y2) == want[policy] and m.record_count == 2
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/s/data") for f in fs if f.endswith(".parquet")]
    assert m["size"] == sum(map(os.path.getsize, files)) and len(files) <= 2
    assert readers.path_size(readers.master(spark, f"{tmp_path}/s")).first()["size"] == m["size"]


def test_full_regions_are_spilled_once(spark, tmp_path):
    store, out = f"{tmp_path}/store", f"{tmp_path}/out"
    rows = spark.range(60).select(F.col("id").alias("v"), F.when(F.col("id") < 50, 1).otherwise(2).alias("region"))
    for n in range(2):
        rows.write.partitionBy("region").parquet(f"{store}/batch={n}")
    assert sinks.spill(spark, store, out, 50, 0) == [1]
    assert sinks.spill(spark, store, out, 50, 1) == []
    assert {(r.region, r["count"]) for r in spark.read.parquet(store).groupBy("region").count().collect()} == {(2, 20)}
    assert spark.read.parquet(out).where("region = 1").count() == 100


def test_distinct_cars_are_exact_on_a_stream(spark, tmp_path):
    rows = spark.range(3000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") % 300).alias("ts"), (F.col("id") * 7919 % 997).cast("int").alias("car_id"))
    readers.replay_files(rows, f"{tmp_path}/in", 3, "ts")
    stream = readers.replay_stream(spark, f"{tmp_path}/in", rows.schema)
    q = windows.distinct_cars(stream, Span(100, 50)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.w_start, r.cars) for r in windows.distinct_cars(rows, Span(100, 50)).collect()}
    got = {(r.w_start, r.cars) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and got <= want


def test_console_and_store_table(spark, tmp_path):
    q = jobs.to_memory(spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().select("value"), "rate_rows")
    q.awaitTermination()
    assert spark.table("rate_rows").count() > 0
    sinks.create_store_table(spark, "keyed_cells", f"{tmp_path}/keyed")
    assert spark.table("keyed_cells").columns == ["row_key", "lo", "la", "s", "region"]
    spark.sql("DROP TABLE keyed_cells")


def test_lines_know_their_partition(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(f"{tmp_path}/t")
    name = next(f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".txt"))
    master = spark.createDataFrame([(4, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, name)], "space_id int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, filename string")
    assert {(r.value, r.space_id) for r in readers.lines_with_partition(spark, f"{tmp_path}/t", master).collect()} == {("a", 4), ("b", 4)}


def test_index_of_blocks_from_the_command_line(spark, tmp_path):
    from trackloom.__main__ import main

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    assert main(["index", "grid", folder, "1.k", "--out", f"{tmp_path}/index"]) == 0
    assert main(["index", "grid", folder, "4", "--out", f"{tmp_path}/few"]) == 0
    assert spark.read.text(f"{tmp_path}/index").count() > spark.read.text(f"{tmp_path}/few").count() >= 4


def test_binary_spaces_come_back(spark, tmp_path):
    spaces = [(i, 0.5 * i, 1.0, -2.0, 0.5 * i + 1, 3.25, 1e9) for i in range(50)]
    (tmp_path / "spaces.bin").write_bytes(sinks.index_bytes(spaces))
    (tmp_path / "none.bin").write_bytes(sinks.index_bytes([]))
    assert sorted(tuple(r) for r in readers.spaces_binary(spark, f"{tmp_path}/spaces.bin").collect()) == spaces
    assert readers.spaces_binary(spark, f"{tmp_path}/none.bin").count() == 0


def test_socket_stream_reads_lines(spark):
    import socket
    import threading

    server = socket.socket()
    server.bind(("127.0.0.1", 0))
    server.listen(1)

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"one\ntwo\nthree\n")
        done.wait(60)
        peer.close()

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    found = []
    stream = readers.socket_stream(spark, "127.0.0.1", server.getsockname()[1])
    q = stream.writeStream.foreachBatch(lambda b, n: found.extend(r[0] for r in b.collect())).start()
    try:
        for _ in range(120):
            if len(found) >= 3:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
        done.set()
        server.close()
    assert sorted(found) == ["one", "three", "two"]
