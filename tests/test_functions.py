import math
import random

from pyspark.sql import functions as F

from trackloom.functions import codecs, geom, zorder
from trackloom.functions.grid import MiningGrid
from trackloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_haversine(spark):
    a = [F.lit(x) for x in (121.40925322638617, 31.218578391604954, 121.5730972290039, 31.144390106201172)]
    assert one(spark, geom.haversine(*a)) == 17654
    assert one(spark, geom.haversine(*a, swap_axes=True)) == 18742
    assert abs(one(spark, geom.haversine(*a, whole_metres=False)) - 17654.781872) < 1e-5


def test_morton(spark):
    assert one(spark, zorder.interleave(F.lit(3), F.lit(5))) == 27
    assert one(spark, zorder.interleave(F.lit(zorder.TOP), F.lit(zorder.TOP))) == 2**62 - 1
    rng = random.Random(1)
    rows = [(rng.randrange(2**31), rng.randrange(2**31)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x long, y long")
    x, y = zorder.deinterleave(zorder.interleave("x", "y"))
    assert [tuple(r) for r in df.select(x, y).collect()] == rows


def test_half_open_rectangle(spark):
    r = geom.rect(0.0, 0.0, 1.0, 1.0)
    assert one(spark, geom.rect_has_point(r, 0.0, 0.0)) and not one(spark, geom.rect_has_point(r, 1.0, 1.0))
    assert not one(spark, geom.rects_overlap(r, geom.rect(1.0, 0.0, 2.0, 1.0)))
    b = geom.box(0.0, 0.0, 0.0, 1.0, 1.0, 1.0)
    assert one(spark, geom.box_has_point(b, 1.0, 1.0, 1.0)) and not one(spark, geom.box_meets_point(b, 1.0, 1.0, 1.0))


def test_ulp(spark):
    for x in (1.0, 0.1, 116.4, 3e9, 2.0**40, 0.75):
        assert one(spark, geom.ulp(F.lit(x))) == math.ulp(x)


def test_box_algebra(spark):
    a, b = geom.box(0.0, 0.0, 0.0, 4.0, 4.0, 4.0), geom.box(2.0, 1.0, 3.0, 9.0, 2.0, 9.0)
    assert tuple(one(spark, geom.box_intersection(a, b))) == (2, 1, 3, 4, 2, 4)
    assert tuple(one(spark, geom.box_union(a, b))) == (0, 0, 0, 9, 4, 9)
    assert one(spark, geom.box_intersection(a, geom.box(4.0, 0.0, 0.0, 5.0, 1.0, 1.0))) is None
    assert not one(spark, geom.box_valid(geom.box(float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)))


def test_neighbours(spark):
    grid = MiningGrid()
    assert [len(one(spark, grid.neighbours(F.lit(c)))) for c in (0, 50, 5050, 9999)] == [3, 5, 8, 3]


def test_codecs(spark):
    key = one(spark, codecs.row_key(F.lit(1), F.lit(2), F.lit(3)))
    assert bytes(key) == (1).to_bytes(8, "big") + (2).to_bytes(4, "big") + (3).to_bytes(8, "big")
    assert one(spark, codecs.salted_region(F.lit(5), F.lit(9))) == (5 << 32) + 2
    assert one(spark, codecs.salted_region(F.lit(-1), F.lit(9))) == codecs.OUTSIDE
    assert [codecs.size_bytes(s) for s in ("10", "1.5k", "2m", "1.g", "1t")] == [10, 1536, 2 << 20, 1 << 30, 1 << 40]
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, codecs.map_text(m)) == "[a#1,b#2]"
    assert one(spark, codecs.text_map(F.lit("[a#1,b#2]"))) == {"a": "1", "b": "2"}
    assert one(spark, codecs.text_map(F.lit("[]"))) == {}


def test_gps_lines(spark):
    import pytest

    lines = spark.createDataFrame([("1349020800\t9997,116.40,39.91,63.7",), ("no tab",), ("x\t1,2,3,4",)], "value string")
    rows = readers.gps_lines(lines, strict=False).collect()
    assert [(r.time, r.car_id, r.speed) for r in rows] == [(1349020800, 9997, 63)]
    with pytest.raises(Exception, match="no GPS line"):
        readers.gps_lines(lines).collect()


def test_binary_index_and_sequence_file(spark, tmp_path):
    from trackloom.sources import sinks

    cells = [(500, 115.75, 39.5, 116.2, 39.9), (501, 116.2, 39.5, 117.2, 39.9)]
    (tmp_path / "index.bin").write_bytes(sinks.index_bytes(cells))
    assert [tuple(r) for r in readers.index_binary(spark, f"{tmp_path}/index.bin").collect()] == cells
    spark.sparkContext.parallelize([(1349020800, "9997,116.4,39.9,63")]).saveAsSequenceFile(f"{tmp_path}/seq")
    assert [tuple(r) for r in readers.sequence_file(spark, f"{tmp_path}/seq").collect()] == [(1349020800, "9997,116.4,39.9,63")]
