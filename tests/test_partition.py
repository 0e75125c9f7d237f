"""Hand-worked partitions, and properties that every partitioner keeps."""

import json
import random

import numpy as np
import pytest

from trackloom.operators.partition import BoxGrid, Grid, KdTree, QuadTree, QuadTreeIndex, ZCurve, assign_points, build_index, partition_count, tree_shape
from trackloom.operators.partition.grid import dimensions

P12 = np.array([(26, 60), (45, 60), (50, 75), (50, 100), (50, 120), (70, 100), (85, 140), (30, 260), (25, 400), (45, 350), (50, 275), (60, 260)], float)
P14 = np.array(
    [(116.394783, 39.963839), (116.353389, 39.900988), (116.406281, 39.924896), (116.402257, 39.904973), (116.329242, 39.931535), (116.391333, 39.846499), (116.41088, 39.94614), (116.311995, 39.846942), (116.395932, 40.038123), (116.517815, 39.924896), (116.390183, 39.909843), (116.460323, 39.81148), (116.263702, 39.957645), (116.506316, 39.843397)]
)
A12, BJ = (0.0, 0.0, 90.0, 400.0), (115.75, 39.5, 117.2, 40.5)


def test_grid_dimensions():
    assert dimensions([1.45, 1.0], 500) == [27, 19]
    assert dimensions([1.45, 1.0], 4) == [2, 2]


def test_kd_splits():
    assert KdTree.from_array(P12, A12, 4).splits == {1: 50, 2: 260, 3: 140}
    assert KdTree.from_array(P14, BJ, 4).splits == {1: 116.395932, 2: 39.909843, 3: 39.924896}


def test_quad_leaves():
    tree = QuadTree.from_array(P12, A12, 7)
    assert len(tree.leaves) == 31
    assert [k for k in tree.leaves if tree.counts[k]] == [22, 25, 26, 27, 73, 75, 93, 94, 113, 115, 388, 389]
    assert sum(tree.counts.values()) == 12


def test_quad_depth_is_bounded():
    tree = QuadTree.from_array(np.tile([[1.0, 1.0]], (50, 1)), A12, 50)
    assert sum(tree.counts.values()) == 50 and max(tree.leaves) < 4**16


def test_z_splits():
    assert ZCurve.from_array(P12, A12, 4).splits == [2116645634098724191, 2413744637208950141, 3373469189837183610, 4611686018427387903]


def test_tree_shapes():
    assert tree_shape(12, 3) == {"height": 2, "leaves": 3, "nodes": 4}
    assert tree_shape(10000, 10) == {"height": 4, "leaves": 1000, "nodes": 1111}


def test_partition_count():
    assert partition_count(1000, 100) == 11 and partition_count(1, 100) == 1


@pytest.mark.parametrize("kind", ["grid", "kd", "quad"])
def test_cells_cover_without_overlap_and_assign_finds_them(spark, kind):
    rng = random.Random(kind)
    rows = [(i, rng.uniform(0, 90), rng.uniform(0, 400)) for i in range(400)] + [(900, 0.0, 0.0), (901, 90.0, 10.0), (902, -1.0, 5.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    index = build_index(kind, points.where("id < 400"), A12, 13)
    cells = index.cells()
    assert sum((c[3] - c[1]) * (c[4] - c[2]) for c in cells) == pytest.approx(90 * 400)
    got = {r.id: r.cell_id for r in assign_points(points, index).collect()}
    for i, x, y in rows:
        holds = [c[0] for c in cells if c[1] <= x < c[3] and c[2] <= y < c[4]]
        assert [got[i]] == (holds or [-1])
    assert json.loads(index.spec())["kind"] == kind


def test_z_cells_hold_equal_shares(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(rng.uniform(0, 90), rng.uniform(0, 400)) for _ in range(800)], "x double, y double")
    index = build_index("zcurve", points, A12, 8)
    counts = {r.cell_id: r["count"] for r in assign_points(points, index).groupBy("cell_id").count().collect()}
    assert sorted(counts) == list(range(8)) and all(95 <= n <= 105 for n in counts.values())


def test_unknown_index(spark):
    with pytest.raises(ValueError):
        build_index("octree", None, A12, 4)


def test_quad_tree_in_memory():
    tree = QuadTree.from_array(P12, A12, 7)
    index = QuadTreeIndex(*A12)
    for cell in tree.cells():
        index.insert(*cell)
    assert sorted(c for c, _ in index.leaves()) == tree.leaves
    assert all(d == (c.bit_length() - 1) // 2 for c, d in index.leaves())
    by_id = {c: b for c, *b in tree.cells()}
    for x, y in P12:
        x1, y1, x2, y2 = by_id[index.find(x, y)]
        assert x1 <= x <= x2 and y1 <= y <= y2


def test_box_grid_ids(spark):
    grid = BoxGrid.build((0.0, 0.0, 0.0, 4.0, 3.0, 2.0), 24)
    spaces = grid.frame(spark)
    assert spaces.count() == grid.columns * grid.rows * grid.layers >= 24
    middle = spaces.selectExpr("space_id", "(x1+x2)/2 as x", "(y1+y2)/2 as y", "(z1+z2)/2 as z")
    assert all(r.space_id == r.found for r in middle.withColumn("found", grid.assign("x", "y", "z")).collect())


def test_grid_overlaps_equal_a_join(spark):
    from pyspark.sql import functions as F

    from trackloom.functions.geom import rect
    from trackloom.operators.partition import overlapping

    rng = random.Random(3)
    rows = [(i, x := rng.uniform(-5, 88), y := rng.uniform(-5, 390), x + rng.uniform(0.1, 30), y + rng.uniform(0.1, 90)) for i in range(200)]
    shapes = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    grid = Grid.build(None, A12, 17)
    one = {(r.id, r.c) for r in shapes.select("id", F.explode(grid.overlaps(rect())).alias("c")).collect()}
    two = {(r.id, r.cell_id) for r in overlapping(shapes, grid.frame(spark)).collect()}
    assert one == two
