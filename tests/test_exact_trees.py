"""Trees and curves of more points than the driver takes are those of all points."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import differences
from trackloom.operators.partition import KdTree, QuadTree, ZCurve
from trackloom.operators.partition.base import at_ranks, sampled
from trackloom.plans.catalog import ORACLES, QUERIES

AREA = (0.0, 0.0, 1000.0, 1000.0)


def _points(spark):
    """Ties in either coordinate, and one point many times."""
    x, y = (F.col("id") * 7919 % 97).cast("double") * 10, F.pow(F.col("id") * 104729 % 1009 / 1009, 3) * 999
    many = F.col("id") % 5 == 0
    return spark.range(6000).select(F.when(many, 310.0).otherwise(x).alias("x"), F.when(many, 77.0).otherwise(y).alias("y"))


@pytest.mark.parametrize("kind", [KdTree, QuadTree, ZCurve])
@pytest.mark.parametrize("n", [4, 7, 40])
def test_beyond_the_sample_all_points_count(spark, kind, n):
    points = _points(spark)
    whole = kind.from_array(sampled(points, "x", "y", 6000), AREA, n)
    assert kind.build(points, AREA, n, sample=50).spec() == whole.spec()


def test_quad_levels_in_steps(spark):
    from trackloom.functions import zorder

    points = _points(spark)
    codes = points.select(zorder.encode("x", "y", AREA).alias("z"))
    assert QuadTree._counted(codes, 6000, AREA, 40, most_counts=1).spec() == QuadTree.from_array(sampled(points, "x", "y", 6000), AREA, 40).spec()


def test_ranks_of_many_keys(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 31 % 7).cast("double").alias("a"), (F.col("id") * 1013 % 3001 - 1500).alias("b"))
    want = {g: sorted((r.a, r.b) for r in rows.collect() if r.g == g) for g in (0, 1)}
    got = at_ranks(rows, {0: [0, 700, 1499], 1: [3]}, ["a", "b"], few=10, most=8)
    assert got == {(g, r): want[g][r] for g, r in ((0, 0), (0, 700), (0, 1499), (1, 3))}


@pytest.mark.parametrize("name", ["ix_ix8_kd_assign", "ix_ix9_quad_leaves", "ix_ix10_quad_bounds", "ix_ix12_z_splits", "ix_ix13_z_assign"])
def test_trees_of_many_events_are_those_of_sql(spark, tmp_path, name):
    """150,000 events: more than the 100,000 points that come to the driver."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    twice = events.unionByName(events.where("event_id < 50000").withColumn("event_id", F.col("event_id") + 100000))
    twice.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert differences(QUERIES[name](spark, str(tmp_path)), c, ORACLES[name]) == ""


def test_cubes_of_large_keys(spark, tmp_path):
    """The cube of 1,199,999 is above 2**53."""
    spark.createDataFrame([(k, 3) for k in (1, 208065, 1199999, 2000001)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.id: r.cube for r in QUERIES["fn11_bits"](spark, str(tmp_path)).collect()} == {k: k**3 for k in (1, 208065, 1199999, 2000001)}
