"""The k-nearest join against all pairs."""

import math
import random

import pytest
from pyspark.sql import DataFrame

from trackloom.operators import joins


@pytest.mark.parametrize(("n", "k", "per_cell"), [(300, 3, 2), (2, 3, None)])
def test_nearest_join_is_that_of_all_pairs(spark, monkeypatch, n, k, per_cell):
    """Clustered and equal points, queries beyond their area; no join without a condition is planned."""
    rng = random.Random(4)
    points = [(i, *(rng.choice([(0.0, 0.0), (90.0, 5.0)]) if i % 3 == 0 else (rng.gauss(0, 1) * 10 ** (i % 3), rng.uniform(-50, 50)))) for i in range(n)]
    queries = [(i, x, y) for i, x, y in points[::5]] + [(1000, -500.0, 700.0), (1001, 95.0, 4.0)]
    monkeypatch.setattr(DataFrame, "crossJoin", None)
    q = spark.createDataFrame(queries + [(1002, None, 1.0)], "query_id long, lng double, lat double")
    p = spark.createDataFrame(points + [(5000, 1.0, None)], "event_id long, lng double, lat double")
    out = joins.nearest_join(q, p, k, "query_id", "event_id", per_cell=per_cell)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    want = []
    for i, x, y in queries:
        near = sorted((math.sqrt(math.pow(a - x, 2) + math.pow(b - y, 2)), j) for j, a, b in points)[:k]
        want += [(i, j, r + 1) for r, (_, j) in enumerate(near)]
    assert sorted((r.query_id, r.event_id, r["rank"]) for r in out.collect()) == sorted(want)
