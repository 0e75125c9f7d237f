"""Stays against a walk through the records, clusters against hand-worked groups."""

import random

import pytest

from trackloom.functions.grid import MiningGrid
from trackloom.operators import commute, sampling, stays

HOUR = 3600


def around(grid, c):
    x, y = c % grid.columns, c // grid.columns
    return {a + b * grid.columns for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) if 0 <= a < grid.columns and 0 <= b < grid.rows}


def walk(records, grid, smear):
    """Stays of one user by keeping every cell's last interval open."""
    out, prev, prev_sec = {}, None, None

    def touch(cells, t, gap):
        for c in cells:
            runs = out.setdefault(c, [])
            if runs and (gap is None or t - runs[-1][1] < gap):
                runs[-1][1] = t
            else:
                runs.append([t, t])

    for t, c in records:
        here = around(grid, c)
        if prev is None:
            touch(here, t, 2 * HOUR)
        elif c == prev and t - prev_sec < 12 * HOUR:
            touch(here, t, None)
        elif c in around(grid, prev) and c != prev and t - prev_sec < 12 * HOUR:
            there = around(grid, prev)
            touch(there, t, None)
            touch(here - there, t, smear * HOUR)
        else:
            touch(here, t, 2 * HOUR)
        prev, prev_sec = c, t
    return sorted((c, *r) for c, runs in out.items() for r in runs)


def test_stays_equal_the_walk(spark):
    grid, rng = MiningGrid(columns=6, rows=5), random.Random(11)
    rows, want = [], []
    for user in range(40):
        t, c = 0, rng.randrange(30)
        trace = []
        for _ in range(30):
            t += int(rng.choice([0.2, 1, 2, 3, 7, 8, 11.9, 12, 30]) * HOUR)
            c = rng.choice([c, c, rng.choice(sorted(around(grid, c))), rng.randrange(30)])
            trace.append((t, c))
            rows.append((user, t, len(trace), c))
        want += [(user, *s) for s in walk(trace, grid, 3)]
    records = spark.createDataFrame(rows, "user long, sec long, bid long, cell int")
    got = stays.stays_of(stays.touches(records, grid, 3)).collect()
    assert sorted((r.user, r.cell, r.begin, r.end) for r in got) == sorted(want)


def test_one_stay_of_four_hours(spark):
    grid = MiningGrid()
    records = spark.createDataFrame([(1, 22 * HOUR, 0, 5050), (1, 23 * HOUR, 0, 5050), (1, 26 * HOUR, 0, 5050)], "user long, sec long, bid long, cell int")
    got = stays.stays_of(stays.touches(records, grid, 8)).collect()
    assert len(got) == 9 and all(r.end - r.begin == 4 * HOUR for r in got)
    apart = spark.createDataFrame([(1, 0, 0, 50), (1, 12 * HOUR, 0, 50)], "user long, sec long, bid long, cell int")
    assert stays.stays_of(stays.touches(apart, grid, 8)).where("cell = 50").count() == 2


@pytest.mark.parametrize(("neighbours", "want"), [(0, {0: 0, 1: 0, 101: 0, 505: 505, 606: 606}), (2, {0: 1, 1: 1, 101: 1})])
def test_clusters(spark, neighbours, want):
    cells = spark.createDataFrame([(1, c) for c in (0, 1, 101, 505, 606)], "user long, cell int")
    got = {r.cell: r.cluster for r in stays.clusters(cells, MiningGrid(), neighbours).collect()}
    assert got == want


def test_long_chain_is_one_cluster(spark):
    cells = spark.createDataFrame([(1, c) for c in range(100)] + [(2, c) for c in range(0, 100, 2)], "user long, cell int")
    got = stays.clusters(cells, MiningGrid()).collect()
    assert {r.cluster for r in got if r.user == 1} == {0}
    assert len({r.cluster for r in got if r.user == 2}) == 50


def test_density_keeps_every_column(spark):
    points = spark.createDataFrame([(i + 0.5, 0.5) for i in range(10)] + [(10.0, 1.0)], "x double, y double")
    cells = sampling.density(points, (0.0, 0.0, 10.0, 1.0), 10, 1, "x", "y")
    assert sorted((r.col, r.n) for r in cells.collect()) == [(i, 1) for i in range(9)] + [(9, 2)]


def test_home_work_takes_one_row_each(spark):
    live = spark.createDataFrame([("u", 1, 1), ("u", 2, 2)], "user string, place int, seq int")
    work = spark.createDataFrame([("u", 7, 1), ("u", 8, 2), ("x", 9, 1)], "user string, place int, seq int")
    assert [tuple(r) for r in commute.home_work(live, work).collect()] == [("u", 2, 7)]


def test_work_apart_from_home(spark):
    live = spark.createDataFrame([("u", 121.40925, 31.21857)], "user string, lon double, lat double")
    work = spark.createDataFrame([("u", 121.40930, 31.21860), ("u", 121.57309, 31.14439), ("v", 0.0, 0.0)], "user string, lon double, lat double")
    assert sorted(r.lon for r in commute.apart_from_home(work, live).collect()) == [0.0, 121.57309]
