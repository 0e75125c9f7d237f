"""A report gathers the towers of an area once for all its users, by either way the same."""

import pytest

from trackloom.functions.grid import MiningGrid
from trackloom.operators import stays

GRID = MiningGrid(columns=10, rows=10)


@pytest.mark.parametrize("few", [0, 1000])
def test_users_of_one_area_share_its_towers(spark, monkeypatch, few):
    monkeypatch.setattr(stays, "FEW_TOWERS", few)
    monkeypatch.setattr(stays, "MOST_USERS", 2)
    made = []
    towers = [(b, 120.71 + 0.15 * (b % 10), 30.63 + 0.12 * (b // 10 % 10), 1) for b in range(200)]
    centres = [(u, c) for u in (*range(7), None) for c in ((11, 55) if u is None or u % 2 else (99,))] * 2
    out = stays.user_report(
        spark.createDataFrame(centres, "user long, centre int"),
        spark.createDataFrame(towers, "bid long, lon double, lat double, region int"),
        GRID,
        shape=lambda bids: made.append(1) or bids,
    ).collect()
    near = lambda cells: sorted(b for b in range(200) if any(abs(b % 10 - c % 10) <= 1 and abs(b // 10 % 10 - c // 10) <= 1 for c in cells))
    assert {r.user: r.bids for r in out} == {u: near([99] if u is not None and u % 2 == 0 else [11, 55]) for u in (*range(7), None)}
    assert len(out) == 8 and made == [1]


def test_no_row_for_a_user_and_a_tower(spark):
    """50 users of one area with 20,000 towers: before, a million pairs were dealt out."""
    centres = spark.range(50).selectExpr("id AS user", "0 AS centre")
    towers = spark.range(20_000).selectExpr("id AS bid", "120.71D AS lon", "30.63D AS lat", "1 AS region")
    out = stays.user_report(centres, towers, GRID)
    assert "flatten(" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {len(r.bids) for r in out.collect()} == {20_000} and out.count() == 50
