"""Queries take their whole tables."""

from trackloom.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_report_holds_the_users_of_all_hours(spark):
    users = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id").distinct().count()
    assert QUERIES["stay_st11_user_report"](spark, FOLDER).count() == users


def test_every_car_is_registered(spark):
    cars = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("count(distinct cast(user_id as int)) n", "count(user_id) rows").first()
    out = QUERIES["stream_ws12_registered"](spark, FOLDER)
    assert (out.select("query_id").distinct().count(), out.count()) == (cars.n, cars.rows)


def test_homes_come_from_all_orders(spark):
    from trackloom.plans.views import Views

    orders = {(r.o_custkey, r.o_orderkey * 37 % 100) for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()}
    assert {tuple(r) for r in Views(spark, FOLDER).live.collect()} == orders


def test_boxes_of_one_parity_meet(spark, tmp_path):
    """Keys 6962 apart, the least distance at which boxes of the test tables overlap, have one parity."""
    rows = [(k, 34) for k in (*range(1, 21), *range(6963, 6983))]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    low = {k: (k * 7919 % 997, k * 104729 % 991, k * 31 % 97) for k, _ in rows}
    size = {k: (n, n % 7 + 1, n % 5 + 1) for k, n in rows}
    meet = lambda a, b: all(low[a][i] + size[a][i] > low[b][i] and low[b][i] + size[b][i] > low[a][i] for i in range(3))
    want = sorted((a, b) for a in low for b in low if a < b and meet(a, b))
    got = sorted(tuple(r) for r in QUERIES["join_jn12_spatial_join"](spark, str(tmp_path)).select("a_id", "b_id").collect())
    assert got == want and any(a % 2 == b % 2 for a, b in want)
