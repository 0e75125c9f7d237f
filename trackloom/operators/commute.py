"""Home and work: joins of the two, populations, distances and their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geom import haversine

APART = 1000
#: Upper edges, in km, of the distance shares (fixed values).
SHARES = (2, 4, 6, 8, 10)


def first_per_user(rows: DataFrame, order: str, last: bool = False) -> DataFrame:
    """One row of each user: the first in order, or the last."""
    by = F.desc(order) if last else F.asc(order)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("user").orderBy(by))).where("_rn = 1").drop("_rn")


def home_work(live: DataFrame, work: DataFrame, order: str = "seq") -> DataFrame:
    """(user, live_*, work_*): a user's last home row beside the first work row."""
    one, two = first_per_user(live, order, last=True).drop(order), first_per_user(work, order).drop(order)
    one = one.select("user", *(F.col(c).alias(f"live_{c}") for c in one.columns if c != "user"))
    two = two.select("user", *(F.col(c).alias(f"work_{c}") for c in two.columns if c != "user"))
    return one.join(two, "user")


def of_district(rows: DataFrame, district: int, users: DataFrame) -> DataFrame:
    """Rows of the users whose districts hold the given one."""
    return rows.join(users.where(F.array_contains("districts", district)).select("user"), "user", "left_semi")


def district_pairs(live: DataFrame, work: DataFrame) -> DataFrame:
    """(home, work, n): users by home and work district; users with several count for each pair."""
    one = live.select("user", F.explode("districts").alias("home"))
    two = work.select("user", F.explode("districts").alias("work"))
    return one.join(two, "user").groupBy("home", "work").agg(F.count(F.lit(1)).alias("n"))


def same_district(live: DataFrame, work: DataFrame) -> DataFrame:
    """(district, n): users who live and work in a district."""
    return district_pairs(live, work).where("home = work").select(F.col("home").alias("district"), "n")


def population(rows: DataFrame) -> DataFrame:
    """(district, n) of rows(user, districts)."""
    return rows.select(F.explode("districts").alias("district")).groupBy("district").agg(F.count(F.lit(1)).alias("n"))


def apart_from_home(work: DataFrame, live: DataFrame, metres: float = APART) -> DataFrame:
    """Work places (user, lon, lat) at least so far from each of the user's homes."""
    home = live.select("user", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    w = work.alias("w")
    near = haversine("w.lon", "w.lat", "_lon", "_lat") < metres
    return w.join(home, (F.col("w.user") == home["user"]) & near, "left_anti")


def work_cells(work: DataFrame, live: DataFrame, order: str = "seq") -> DataFrame:
    """Work cells that are no home cell; of a user's rows for a cell the last is kept."""
    last = Window.partitionBy("user", "cell").orderBy(F.desc(order))
    one = work.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    return one.join(live.select("user", "cell"), ["user", "cell"], "left_anti")


def work_clusters(labels: DataFrame, live: DataFrame) -> DataFrame:
    """Clusters (user, cell, cluster) none of whose cells is a home cell."""
    bad = labels.join(live.select("user", "cell"), ["user", "cell"], "left_semi").select("user", "cluster").distinct()
    return labels.join(bad, ["user", "cluster"], "left_anti")


def distances(live: DataFrame, work: DataFrame, swap_axes: bool = False) -> DataFrame:
    """(user, live_lon, live_lat, metres): the farthest work place from each home; live and work hold arrays `locs` of (lon, lat)."""
    pairs = live.select("user", F.explode("locs").alias("h")).join(work.select("user", F.explode("locs").alias("w")), "user")
    far = haversine("h.lon", "h.lat", "w.lon", "w.lat", swap_axes=swap_axes)
    return pairs.groupBy("user", F.col("h.lon").alias("live_lon"), F.col("h.lat").alias("live_lat")).agg(F.max(far).alias("metres"))


def histogram(rows: DataFrame, metres: str = "metres") -> DataFrame:
    """(km, n)."""
    return rows.groupBy(F.floor(F.round(F.col(metres)) / 1000).cast("int").alias("km")).agg(F.count(F.lit(1)).alias("n"))


def shares(rows: DataFrame, metres: str = "metres") -> DataFrame:
    """One row with the share of distances below 2 km, from 2 to 4, ... and from 10."""
    km = F.floor(F.round(F.col(metres)) / 1000)
    edges = [0, *SHARES]
    total = F.count(F.lit(1))
    some = [(F.count_if((km >= a) & (km < b)) / total).alias(f"km_{a}_{b}") for a, b in zip(edges, edges[1:], strict=False)]
    return rows.agg(*some, (F.count_if(km >= SHARES[-1]) / total).alias(f"km_{SHARES[-1]}_up"))


def tourism(visits: DataFrame) -> DataFrame:
    """(day, region, n): visitors by day and district."""
    return visits.groupBy("day", "region").agg(F.count(F.lit(1)).alias("n"))
