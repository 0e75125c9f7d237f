"""Views that turn the test tables into GPS points, towers, calls, boxes and places.

Coordinates are derived from integer keys by exact arithmetic, so that the same
text gives bit-identical doubles on any engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LNG = "115.75E0 + 1.45E0 * CAST(((event_id * 7919) % 10007) AS DOUBLE) / CAST(10007 AS DOUBLE)"
_LAT = "39.5E0 + CAST(((event_id * 104729) % 10009) AS DOUBLE) / CAST(10009 AS DOUBLE)"
_LON = "120.7E0 + 1.5E0 * CAST(((c_custkey * 7919) % 10007) AS DOUBLE) / CAST(10007 AS DOUBLE)"
_TLAT = "30.62E0 + 1.2E0 * CAST(((c_custkey * 104729) % 10009) AS DOUBLE) / CAST(10009 AS DOUBLE)"
_PLACE = lambda key, a, m: f"CAST((({key} * {a}) % {m}) AS DOUBLE)"

#: View -> (tables and views that it reads, text). {sec} is the whole seconds of ts since 1970.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "gps": (("events",), f"SELECT event_id, ts, {{sec}} AS sec, CAST(user_id AS INT) AS car_id, {_LNG} AS lng, {_LAT} AS lat, CAST(floor(value) AS INT) AS speed FROM events"),
    "towers": (("customer",), f"SELECT c_custkey AS bid, {_LON} AS lon, {_TLAT} AS lat, c_nationkey % 17 + 1 AS region FROM customer"),
    "calls": (
        ("events",),
        """SELECT user_id AS "user", sec, CASE WHEN event_id % 10 = 0 THEN (event_id * 31) % 100
        WHEN (sec % 86400) < 9 * 3600 OR (sec % 86400) >= 22 * 3600 THEN (user_id * 37) % 100
        ELSE (user_id * 53 + 7) % 100 END AS bid FROM (SELECT event_id, user_id, {sec} AS sec FROM events) e""",
    ),
    "boxes": (
        ("part",),
        f"""SELECT p_partkey AS id, {_PLACE("p_partkey", 7919, 997)} AS x1, {_PLACE("p_partkey", 104729, 991)} AS y1, {_PLACE("p_partkey", 31, 97)} AS z1,
        {_PLACE("p_partkey", 7919, 997)} + p_size AS x2, {_PLACE("p_partkey", 104729, 991)} + p_size % 7 + 1 AS y2, {_PLACE("p_partkey", 31, 97)} + p_size % 5 + 1 AS z2 FROM part""",
    ),
    "live": (("orders",), """SELECT DISTINCT o_custkey AS "user", (o_orderkey * 37) % 100 AS bid FROM orders"""),
    "work": (("orders",), """SELECT DISTINCT o_custkey AS "user", (o_orderkey * 53 + 7) % 100 AS bid FROM orders"""),
    "live_at": (("live", "towers"), """SELECT l."user", l.bid, t.lon, t.lat, t.region FROM live l JOIN towers t ON l.bid = t.bid"""),
    "work_at": (("work", "towers"), """SELECT w."user", w.bid, t.lon, t.lat, t.region FROM work w JOIN towers t ON w.bid = t.bid"""),
}
_SEC = {"spark": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))", "duck": "CAST(floor(epoch(ts)) AS BIGINT)"}


def oracle(sql: str) -> str:
    """A query with the views that it names put before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, (_, body) in VIEWS.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    parts = [f"{name} AS ({VIEWS[name][1].replace('{sec}', _SEC['duck'])})" for name in wanted]
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    body = re.sub(r"^WITH (RECURSIVE )?", ", " if parts else r"WITH \1", body, flags=re.I)
    if not parts:
        return body
    return f"WITH {recursive}{', '.join(parts)} {body}"


class Views:
    """The tables and views of a folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.table(name)
        needs, sql = VIEWS[name]
        sql = sql.replace("{sec}", _SEC["spark"]).replace('"user"', "`user`")
        sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(needs)})\b", r"\1 {\2}", sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in needs})

    @cached_property
    def stream_ts(self) -> DataFrame:
        """gps with ts as a timestamp without zone."""
        return self.gps.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def epoch(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")
