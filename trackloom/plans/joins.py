"""Joins of points, cells, shapes, homes and work places."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.geom import BOX
from trackloom.operators import commute, joins
from trackloom.operators.partition import BoxGrid, Grid
from trackloom.plans.registry import query
from trackloom.plans.scalars import cell_sql
from trackloom.functions.grid import MiningGrid

AREA = (115.75, 39.5, 117.2, 40.5)
SPACE = (0.0, 0.0, 0.0, 1050.0, 1000.0, 105.0)
GRID = MiningGrid()
_GRID4 = BoxGrid.build(SPACE, 24)
#: The spaces of the 3-D grid as a table in SQL.
SPACES = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(
        [str(layer * _GRID4.rows * _GRID4.columns + row * _GRID4.columns + column + 1)]
        + [f"CAST({SPACE[i] + p * _GRID4.step[i]!r} AS DOUBLE)" for i, p in enumerate((column, row, layer))]
        + [f"CAST({(SPACE[i + 3] if p + 1 == n else SPACE[i] + (p + 1) * _GRID4.step[i])!r} AS DOUBLE)" for i, (p, n) in enumerate(((column, _GRID4.columns), (row, _GRID4.rows), (layer, _GRID4.layers)))]
    ) + ")"
    for layer in range(_GRID4.layers) for row in range(_GRID4.rows) for column in range(_GRID4.columns)
) + ") s(space_id, x1, y1, z1, x2, y2, z2)"
_MEET = "b.x2 > s.x1 AND s.x2 > b.x1 AND b.y2 > s.y1 AND s.y2 > b.y1 AND b.z2 > s.z1 AND s.z2 > b.z1"


def grid_cells_sql(grid: Grid) -> str:
    return "(VALUES " + ", ".join(f"({c}, " + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in r) + ")" for c, *r in grid.cells()) + ") c(cell_id, x1, y1, x2, y2)"


_G40 = Grid.build(None, AREA, 40)


@query("join_jn1_point_cell", f"SELECT g.event_id, CAST(coalesce(c.cell_id, -1) AS BIGINT) AS cell_id FROM gps g LEFT JOIN {grid_cells_sql(_G40)} ON g.lng >= c.x1 AND g.lng < c.x2 AND g.lat >= c.y1 AND g.lat < c.y2")
def jn1(v):
    return joins.locate(v.gps, _G40.frame(v.spark)).select("event_id", "cell_id")


@query("join_jn1_first_of_overlapping", "SELECT event_id, CAST(CASE WHEN lng >= 116E0 AND lng < 116.5E0 AND lat >= 39.7E0 AND lat < 40.1E0 THEN 1 WHEN lng >= 116.3E0 AND lng < 116.9E0 AND lat >= 39.9E0 AND lat < 40.3E0 THEN 2 ELSE -1 END AS BIGINT) AS cell_id FROM gps")
def jn1_first(v):
    cells = v.spark.createDataFrame([(1, 116.0, 39.7, 116.5, 40.1), (2, 116.3, 39.9, 116.9, 40.3)], "cell_id int, x1 double, y1 double, x2 double, y2 double")
    return joins.locate(v.gps, cells).select("event_id", "cell_id")


@query("join_jn2_towers", 'SELECT c."user", c.sec, c.bid, t.region FROM calls c JOIN towers t ON c.bid = t.bid')
def jn2(v):
    return joins.lookup_towers(v.calls, v.towers).select("user", "sec", "bid", "region")


@query("join_jn3_home_work", 'SELECT l."user", l.bid AS live_bid, w.bid AS work_bid FROM (SELECT "user", MAX(bid) AS bid FROM live GROUP BY 1) l JOIN (SELECT "user", MIN(bid) AS bid FROM work GROUP BY 1) w ON l."user" = w."user"')
def jn3(v):
    live, work = (d.withColumn("seq", F.col("bid")) for d in (v.live, v.work))
    return commute.home_work(live, work).select("user", "live_bid", "work_bid")


_DISTRICTS = 'SELECT "user", region FROM {t} GROUP BY 1, 2'


def _districts(rows):
    return rows.groupBy("user").agg(F.collect_set("region").alias("districts"))


@query("join_jn4_district_users", 'SELECT "user", bid FROM work WHERE "user" IN (SELECT "user" FROM live_at WHERE region = 17)')
def jn4(v):
    return commute.of_district(v.work, 17, _districts(v.live_at)).select("user", "bid")


@query("join_jn5_district_pairs", f'SELECT l.region AS home, w.region AS work, COUNT(*) AS n FROM ({_DISTRICTS.format(t="live_at")}) l JOIN ({_DISTRICTS.format(t="work_at")}) w ON l."user" = w."user" GROUP BY 1, 2')
def jn5(v):
    return commute.district_pairs(_districts(v.live_at), _districts(v.work_at))


_HAV = "2 * asin(sqrt(pow(sin((radians(w.lat) - radians(l.lat)) / 2), 2) + cos(radians(w.lat)) * cos(radians(l.lat)) * pow(sin((radians(w.lon) - radians(l.lon)) / 2), 2))) * 6378137"
_WHOLE = f"CAST(floor(CAST(floor({_HAV} * 10000 + 0.5) AS BIGINT) / 10000) AS BIGINT)"


@query("join_jn6_apart_from_home", f'SELECT w."user", w.bid FROM work_at w WHERE NOT EXISTS (SELECT 1 FROM live_at l WHERE l."user" = w."user" AND {_WHOLE} < 20000)')
def jn6(v):
    return commute.apart_from_home(v.work_at, v.live_at, 20_000).select("user", "bid")


@query("join_jn7_work_cells", f'SELECT DISTINCT "user", {cell_sql()} AS cell FROM work_at EXCEPT SELECT "user", {cell_sql()} AS cell FROM live_at')
def jn7(v):
    work = v.work_at.select("user", GRID.cell("lon", "lat").alias("cell"), F.col("bid").alias("seq"))
    live = v.live_at.select("user", GRID.cell("lon", "lat").alias("cell"))
    return commute.work_cells(work, live).select("user", "cell")


@query("join_jn8_work_clusters", f"""SELECT "user", cell, cluster FROM (SELECT DISTINCT "user", {cell_sql()} AS cell, bid % 3 AS cluster FROM work_at) w
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT "user" AS u, {cell_sql()} AS lc FROM live_at) l JOIN (SELECT DISTINCT "user" AS wu, {cell_sql()} AS wc, bid % 3 AS wk FROM work_at) x ON x.wu = l.u AND x.wc = l.lc WHERE x.wu = w."user" AND x.wk = w.cluster)""")
def jn8(v):
    labels = v.work_at.select("user", GRID.cell("lon", "lat").alias("cell"), (F.col("bid") % 3).alias("cluster")).distinct()
    live = v.live_at.select("user", GRID.cell("lon", "lat").alias("cell"))
    return commute.work_clusters(labels, live).select("user", "cell", "cluster")


@query("join_jn9_replicate", f"SELECT b.id, CAST(s.space_id AS BIGINT) AS space_id FROM boxes b JOIN ({SPACES}) s ON {_MEET}")
def jn9(v):
    return joins.replicate(v.boxes, _GRID4.frame(v.spark)).select("id", "space_id")


@query("join_jn9_repartition_once", f"SELECT b.id, CAST(s.space_id AS BIGINT) AS space_id FROM boxes b JOIN ({SPACES}) s ON {_MEET}")
def jn9_source(v):
    """Shapes stored once for each space they meet are dealt again and come out once for each."""
    spaces = _GRID4.frame(v.spark)
    stored = joins.replicate(v.boxes, spaces)
    named = spaces.select("space_id", F.struct(*BOX).alias("part"))
    source = stored.join(F.broadcast(named), "space_id").drop("space_id")
    return joins.replicate(source, spaces, "part").select("id", "space_id")


_VOLUME = "(least(b.x2, s.x2) - greatest(b.x1, s.x1)) * (least(b.y2, s.y2) - greatest(b.y1, s.y1)) * (least(b.z2, s.z2) - greatest(b.z1, s.z1))"


@query("join_jn10_most_overlap", f"SELECT id, CAST(space_id AS BIGINT) AS space_id FROM (SELECT b.id, s.space_id, row_number() OVER (PARTITION BY b.id ORDER BY {_VOLUME} DESC, s.space_id) AS rn FROM boxes b JOIN ({SPACES}) s ON {_MEET}) t WHERE rn = 1")
def jn10(v):
    return joins.most_overlap(v.boxes, _GRID4.frame(v.spark), "id").select("id", "space_id")


@query("join_jn11_partition_pairs", f"SELECT CAST(b.space_id AS BIGINT) AS a_id, CAST(s.space_id AS BIGINT) AS b_id FROM ({SPACES}) b JOIN (SELECT space_id, x1 + 100 AS x1, y1 + 100 AS y1, z1, x2 + 100 AS x2, y2 + 100 AS y2, z2 FROM ({SPACES}) q) s ON {_MEET}")
def jn11(v):
    a = _GRID4.frame(v.spark)
    moved = a.select("space_id", *((F.col(c) + 100 if c[0] in "xy" else F.col(c)).alias(c) for c in BOX))
    return joins.partition_pairs(a, moved)


@query("join_jn12_spatial_join", f"SELECT b.id AS a_id, s.id AS b_id FROM boxes b JOIN boxes s ON b.id < s.id AND {_MEET}")
def jn12(v):
    """All boxes with all others."""
    return joins.spatial_join(v.boxes, v.boxes, "id", "id", _GRID4.frame(v.spark)).where("a_id < b_id")


@query("join_jn12_nearest", "SELECT event_id, round(sqrt(pow(lng - 116.4E0, 2) + pow(lat - 39.9E0, 2)), 9) AS distance FROM gps ORDER BY sqrt(pow(lng - 116.4E0, 2) + pow(lat - 39.9E0, 2)), event_id LIMIT 25")
def jn12_nearest(v):
    return joins.nearest(v.gps, 116.4, 39.9, 25, "event_id").select("event_id", F.round("distance", 9).alias("distance"))


_NEAREST = """SELECT q AS query_id, event_id, rank FROM (SELECT a.event_id AS q, b.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY sqrt(pow(b.lng - a.lng, 2) + pow(b.lat - a.lat, 2)), b.event_id) AS rank
FROM (SELECT * FROM gps WHERE event_id % 20 = 0) a, gps b) t WHERE rank <= 3"""


@query("join_jn12_nearest_join", _NEAREST)
def jn12_join(v):
    """The searches of the whole table: every row whose id is divisible by 20, against all points."""
    q = v.gps.where("event_id % 20 = 0").select(F.col("event_id").alias("query_id"), "lng", "lat")
    return joins.nearest_join(q, v.gps, 3, "query_id", "event_id").select("query_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("agg_ag8_population", f"SELECT region AS district, COUNT(*) AS n FROM ({_DISTRICTS.format(t='live_at')}) t GROUP BY 1")
def ag8(v):
    return commute.population(_districts(v.live_at))


@query("agg_ag9_same_district", f'SELECT l.region AS district, COUNT(*) AS n FROM ({_DISTRICTS.format(t="live_at")}) l JOIN ({_DISTRICTS.format(t="work_at")}) w ON l."user" = w."user" AND l.region = w.region GROUP BY 1')
def ag9(v):
    return commute.same_district(_districts(v.live_at), _districts(v.work_at))


_FAR = f'SELECT l."user", l.lon, l.lat, MAX({_WHOLE}) AS metres FROM live_at l JOIN work_at w ON l."user" = w."user" GROUP BY 1, 2, 3'


def _locs(rows):
    return rows.groupBy("user").agg(F.collect_set(F.struct("lon", "lat")).alias("locs"))


@query("agg_ag13_farthest_work", f'SELECT "user", round(lon, 6) AS live_lon, round(metres / 100.0) AS hectometres FROM ({_FAR}) t')
def ag13(v):
    out = commute.distances(_locs(v.live_at), _locs(v.work_at))
    return out.select("user", F.round("live_lon", 6).alias("live_lon"), F.round(F.col("metres") / 100.0).alias("hectometres"))


@query("agg_ag12_distance_histogram", f"SELECT CAST(floor(metres / 1000) AS INT) AS km, COUNT(*) AS n FROM ({_FAR}) t GROUP BY 1")
def ag12(v):
    return commute.histogram(commute.distances(_locs(v.live_at), _locs(v.work_at)))


@query("agg_ag12_distance_shares", "SELECT " + ", ".join(f"CAST(COUNT(*) FILTER (WHERE metres >= {a}000 AND metres < {b}000) AS DOUBLE) / COUNT(*) AS km_{a}_{b}" for a, b in ((0, 2), (2, 4), (4, 6), (6, 8), (8, 10))) + f", CAST(COUNT(*) FILTER (WHERE metres >= 10000) AS DOUBLE) / COUNT(*) AS km_10_up FROM ({_FAR}) t")
def ag12_shares(v):
    return commute.shares(commute.distances(_locs(v.live_at), _locs(v.work_at)))
