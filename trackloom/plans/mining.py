"""Stays, clusters, districts and tourism from call logs, on a coarse grid so that the sparse test calls meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.grid import MiningGrid
from trackloom.operators import commute, stays
from trackloom.operators.scratch import cut
from trackloom.plans.registry import query
from trackloom.plans.scalars import cell_sql

N = 10
GRID = MiningGrid(columns=N, rows=N)
_D = "(SELECT * FROM (VALUES (-1), (0), (1)) dxs(dx), (VALUES (-1), (0), (1)) dys(dy)) d"
_ON = f"SELECT c.\"user\", c.sec, c.bid, t.region, t.cell FROM {{calls}} c JOIN (SELECT bid, region, {cell_sql(n=N)} AS cell FROM towers) t ON c.bid = t.bid"
_NIGHT = "(SELECT * FROM calls WHERE (sec % 86400) // 3600 < 9 OR (sec % 86400) // 3600 > 21)"
_DAY = "(SELECT * FROM calls WHERE (sec % 86400) // 3600 BETWEEN 6 AND 17 AND (sec // 86400 + 4) % 7 + 1 >= 3)"


def _inside(cell: str) -> str:
    return f"{cell} % {N} + d.dx BETWEEN 0 AND {N - 1} AND {cell} // {N} + d.dy BETWEEN 0 AND {N - 1}"


def _modes(calls: str, horizon: float) -> str:
    return f"""SELECT *, CASE WHEN prev IS NULL THEN 'first' WHEN sec - prev_sec < {int(horizon * 3600)} AND cell = prev THEN 'same'
    WHEN sec - prev_sec < {int(horizon * 3600)} AND abs(cell % {N} - prev % {N}) <= 1 AND abs(cell // {N} - prev // {N}) <= 1 THEN 'beside' ELSE 'far' END AS mode
    FROM (SELECT *, row_number() OVER w AS rn, lag(cell) OVER w AS prev, lag(sec) OVER w AS prev_sec FROM ({_ON.format(calls=calls)}) o WINDOW w AS (PARTITION BY "user" ORDER BY sec, bid)) p"""


def stays_sql(calls: str, smear: float) -> str:
    m = f"({_modes(calls, 12)}) m"
    touches = f"""SELECT "user", rn, sec, cell + dx + {N} * dy AS cell, CASE WHEN mode = 'same' THEN NULL ELSE 7200 END AS gap FROM {m}, {_D} WHERE mode <> 'beside' AND {_inside("cell")}
    UNION ALL SELECT "user", rn, sec, prev + dx + {N} * dy, NULL FROM {m}, {_D} WHERE mode = 'beside' AND {_inside("prev")}
    UNION ALL SELECT "user", rn, sec, cell + dx + {N} * dy, {int(smear * 3600)} FROM {m}, {_D} WHERE mode = 'beside' AND {_inside("cell")}
    AND NOT (abs(cell % {N} + dx - prev % {N}) <= 1 AND abs(cell // {N} + dy - prev // {N}) <= 1)"""
    marked = f'SELECT *, CASE WHEN last IS NULL OR (gap IS NOT NULL AND sec - last >= gap) THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(sec) OVER (PARTITION BY "user", cell ORDER BY rn) AS last FROM ({touches}) t) l'
    runs = f'SELECT *, SUM(fresh) OVER (PARTITION BY "user", cell ORDER BY rn) AS stay FROM ({marked}) k'
    return f'SELECT "user", cell, MIN(sec) AS "begin", MAX(sec) AS "end" FROM ({runs}) r GROUP BY "user", cell, stay'


def frequent_sql(stay_sql: str, least: float, gate: int, keep: int) -> str:
    long = f'"end" - "begin" >= {int(least * 3600)}'
    return f"""SELECT "user", cell, COUNT(*) FILTER (WHERE {long}) AS stays, CAST(SUM(CASE WHEN {long} THEN "end" - "begin" ELSE 0 END) AS BIGINT) AS dwell
    FROM ({stay_sql}) s GROUP BY 1, 2 HAVING COUNT(*) >= {gate} AND COUNT(*) FILTER (WHERE {long}) > {keep}"""


def _stays(v, calls, smear):
    return stays.stays_of(stays.touches(stays.on_grid(calls, v.towers, GRID), GRID, smear))


@query("stay_st1_night", stays_sql(_NIGHT, 8))
def st1_night(v):
    return _stays(v, stays.night_calls(v.calls), 8)


@query("stay_st1_day", stays_sql(_DAY, 3))
def st1_day(v):
    return _stays(v, stays.day_calls(v.calls), 3)


@query("stay_st2_frequent", frequent_sql(stays_sql(_NIGHT, 8), 1, 2, 1))
def st2(v):
    return stays.frequent(st1_night(v), 1, 2, 1)


@query("agg_ag17_dwell", f'SELECT "user", cell, CAST(SUM("end" - "begin") AS BIGINT) AS dwell FROM ({stays_sql(_NIGHT, 8)}) s GROUP BY 1, 2')
def ag17(v):
    return stays.dwell_time(st1_night(v))


_CELLS = f'SELECT DISTINCT "user", cell FROM ({_ON.format(calls="calls")}) o'
_BESIDE = f"(abs({{a}} % {N} - {{b}} % {N}) + abs({{a}} // {N} - {{b}} // {N}) = 1)"


def clusters_sql(cells: str) -> str:
    return f"""WITH RECURSIVE f AS ({cells}), reach AS (SELECT "user", cell AS a, cell AS b FROM f
    UNION SELECT r."user", r.a, f.cell FROM reach r JOIN f ON f."user" = r."user" AND {_BESIDE.format(a="r.b", b="f.cell")})
    SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2"""


def _cells(v):
    return stays.on_grid(v.calls, v.towers, GRID).select("user", "cell").distinct()


@query("stay_st3_clusters", clusters_sql(_CELLS))
def st3(v):
    return stays.clusters(_cells(v), GRID)


_CORE = f"""f AS ({_CELLS}), deg AS (SELECT x."user", x.cell, COUNT(*) AS n FROM f x JOIN f y ON x."user" = y."user" AND {_BESIDE.format(a="x.cell", b="y.cell")} GROUP BY 1, 2),
core AS (SELECT "user", cell FROM deg WHERE n >= 2), reach AS (SELECT "user", cell AS a, cell AS b FROM core UNION SELECT r."user", r.a, c.cell FROM reach r JOIN core c ON c."user" = r."user" AND {_BESIDE.format(a="r.b", b="c.cell")}),
lab AS (SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2)"""


@query("stay_st4_core_clusters", f"""WITH RECURSIVE {_CORE} SELECT * FROM lab UNION ALL
SELECT f."user", f.cell, MIN(l.cluster) FROM f JOIN lab l ON f."user" = l."user" AND {_BESIDE.format(a="f.cell", b="l.cell")} WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c."user" = f."user" AND c.cell = f.cell) GROUP BY 1, 2""")
def st4(v):
    return stays.clusters(_cells(v), GRID, neighbours=2)


@query("stay_st5_centres", clusters_sql(_CELLS).replace('SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2', f'SELECT "user", cluster, COUNT(*) AS cells, CAST(SUM(cell % {N}) // COUNT(*) + {N} * (SUM(cell // {N}) // COUNT(*)) AS INT) AS centre FROM (SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2) l GROUP BY 1, 2'))
def st5(v):
    return stays.cluster_centres(st3(v), GRID)


@query("stay_st6_core_cells", clusters_sql(_CELLS).replace('SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2', f""", lab AS (SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2),
full_cells AS (SELECT l."user", l.cluster, l.cell FROM lab l, {_D} LEFT JOIN lab o ON o."user" = l."user" AND o.cluster = l.cluster AND o.cell = l.cell + d.dx + {N} * d.dy
WHERE (d.dx <> 0 OR d.dy <> 0) AND {_inside("l.cell")} GROUP BY 1, 2, 3 HAVING COUNT(*) = COUNT(o.cell))
SELECT * FROM full_cells UNION ALL SELECT "user", cluster, CAST(SUM(cell % {N}) // COUNT(*) + {N} * (SUM(cell // {N}) // COUNT(*)) AS INT) AS cell FROM lab l WHERE NOT EXISTS (SELECT 1 FROM full_cells x WHERE x."user" = l."user" AND x.cluster = l.cluster) GROUP BY 1, 2"""))
def st6(v):
    return stays.core_cells(st3(v), GRID)


def legacy_sql(calls: str, horizon: float, longer: float) -> str:
    m = _modes(calls, horizon)
    rows = f"""SELECT *, CASE WHEN lead(mode) OVER (PARTITION BY "user" ORDER BY rn) = 'beside' THEN lead(sec) OVER (PARTITION BY "user" ORDER BY rn) END AS hop,
    SUM(CASE WHEN mode = 'same' THEN 0 ELSE 1 END) OVER (PARTITION BY "user" ORDER BY rn) AS run FROM ({m}) m"""
    runs = f'SELECT "user", run, cell, MIN(sec) AS "begin", greatest(MAX(sec), MAX(hop)) AS "end" FROM ({rows}) r GROUP BY 1, 2, 3'
    return f'SELECT "user", cell + dx + {N} * dy AS cell, "begin", "end" FROM ({runs}) s, {_D} WHERE "end" - "begin" > {int(longer * 3600)} AND {_inside("cell")}'


@query("stay_st7_legacy_night", legacy_sql("(SELECT * FROM calls WHERE (sec % 86400) // 3600 NOT BETWEEN 9 AND 19)", 12, 4))
def st7_night(v):
    return stays.legacy_stays(stays.on_grid(stays.legacy_night(v.calls), v.towers, GRID), GRID, 12, 4)


@query("stay_st7_legacy_day", legacy_sql("(SELECT * FROM calls WHERE (sec // 86400 + 4) % 7 + 1 BETWEEN 2 AND 6 AND (sec % 86400) // 3600 BETWEEN 9 AND 16)", 3, 0))
def st7_day(v):
    return stays.legacy_stays(stays.on_grid(stays.legacy_day(v.calls), v.towers, GRID), GRID, 3, 0)


def region_sql(calls: str, gap: float, stay: float) -> str:
    rows = f"""SELECT *, SUM(fresh) OVER (PARTITION BY "user" ORDER BY sec, region ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(region) OVER w = region AND sec - lag(sec) OVER w <= {int(gap * 3600)} THEN 0 ELSE 1 END AS fresh FROM (SELECT c."user", c.sec, t.region FROM {calls} c JOIN towers t ON c.bid = t.bid) j WINDOW w AS (PARTITION BY "user" ORDER BY sec, region)) f"""
    return f'SELECT "user", region, MIN(sec) AS "begin", MAX(sec) AS "end" FROM ({rows}) r GROUP BY "user", run, region HAVING MAX(sec) - MIN(sec) >= {int(stay * 3600)}'


def _regions(v):
    return v.calls.join(v.towers, "bid").select("user", "sec", "region")


@query("stay_st8_region_stays", region_sql("calls", 24, 4))
def st8(v):
    return stays.region_stays(_regions(v), 24, 4)


@query("stay_st9_visited_days", f'SELECT DISTINCT "user", unnest([CAST("begin" // 86400 AS BIGINT), CAST("end" // 86400 AS BIGINT)]) AS day, region FROM ({region_sql("calls", 24, 4)}) s')
def st9(v):
    return stays.visited_days(st8(v))


@query("agg_ag10_tourism", f'SELECT day, region, COUNT(*) AS n FROM (SELECT DISTINCT "user", unnest([CAST("begin" // 86400 AS BIGINT), CAST("end" // 86400 AS BIGINT)]) AS day, region FROM ({region_sql("calls", 24, 4)}) s) t GROUP BY 1, 2')
def ag10(v):
    return commute.tourism(st9(v))


@query("stay_st10_merge", f"""SELECT "user", cell, "begin", "end" FROM (SELECT *, COUNT(*) OVER (PARTITION BY "user", cell) AS k FROM (SELECT "user", cell, run, MIN("begin") AS "begin", MAX("end") AS "end" FROM (SELECT *, SUM(fresh) OVER (PARTITION BY "user", cell ORDER BY "begin", "end" ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, CASE WHEN "begin" - MAX("end") OVER (PARTITION BY "user", cell ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 86400 THEN 0 ELSE 1 END AS fresh FROM ({stays_sql(_NIGHT, 8)}) s) f) g GROUP BY 1, 2, 3) m WHERE "end" - "begin" >= 7200) q WHERE k >= 2""")
def st10(v):
    return stays.merge_stays(st1_night(v), 24, 2, 2)


_VOTES = f"""SELECT cell, region, COUNT(*) AS n FROM (SELECT {cell_sql()} AS cell, region FROM towers) o GROUP BY 1, 2"""
_NEAR = f"""SELECT cell + dx + 100 * dy AS cell, region, COUNT(*) AS n FROM (SELECT {cell_sql()} AS cell, region FROM towers) o, {_D} WHERE (dx <> 0 OR dy <> 0) AND cell % 100 + dx BETWEEN 0 AND 99 AND cell // 100 + dy BETWEEN 0 AND 99
AND cell + dx + 100 * dy NOT IN (SELECT {cell_sql()} FROM towers) GROUP BY 1, 2"""


@query("agg_ag14_cell_regions", f"SELECT cell, region FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, region) AS rn FROM ({_VOTES} UNION ALL {_NEAR}) u) r WHERE rn = 1")
def ag14(v):
    return stays.cell_regions(v.towers, MiningGrid())


@query("agg_ag15_cell_centres", f"SELECT cell, round(AVG(lon), 6) AS lon, round(AVG(lat), 6) AS lat FROM (SELECT {cell_sql()} AS cell, lon, lat FROM towers) t GROUP BY 1")
def ag15(v):
    grid = MiningGrid()
    cells = stays.cell_towers(v.towers, grid).select("cell").distinct()
    return stays.cell_centres(cells, v.towers, grid).select("cell", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("agg_ag16_longest_cell", f"""WITH RECURSIVE f AS ({_CELLS}), reach AS (SELECT "user", cell AS a, cell AS b FROM f UNION SELECT r."user", r.a, f.cell FROM reach r JOIN f ON f."user" = r."user" AND {_BESIDE.format(a="r.b", b="f.cell")})
SELECT "user", cluster, cell FROM (SELECT l.*, row_number() OVER (PARTITION BY l."user", cluster ORDER BY dwell DESC, l.cell) AS rn FROM (SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2) l JOIN (SELECT "user", cell, SUM("end" - "begin") AS dwell FROM ({stays_sql(_NIGHT, 8)}) s GROUP BY 1, 2) w ON w."user" = l."user" AND w.cell = l.cell) q WHERE rn = 1""")
def ag16(v):
    return stays.longest_cell(st3(v), ag17(v))


@query("agg_ag16_weighted_centres", clusters_sql(_CELLS).replace('SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2', f"""SELECT "user", cluster, round(SUM(lon * w) / SUM(w), 6) AS lon, round(SUM(lat * w) / SUM(w), 6) AS lat FROM (SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2) l
JOIN (SELECT {cell_sql(n=N)} AS cell, AVG(lon) AS lon, AVG(lat) AS lat, COUNT(*) AS w FROM towers GROUP BY 1) t ON t.cell = l.cell GROUP BY 1, 2"""))
def ag16_weighted(v):
    out = stays.weighted_centres(st3(v), v.towers, GRID)
    return out.select("user", "cluster", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("agg_ag18_active_days", 'SELECT "user", COUNT(DISTINCT sec // 86400) AS days, COUNT(DISTINCT sec // 86400) / CAST(60 AS DOUBLE) < 0.3E0 AS tourist FROM calls GROUP BY 1')
def ag18(v):
    return stays.active_days(v.calls, 60)


@query("stay_st11_user_report", f"""SELECT u."user", string_agg(DISTINCT CAST(t.bid AS VARCHAR), ';' ORDER BY CAST(t.bid AS VARCHAR)) AS bids FROM (SELECT DISTINCT "user", cell FROM ({_ON.format(calls="calls")}) o) u
JOIN (SELECT bid, {cell_sql(n=N)} AS cell FROM towers) t ON abs(t.cell % {N} - u.cell % {N}) <= 1 AND abs(t.cell // {N} - u.cell // {N}) <= 1 GROUP BY 1""")
def st11(v):
    """The report over the calls of all hours."""
    listed = lambda bids: F.array_join(F.sort_array(bids.cast("array<string>")), ";")
    return stays.user_report(_cells(v).withColumnRenamed("cell", "centre"), v.towers, GRID, shape=listed).select("user", "bids")


@query("stay_st12_record_order", f'SELECT "user", sec, bid, row_number() OVER (PARTITION BY "user" ORDER BY sec, bid) AS place FROM (SELECT DISTINCT "user", sec, bid FROM calls) c')
def st12(v):
    from pyspark.sql import Window

    order = Window.partitionBy("user").orderBy("sec", "bid")
    return v.calls.distinct().withColumn("place", F.row_number().over(order).cast("long"))


_FREQ = frequent_sql(stays_sql(_NIGHT, 8), 0, 1, 0)


@query("stay_st13_live_places", clusters_sql(f'SELECT "user", cell FROM ({_FREQ}) q').replace('SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2', f'SELECT "user", cluster, COUNT(*) AS cells, CAST(SUM(cell % {N}) // COUNT(*) + {N} * (SUM(cell // {N}) // COUNT(*)) AS INT) AS centre FROM (SELECT "user", a AS cell, MIN(b) AS cluster FROM reach GROUP BY 1, 2) l GROUP BY 1, 2'))
def st13(v):
    """The chain from calls to centres, with rules loose enough for the sparse test calls."""
    return stays.live_places(stays.night_calls(v.calls), v.towers, GRID, {"smear": 8, "least": 0}, gate=1, keep=0)


@query("agg_ag20_counters", f"""SELECT 'calls' AS counter, COUNT(*) AS n FROM calls UNION ALL SELECT 'calls.night', COUNT(*) FROM {_NIGHT} c
UNION ALL SELECT 'users', COUNT(DISTINCT "user") FROM calls UNION ALL SELECT 'users.tourists', COUNT(*) FROM (SELECT 1 AS one FROM calls GROUP BY "user" HAVING COUNT(DISTINCT sec // 86400) / CAST(60 AS DOUBLE) < 0.3E0) t""")
def ag20(v):
    """Counters filled while the report of active days is written."""
    from trackloom.operators.counters import Counters

    counters = Counters()
    calls = counters.watch(v.calls, "calls", night=(stays.hour_of("sec") < 9) | (stays.hour_of("sec") > 21))
    users = counters.watch(stays.active_days(calls, 60), "users", tourists=F.col("tourist"))
    cut(users)
    return v.spark.createDataFrame(sorted(counters.values().items()), "counter string, n long")
