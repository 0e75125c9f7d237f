"""Parsing, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import codecs, geom, zorder
from trackloom.functions.grid import MiningGrid
from trackloom.operators import stays
from trackloom.plans.registry import query
from trackloom.sources import readers

BJ = (115.75, 39.5, 117.2, 40.5)
GRID = MiningGrid()
_SPREAD = ((16, 281470681808895), (8, 71777214294589695), (4, 1085102592571150095), (2, 3689348814741910323), (1, 6148914691236517205))


def morton_sql(ix: str, iy: str, source: str, keep: str) -> str:
    """Morton code z of two integer expressions, a step of the bit spread in each nested select."""
    out = f"SELECT {keep}, {ix} AS a, {iy} AS b FROM {source}"
    for shift, mask in _SPREAD:
        out = f"SELECT {keep}, (a | (a << {shift})) & {mask} AS a, (b | (b << {shift})) & {mask} AS b FROM ({out}) s{shift}"
    return f"SELECT {keep}, (a << 1) | b AS z FROM ({out}) m"


def scaled_sql(v: str, low: float, high: float) -> str:
    return f"CAST(floor(greatest(least(({v} - CAST({low!r} AS DOUBLE)) * 2147483647E0 / CAST({high - low!r} AS DOUBLE), 2147483647E0), 0E0)) AS BIGINT)"


GPS_Z = morton_sql(scaled_sql("lng", BJ[0], BJ[2]), scaled_sql("lat", BJ[1], BJ[3]), "gps", "event_id")
_CELL = f"""CAST(floor(CAST((CAST({{x}} AS FLOAT) - CAST({{low}} AS FLOAT)) / CAST((CAST({{width!r}} AS FLOAT) / CAST({{n}} AS FLOAT)) AS FLOAT) AS FLOAT)) AS INT)"""


def place_sql(x: str, low: float, high: float, n: int) -> str:
    return _CELL.format(x=x, low=low, width=high - low, n=n)


def cell_sql(lon: str = "lon", lat: str = "lat", n: int = 100) -> str:
    return f"({place_sql(lon, 120.7, 122.2, n)} + {n} * {place_sql(lat, 30.62, 31.82, n)})"


@query("prj_prj1_parse_gps", "SELECT CAST(sec AS BIGINT) AS time, car_id, CAST(event_id % 100 AS FLOAT) + CAST(0.5 AS FLOAT) AS lng, CAST(event_id % 50 AS FLOAT) + CAST(0.25 AS FLOAT) AS lat, speed FROM gps")
def prj1(v):
    """Lines written from the view and parsed back; the speed's fraction is cut."""
    fields = [F.col("car_id"), F.concat((F.col("event_id") % 100).cast("string"), F.lit(".5")), F.concat((F.col("event_id") % 50).cast("string"), F.lit(".25")), F.concat(F.col("speed").cast("string"), F.lit(".75"))]
    return readers.gps_lines(v.gps.select(F.concat(F.col("sec").cast("string"), F.lit("\t"), F.concat_ws(",", *(f.cast("string") for f in fields))).alias("value")))


@query("prj_prj2_salted_region", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 9223372036854775807 ELSE (CAST(event_id % 500 AS BIGINT) << 32) + car_id % 7 END AS region FROM gps")
def prj2(v):
    cell = F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("event_id") % 500)
    return v.gps.select("event_id", codecs.salted_region(cell, "car_id").alias("region"))


@query("prj_prj3_row_key", "SELECT event_id, upper(lpad(to_hex(CAST(event_id % 500 AS BIGINT)), 16, '0') || lpad(to_hex(CAST(car_id AS BIGINT)), 8, '0') || lpad(to_hex(sec), 16, '0')) AS row_key FROM gps")
def prj3(v):
    return v.gps.select("event_id", F.hex(codecs.row_key(F.col("event_id") % 500, "car_id", "sec")).alias("row_key"))


@query("prj_prj5_parse_calls", 'SELECT CAST("user" AS VARCHAR) AS "user", sec, CAST(bid AS VARCHAR) AS bid FROM calls WHERE sec % 7 <> 0')
def prj5(v):
    """Lines with an unreadable time are left out."""
    when = F.when(F.col("sec") % 7 == 0, F.lit("no time")).otherwise(F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm:ss"))
    lines = v.calls.select(F.concat_ws(",", F.col("user").cast("string"), when, F.col("bid").cast("string")).alias("value"))
    return readers.call_lines(lines).select("user", "sec", "bid")


@query("flt4_inside_cells", "SELECT event_id, car_id FROM gps WHERE lng >= 116E0 AND lng < 116.5E0 AND lat >= 39.75E0 AND lat < 40E0")
def flt4(v):
    cells = v.spark.createDataFrame([(1, 116.0, 39.75, 116.25, 40.0), (2, 116.25, 39.75, 116.5, 40.0)], "cell_id int, x1 double, y1 double, x2 double, y2 double")
    from trackloom.operators.joins import locate

    return locate(v.gps, cells).where("cell_id >= 0").select("event_id", "car_id")


@query("flt4_outside_cells", "SELECT COUNT(*) AS n FROM gps WHERE NOT (lng >= 116E0 AND lng < 116.5E0 AND lat >= 39.75E0 AND lat < 40E0)")
def flt4_out(v):
    cells = v.spark.createDataFrame([(1, 116.0, 39.75, 116.25, 40.0), (2, 116.25, 39.75, 116.5, 40.0)], "cell_id int, x1 double, y1 double, x2 double, y2 double")
    from trackloom.operators.joins import locate

    return locate(v.gps, cells).where("cell_id = -1").agg(F.count(F.lit(1)).alias("n"))


_HOUR, _WEEKDAY = "(sec % 86400) // 3600", "((sec // 86400 + 4) % 7 + 1)"


@query("flt5_day_hours", f'SELECT "user", sec, bid FROM calls WHERE {_HOUR} BETWEEN 6 AND 17 AND {_WEEKDAY} >= 3')
def flt5(v):
    return stays.day_calls(v.calls).select("user", "sec", "bid")


@query("flt6_night_hours", f'SELECT "user", sec, bid FROM calls WHERE {_HOUR} < 9 OR {_HOUR} > 21')
def flt6(v):
    return stays.night_calls(v.calls).select("user", "sec", "bid")


@query("flt7_legacy_night", f'SELECT "user", sec, bid FROM calls WHERE {_HOUR} NOT BETWEEN 9 AND 19')
def flt7n(v):
    return stays.legacy_night(v.calls).select("user", "sec", "bid")


@query("flt7_legacy_day", f'SELECT "user", sec, bid FROM calls WHERE {_WEEKDAY} BETWEEN 2 AND 6 AND {_HOUR} BETWEEN 9 AND 16')
def flt7d(v):
    return stays.legacy_day(v.calls).select("user", "sec", "bid")


@query("flt8_host_lines", "SELECT 'a' || repeat(chr(9), 10) || url || chr(9) || CAST(page_id AS VARCHAR) AS value FROM pages WHERE contains(url, 'example.com')")
def flt8(v):
    lines = v.pages.select(F.concat(F.lit("a" + "\t" * 10), "url", F.lit("\t"), F.col("page_id").cast("string")).alias("value"))
    return readers.web_lines(lines, "example.com")


@query("flt9_readable_times", "SELECT COUNT(*) AS n FROM calls WHERE sec % 7 <> 0")
def flt9(v):
    return prj5(v).agg(F.count(F.lit(1)).alias("n"))


@query("fn1_distances", "SELECT id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS flat, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)), 6) AS full_dist FROM boxes")
def fn1(v):
    return v.boxes.select("id", F.round(geom.planar_distance("x1", "y1", "x2", "y2"), 6).alias("flat"), F.round(geom.spatial_distance("x1", "y1", "z1", "x2", "y2", "z2"), 6).alias("full_dist"))


_HAV = "2 * asin(sqrt(pow(sin((radians({b}) - radians({d})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({a}) - radians({c})) / 2), 2))) * 6378137"


@query("fn2_haversine", f"SELECT bid, CAST(round({_HAV.format(a='lon', b='lat', c='121.4E0', d='31.2E0')} / 10) AS BIGINT) AS decametres FROM towers")
def fn2(v):
    return v.towers.select("bid", F.round(geom.haversine("lon", "lat", 121.4, 31.2, whole_metres=False) / 10).cast("long").alias("decametres"))


@query("fn3_haversine_swapped", f"SELECT bid, CAST(round({_HAV.format(a='lat', b='lon', c='31.2E0', d='121.4E0')} / 10) AS BIGINT) AS decametres FROM towers")
def fn3(v):
    return v.towers.select("bid", F.round(geom.haversine("lon", "lat", 121.4, 31.2, whole_metres=False, swap_axes=True) / 10).cast("long").alias("decametres"))


@query(
    "fn4_rectangle_metrics",
    """SELECT id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS width, y2 - y1 AS height,
    round(sqrt(pow(greatest(x1 - 500, 500 - x2, 0), 2) + pow(greatest(y1 - 500, 500 - y2, 0), 2)), 6) AS near,
    round(sqrt(pow(greatest(abs(500 - x1), abs(500 - x2)), 2) + pow(greatest(abs(500 - y1), abs(500 - y2)), 2)), 6) AS far,
    round(sqrt(pow(greatest(x1 - 120, 100 - x2, 0), 2) + pow(greatest(y1 - 130, 110 - y2, 0), 2)), 6) AS rect_near,
    round(sqrt(pow(greatest(120 - x1, x2 - 100), 2) + pow(greatest(130 - y1, y2 - 110), 2)), 6) AS rect_far,
    x1 - 2 AS buffered, y2 + 5 AS moved FROM boxes""",
)
def fn4(v):
    r, s = geom.rect(), geom.rect(100.0, 110.0, 120.0, 130.0)
    (cx, cy), (w, h) = geom.rect_centre(r), geom.rect_size(r)
    rows = [cx.alias("cx"), cy.alias("cy"), w.alias("width"), h.alias("height"), F.round(geom.rect_point_min(r, 500.0, 500.0), 6).alias("near"), F.round(geom.rect_point_max(r, 500.0, 500.0), 6).alias("far")]
    rows += [F.round(geom.rect_rect_min(r, s), 6).alias("rect_near"), F.round(geom.rect_rect_max(r, s), 6).alias("rect_far"), geom.rect_buffer(r, 2.0, 3.0)["x1"].alias("buffered"), geom.rect_translate(r, 4.0, 5.0)["y2"].alias("moved")]
    return v.boxes.select("id", *rows)


@query(
    "fn5_predicates",
    """SELECT id, x1 <= 500 AND 500 < x2 AND y1 <= 500 AND 500 < y2 AS has_point, x1 >= 100 AND x2 <= 600 AND y1 >= 100 AND y2 <= 600 AS within,
    x2 > 100 AND x1 < 600 AND y2 > 100 AND y1 < 600 AS overlaps, x1 <= 500 AND 500 <= x2 AND y1 <= 500 AND 500 <= y2 AND z1 <= 50 AND 50 <= z2 AS box_has,
    x2 > 100 AND x1 < 600 AND y2 > 100 AND y1 < 600 AND z2 > 10 AND z1 < 60 AS boxes_meet FROM boxes""",
)
def fn5(v):
    r, s, b = geom.rect(), geom.rect(100.0, 100.0, 600.0, 600.0), geom.box()
    return v.boxes.select("id", geom.rect_has_point(r, 500.0, 500.0).alias("has_point"), geom.rect_has_rect(s, r).alias("within"), geom.rects_overlap(r, s).alias("overlaps"), geom.box_has_point(b, 500.0, 500.0, 50.0).alias("box_has"), geom.boxes_overlap(b, geom.box(100.0, 100.0, 10.0, 600.0, 600.0, 60.0)).alias("boxes_meet"))


@query(
    "fn6_box_algebra",
    """SELECT id, CASE WHEN m THEN greatest(x1, 100) END AS ix1, CASE WHEN m THEN least(z2, 60) END AS iz2, least(x1, 100) AS ux1, greatest(z2, 60) AS uz2,
    (z1 + z2) / 2 AS cz, (x2 - x1) * (y2 - y1) * (z2 - z1) AS volume FROM (SELECT *, x2 > 100 AND x1 < 600 AND y2 > 100 AND y1 < 600 AND z2 > 10 AND z1 < 60 AS m FROM boxes) t""",
)
def fn6(v):
    b, c = geom.box(), geom.box(100.0, 100.0, 10.0, 600.0, 600.0, 60.0)
    i, u = geom.box_intersection(b, c), geom.box_union(b, c)
    return v.boxes.select("id", i["x1"].alias("ix1"), i["z2"].alias("iz2"), u["x1"].alias("ux1"), u["z2"].alias("uz2"), geom.box_centre(b)[2].alias("cz"), geom.box_volume(b).alias("volume"))


@query("fn7_shape_order", "SELECT id, row_number() OVER (ORDER BY z1, x1, y1, z2, x2, y2, id) AS place FROM boxes")
def fn7(v):
    from pyspark.sql import Window

    return v.boxes.select("id", F.row_number().over(Window.orderBy(geom.box_order(geom.box()), "id")).cast("long").alias("place"))


@query("fn8_morton", GPS_Z)
def fn8(v):
    return v.gps.select("event_id", zorder.encode("lng", "lat", BJ).alias("z"))


@query("fn9_morton_round_trip", f"SELECT event_id, {scaled_sql('lng', BJ[0], BJ[2])} AS ix, {scaled_sql('lat', BJ[1], BJ[3])} AS iy FROM gps")
def fn9(v):
    ix, iy = zorder.deinterleave(zorder.encode("lng", "lat", BJ))
    return v.gps.select("event_id", ix.alias("ix"), iy.alias("iy"))


@query("fn10_range_cell", "SELECT id, (CAST(x1 AS BIGINT) >> k) << k AS low, ((CAST(x1 AS BIGINT) >> k) << k) + (1 << k) - 1 AS high FROM (SELECT id, x1, CAST(id % 5 AS BIGINT) AS k FROM boxes) t")
def fn10(v):
    """The quadrant of two codes that differ below bit 2k only is a square of side 2^k."""
    k = (F.col("id") % 5).cast("int")
    base = F.expr("shiftright(cast(x1 as long), cast(id % 5 as int)) * cast(pow(2, id % 5) as long)")
    width = F.pow(F.lit(2.0), k).cast("long")
    z1, z2 = zorder.interleave(base, base), zorder.interleave(base + width - 1, base + width - 1)
    x1, _, x2, _ = zorder.range_cell(z1, z2)
    return v.boxes.select("id", x1.alias("low"), x2.alias("high"))


@query("fn11_bits", "SELECT id, CAST(CASE WHEN id = 0 THEN 0 ELSE floor(log2(id)) + 1 END AS INT) AS bits, CAST(id * id * id AS BIGINT) AS cube FROM boxes")
def fn11(v):
    key = F.col("id").cast("long")
    return v.boxes.select("id", zorder.significant_bits("id").alias("bits"), (key * key * key).alias("cube"))


@query("fn12_grid_cell", f"SELECT bid, {cell_sql()} AS cell FROM towers")
def fn12(v):
    return v.towers.select("bid", GRID.cell("lon", "lat").alias("cell"))


_AROUND = "SELECT c.cell, c.cell + d.dx + 100 * d.dy AS near FROM (SELECT DISTINCT {cell} AS cell FROM towers) c, (SELECT * FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) d WHERE (d.dx <> 0 OR d.dy <> 0) AND c.cell % 100 + d.dx BETWEEN 0 AND 99 AND c.cell // 100 + d.dy BETWEEN 0 AND 99"


@query("fn13_neighbours", _AROUND.replace("{cell}", cell_sql()))
def fn13(v):
    cells = v.towers.select(GRID.cell("lon", "lat").alias("cell")).distinct()
    return cells.select("cell", F.explode(GRID.neighbours("cell")).alias("near"))


@query("fn14_date_key", "SELECT event_id, CAST(year(ts) AS VARCHAR) || '-' || CAST(month(ts) AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) AS day FROM gps")
def fn14(v):
    return v.gps.select("event_id", codecs.date_key("ts").alias("day"))


@query("fn15_durations", "SELECT car_id, MAX(sec) - MIN(sec) AS seconds, (MAX(sec) - MIN(sec)) * 1000 AS millis FROM gps GROUP BY car_id")
def fn15(v):
    span = F.max("sec") - F.min("sec")
    return v.gps.groupBy("car_id").agg(span.alias("seconds"), (span * 1000).alias("millis"))


@query("fn16_lists", """SELECT "user", string_agg(CAST(bid AS VARCHAR) || ';', '' ORDER BY bid) AS bids, COUNT(*) AS n, MIN(CAST(bid AS VARCHAR)) AS least FROM live GROUP BY "user\"""")
def fn16(v):
    rows = v.live.groupBy("user").agg(F.collect_list("bid").alias("b"))
    text = codecs.list_text("b")
    return rows.select("user", text.alias("bids"), F.size(codecs.text_list(text)).cast("long").alias("n"), F.array_min(codecs.text_list(text)).alias("least"))


@query("fn17_bytes", "SELECT id, upper(lpad(to_hex(id), 16, '0')) AS big, upper(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS little, id AS again, rpad(CAST(id AS VARCHAR), 16, ' ') AS padded FROM (SELECT id, lpad(to_hex(id), 16, '0') AS h FROM boxes) t")
def fn17(v):
    big = codecs.hex_key("id", 16)
    return v.boxes.select("id", big.alias("big"), codecs.reverse_bytes(big).alias("little"), codecs.from_hex(big).alias("again"), codecs.pad_bytes(F.col("id").cast("string")).alias("padded"))


@query("fn18_number_text", "SELECT id, '[a#' || CAST(id AS VARCHAR) || ',b#' || lower(to_hex(id)) || ']' AS text, CAST(id AS VARCHAR) AS a, id AS b FROM boxes")
def fn18(v):
    m = F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("b"), F.lower(F.hex("id")))
    text = codecs.map_text(m)
    back = codecs.text_map(text)
    return v.boxes.select("id", text.alias("text"), back["a"].alias("a"), codecs.from_hex(back["b"]).alias("b"))


@query("fn19_shape_text", "SELECT id, CAST(CAST(x1 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y1 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(x2 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y2 AS BIGINT) AS VARCHAR) AS text, x2 - x1 AS width FROM boxes")
def fn19(v):
    text = geom.to_csv(*(F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")))
    s = geom.from_csv(text, "rect")
    return v.boxes.select("id", text.alias("text"), (s["x2"] - s["x1"]).alias("width"))


@query("fn20_shape_conversions", "SELECT id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (z1 + z2) / 2 AS z FROM boxes")
def fn20(v):
    x, y, z = geom.box_centre(geom.box())
    return v.boxes.select("id", x.alias("x"), y.alias("y"), z.alias("z"))
