"""Partitioners, density grids, samples, stores and their index."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.geom import BOX, rect
from trackloom.operators import globalindex, sampling
from trackloom.operators.joins import locate
from trackloom.operators.partition import BoxGrid, Grid, KdTree, QuadTree, ZCurve, assign_points, build_index, overlapping, pack, partition_count
from trackloom.operators.partition.rtree import nodes
from trackloom.operators.scratch import place
from trackloom.plans.joins import _GRID4, _MEET, AREA, SPACE, SPACES, grid_cells_sql
from trackloom.plans.registry import query
from trackloom.plans.scalars import GPS_Z
from trackloom.sources import sinks

_G = Grid.build(None, AREA, 500)
_CX, _CY = f"CAST({_G.step[0]!r} AS DOUBLE)", f"CAST({_G.step[1]!r} AS DOUBLE)"


@query("ix_ix1_grid_size", """WITH RECURSIVE g(c, r) AS (SELECT 1, 1 UNION ALL SELECT CASE WHEN 1.45E0 / c > 1.0E0 / r THEN c + 1 ELSE c END, CASE WHEN 1.45E0 / c > 1.0E0 / r THEN r ELSE r + 1 END FROM g WHERE c * r < 500)
SELECT c AS columns, r AS rows FROM g WHERE c * r >= 500""")
def ix1(v):
    return v.spark.range(1).select(F.lit(_G.columns).alias("columns"), F.lit(_G.rows).alias("rows"))


@query("ix_ix2_cell_bounds", f"SELECT CAST(cell_id AS BIGINT) AS cell_id, round(x1, 9) AS x1, round(y1, 9) AS y1, round(x2, 9) AS x2, round(y2, 9) AS y2 FROM {grid_cells_sql(_G)}")
def ix2(v):
    ids = v.spark.range(1, _G.columns * _G.rows + 1).withColumnRenamed("id", "cell_id")
    return ids.select("cell_id", *(F.round(c, 9).alias(n) for c, n in zip(_G.bounds("cell_id"), ("x1", "y1", "x2", "y2"), strict=True)))


@query("ix_ix4_grid_assign", f"SELECT event_id, CAST(least(floor((lat - 39.5E0) / {_CY}), {_G.rows - 1}) * {_G.columns} + least(floor((lng - 115.75E0) / {_CX}), {_G.columns - 1}) + 1 AS BIGINT) AS cell_id FROM gps")
def ix4(v):
    return assign_points(v.gps, _G, "lng", "lat").select("event_id", "cell_id")


_FLAT = Grid.build(None, (0.0, 0.0, 1050.0, 1000.0), 20)


@query("ix_ix3_grid_overlaps", f"SELECT b.id, CAST(c.cell_id AS BIGINT) AS cell_id FROM boxes b JOIN {grid_cells_sql(_FLAT)} ON b.x2 > c.x1 AND b.x1 < c.x2 AND b.y2 > c.y1 AND b.y1 < c.y2")
def ix3(v):
    return v.boxes.select("id", F.explode(_FLAT.overlaps(rect())).alias("cell_id"))


@query("ix_ix5_box_grid", f"SELECT b.id, CAST(s.space_id AS BIGINT) AS space_id FROM boxes b JOIN ({SPACES}) s ON b.x1 >= s.x1 AND b.x1 < s.x2 AND b.y1 >= s.y1 AND b.y1 < s.y2 AND b.z1 >= s.z1 AND b.z1 < s.z2")
def ix5(v):
    return v.boxes.select("id", _GRID4.assign("x1", "y1", "z1").alias("space_id"))


@query("ix_ix5_spaces", f"SELECT CAST(space_id AS BIGINT) AS space_id, round(x1, 6) AS x1, round(y2, 6) AS y2, round(z2, 6) AS z2 FROM ({SPACES}) t")
def ix5_spaces(v):
    return BoxGrid.build(SPACE, 24).frame(v.spark).select("space_id", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), F.round("z2", 6).alias("z2"))


_KD = """WITH a AS (SELECT lng, lat, row_number() OVER (ORDER BY lng) - 1 AS r, COUNT(*) OVER () AS n FROM gps),
s1 AS (SELECT MIN(lng) AS s FROM a WHERE r = n // 2),
lo AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS r, COUNT(*) OVER () AS n FROM a WHERE a.r < a.n // 2),
hi AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS r, COUNT(*) OVER () AS n FROM a WHERE a.r >= a.n // 2),
s2 AS (SELECT MIN(lat) AS s FROM lo WHERE r = n // 2), s3 AS (SELECT MIN(lat) AS s FROM hi WHERE r = n // 2)"""


@query("ix_ix6_kd_splits", f"{_KD} SELECT 1 AS node, s AS split FROM s1 UNION ALL SELECT 2, s FROM s2 UNION ALL SELECT 3, s FROM s3")
def ix6(v):
    tree = KdTree.build(v.gps, AREA, 4, "lng", "lat")
    return v.spark.createDataFrame(sorted(tree.splits.items()), "node int, split double")


@query("ix_ix8_kd_assign", f"{_KD} SELECT event_id, CAST(CASE WHEN lng < s1.s THEN CASE WHEN lat < s2.s THEN 4 ELSE 5 END ELSE CASE WHEN lat < s3.s THEN 6 ELSE 7 END END AS BIGINT) AS cell_id FROM gps, s1, s2, s3")
def ix8(v):
    tree = build_index("kd", v.gps, AREA, 4, "lng", "lat")
    return assign_points(v.gps, tree, "lng", "lat").select("event_id", "cell_id")


@query("ix_ix7_kd_bounds", f"{_KD} SELECT CAST(4 AS BIGINT) AS cell_id, 115.75E0 AS x1, 39.5E0 AS y1, s1.s AS x2, s2.s AS y2 FROM s1, s2 UNION ALL SELECT 5, 115.75E0, s2.s, s1.s, 40.5E0 FROM s1, s2 UNION ALL SELECT 6, s1.s, 39.5E0, 117.2E0, s3.s FROM s1, s3 UNION ALL SELECT 7, s1.s, s3.s, 117.2E0, 40.5E0 FROM s1, s3")
def ix7(v):
    return build_index("kd", v.gps, AREA, 4, "lng", "lat").frame(v.spark)


@query("ix_ix8_kd_overlaps", f"{_KD}, c AS (SELECT CAST(4 AS BIGINT) AS cell_id, 115.75E0 AS x1, 39.5E0 AS y1, s1.s AS x2, s2.s AS y2 FROM s1, s2 UNION ALL SELECT 5, 115.75E0, s2.s, s1.s, 40.5E0 FROM s1, s2 UNION ALL SELECT 6, s1.s, 39.5E0, 117.2E0, s3.s FROM s1, s3 UNION ALL SELECT 7, s1.s, s3.s, 117.2E0, 40.5E0 FROM s1, s3) SELECT g.event_id, c.cell_id FROM gps g JOIN c ON g.lng + 0.2E0 > c.x1 AND g.lng < c.x2 AND g.lat + 0.2E0 > c.y1 AND g.lat < c.y2 WHERE g.event_id < 1000")
def ix8_overlaps(v):
    tree = build_index("kd", v.gps, AREA, 4, "lng", "lat")
    shapes = v.gps.where("event_id < 1000").selectExpr("event_id", "lng as x1", "lat as y1", "lng + 0.2E0 as x2", "lat + 0.2E0 as y2")
    return overlapping(shapes, tree.frame(v.spark)).select("event_id", "cell_id")


def quad_sql(n: int, depth: int) -> str:
    """Leaves of the quad-tree: nodes with at most the capacity whose parents have more."""
    parts = [f"SELECT 0 AS level, CAST(1 AS BIGINT) AS node, COUNT(*) AS n FROM ({GPS_Z}) z0"]
    for level in range(1, depth + 1):
        parts.append(f"SELECT {level}, CAST(1 AS BIGINT) * {4**level} + (z >> {62 - 2 * level}), COUNT(*) FROM ({GPS_Z}) z{level} GROUP BY 1, 2")
    capacity = f"(SELECT greatest(1, COUNT(*) // {n}) FROM gps)"
    return f"SELECT t.node AS leaf, t.n FROM ({' UNION ALL '.join(parts)}) t JOIN ({' UNION ALL '.join(parts)}) p ON p.node = t.node // 4 AND p.level = t.level - 1 WHERE t.n <= {capacity} AND p.n > {capacity}"


@query("ix_ix9_quad_leaves", quad_sql(20, 7))
def ix9(v):
    tree = QuadTree.build(v.gps, AREA, 20, "lng", "lat")
    return v.spark.createDataFrame([(k, c) for k, c in sorted(tree.counts.items()) if c], "leaf long, n long")


@query("ix_ix11_quad_counts", quad_sql(20, 7))
def ix11(v):
    """Every point's leaf by binary search among the leaves' code ranges."""
    tree = QuadTree.build(v.gps, AREA, 20, "lng", "lat")
    return assign_points(v.gps, tree, "lng", "lat", "leaf").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


@query("ix_ix10_quad_bounds", f"SELECT t.leaf, t.n, 115.75E0 + (z.ix >> (31 - t.level)) * (CAST(1.4500000000000028 AS DOUBLE) / (1 << t.level)) AS x1 FROM (SELECT *, CAST(floor((log2(leaf) + 0.000001) / 2) AS INT) AS level FROM ({quad_sql(20, 7)}) q) t JOIN (SELECT q.leaf, MIN(CAST(floor((lng - 115.75E0) * 2147483647E0 / CAST(1.4500000000000028 AS DOUBLE)) AS BIGINT)) AS ix FROM (SELECT *, CAST(floor((log2(leaf) + 0.000001) / 2) AS INT) AS level FROM ({quad_sql(20, 7)}) q0) q JOIN (SELECT g.event_id, g.lng, m.z FROM gps g JOIN ({GPS_Z}) m ON g.event_id = m.event_id) p ON CAST(1 AS BIGINT) * CAST(pow(4, q.level) AS BIGINT) + (p.z >> (62 - 2 * q.level)) = q.leaf GROUP BY 1) z ON z.leaf = t.leaf".replace("115.75E0 + (z.ix >> (31 - t.level)) * (CAST(1.4500000000000028 AS DOUBLE) / (1 << t.level)) AS x1", "round(115.75E0 + (z.ix >> (31 - t.level)) * (CAST(1.4500000000000028 AS DOUBLE) / (1 << t.level)), 6) AS x1"))
def ix10(v):
    tree = QuadTree.build(v.gps, AREA, 20, "lng", "lat")
    counts = v.spark.createDataFrame([(k, c) for k, c in sorted(tree.counts.items()) if c], "leaf long, n long")
    return counts.join(tree.frame(v.spark).withColumnRenamed("cell_id", "leaf"), "leaf").select("leaf", "n", F.round("x1", 6).alias("x1"))


_TOP = (1 << 62) - 1
_ZSPLITS = f"SELECT i, MIN(z) AS split FROM (SELECT z, row_number() OVER (ORDER BY z) - 1 AS r, COUNT(*) OVER () AS n FROM ({GPS_Z}) zz) t JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) k(i) ON t.r = ((k.i + 1) * t.n) // 8 GROUP BY i UNION ALL SELECT 7, {_TOP}"


@query("ix_ix12_z_splits", f"SELECT CAST(i AS INT) AS i, CAST(split AS BIGINT) AS split FROM ({_ZSPLITS}) s")
def ix12(v):
    curve = ZCurve.build(v.gps, AREA, 8, "lng", "lat")
    return v.spark.createDataFrame(list(enumerate(curve.splits)), "i int, split long")


@query("ix_ix13_z_assign", f"SELECT event_id, CAST((SELECT COUNT(*) FROM ({_ZSPLITS}) s WHERE s.split < p.z) AS BIGINT) AS cell_id FROM ({GPS_Z}) p")
def ix13(v):
    return assign_points(v.gps, build_index("zcurve", v.gps, AREA, 8, "lng", "lat"), "lng", "lat").select("event_id", "cell_id")


@query("ix_ix14_z_bounds_cover", "SELECT COUNT(*) AS points, COUNT(*) AS covered FROM gps")
def ix14(v):
    """Every point lies in the quadrant of its cell's code range."""
    curve = ZCurve.build(v.gps, AREA, 8, "lng", "lat")
    rows = assign_points(v.gps, curve, "lng", "lat").join(F.broadcast(curve.frame(v.spark)), "cell_id")
    slack = 1e-6
    inside = (F.col("lng") >= F.col("x1") - slack) & (F.col("lng") <= F.col("x2") + slack) & (F.col("lat") >= F.col("y1") - slack) & (F.col("lat") <= F.col("y2") + slack)
    return rows.agg(F.count(F.lit(1)).alias("points"), F.count_if(inside).alias("covered"))


_C0, _C1 = "(x1 + x2) / 2", "(y1 + y2) / 2"
_PACK = f"""SELECT *, s0 * 5 + ((row_number() OVER (PARTITION BY s0 ORDER BY {_C1}, id)) * 5 - 1) // COUNT(*) OVER (PARTITION BY s0) AS leaf
FROM (SELECT *, (row_number() OVER (ORDER BY {_C0}, id) * 5 - 1) // COUNT(*) OVER () AS s0 FROM boxes) t"""


@query("ix_ix15_rtree_leaves", f"SELECT id, CAST(leaf AS BIGINT) AS leaf FROM ({_PACK}) p")
def ix15(v):
    return pack(v.boxes, 5, "id", levels=2).select("id", "leaf")


@query("ix_ix15_rtree_nodes", f"SELECT l AS level, CAST(leaf // w AS BIGINT) AS node, COUNT(*) AS n, MIN(x1) AS x1, MIN(y1) AS y1, MIN(z1) AS z1, MAX(x2) AS x2, MAX(y2) AS y2, MAX(z2) AS z2 FROM ({_PACK}) p, (VALUES (0, 25), (1, 5), (2, 1)) k(l, w) GROUP BY 1, 2")
def ix15_nodes(v):
    return nodes(pack(v.boxes, 5, "id", levels=2), 5, 2)


_MASTER = f"SELECT s.space_id, MIN(b.x1) AS x1, MIN(b.y1) AS y1, MIN(b.z1) AS z1, MAX(b.x2) AS x2, MAX(b.y2) AS y2, MAX(b.z2) AS z2, COUNT(*) AS record_count FROM boxes b JOIN ({SPACES}) s ON b.x1 >= s.x1 AND b.x1 < s.x2 AND b.y1 >= s.y1 AND b.y1 < s.y2 AND b.z1 >= s.z1 AND b.z1 < s.z2 GROUP BY 1"


def _placed(v):
    return v.boxes.withColumn("cell_id", _GRID4.assign("x1", "y1", "z1"))


@query("agg_ag23_master", f"SELECT CAST(space_id AS BIGINT) AS space_id, x1, y1, z1, x2, y2, z2, record_count FROM ({_MASTER}) m")
def ag23(v):
    return globalindex.master_of(_placed(v)).drop("size")


@query("ix_ix19_range_query", f"SELECT CAST(space_id AS BIGINT) AS space_id, record_count FROM ({_MASTER}) m WHERE x2 > 100 AND x1 < 300 AND y2 > 100 AND y1 < 400 AND z2 > 10 AND z1 < 60")
def ix19(v):
    return globalindex.range_query(globalindex.master_of(_placed(v)), 100, 100, 10, 300, 400, 60).select("space_id", "record_count")


@query("ix_ix19_index_bounds", "SELECT MIN(x1) AS x1, MIN(y1) AS y1, MIN(z1) AS z1, MAX(x2) AS x2, MAX(y2) AS y2, MAX(z2) AS z2, COUNT(*) AS record_count FROM boxes")
def ix19_bounds(v):
    return globalindex.bounds(globalindex.master_of(_placed(v))).select(*BOX, "record_count")


def _store(v, name: str) -> str:
    return place(v.spark, name)


@query("ix_ix20_indexer", f"SELECT CAST(space_id AS BIGINT) AS space_id, record_count FROM ({_MASTER}) m")
def ix20(v):
    """Boxes dealt to spaces, written as a partitioned store with its master table."""
    master = sinks.write_store(_placed(v), _store(v, "index"))
    return master.select(F.col("space_id").cast("long").alias("space_id"), "record_count")


@query("ix_ix20_indexer_replicated", f"SELECT CAST(s.space_id AS BIGINT) AS space_id, COUNT(*) AS record_count, MIN(greatest(b.x1, s.x1)) AS x1, MAX(least(b.z2, s.z2)) AS z2 FROM boxes b JOIN ({SPACES}) s ON {_MEET} GROUP BY 1")
def ix20_replicated(v):
    spaces = _GRID4.frame(v.spark)
    from trackloom.operators.joins import replicate

    master = sinks.write_store(replicate(v.boxes, spaces).withColumnRenamed("space_id", "cell_id"), _store(v, "replicated"), cells=spaces)
    return master.select(F.col("space_id").cast("long").alias("space_id"), "record_count", "x1", "z2")


_HIT = "x2 > 100 AND x1 < 300 AND y2 > 100 AND y1 < 400 AND z2 > 10 AND z1 < 60"


@query("src_src11_pruned_store_query", f"SELECT id FROM boxes WHERE {_HIT}")
def src11(v):
    """A range query on a store that reads only the folders that the master table names."""
    path = _store(v, "store")
    master = sinks.write_store(_placed(v), path)
    area = (100.0, 100.0, 10.0, 300.0, 400.0, 60.0)
    rows = globalindex.prune(v.spark.read.parquet(f"{path}/data"), master, area)
    return rows.where(_HIT).select("id")


_BOX_TEXT = "CAST(id AS VARCHAR) || ',' || " + " || ',' || ".join(f"CAST(CAST({c} AS BIGINT) AS VARCHAR)" for c in BOX)


@query("src_src24_store_size", f"SELECT CAST(SUM(length({_BOX_TEXT})) AS BIGINT) AS size FROM boxes")
def src24(v):
    """Bytes of the boxes as text, from the master table alone."""
    from trackloom.sources.readers import path_size

    text = F.concat_ws(",", F.col("id").cast("string"), *(F.col(c).cast("long").cast("string") for c in BOX))
    return path_size(globalindex.master_of(_placed(v), size=F.octet_length(text)))


@query("ix_ix22_partition_count", f"SELECT CAST(greatest(1, ceil(floor(SUM(length({_BOX_TEXT})) * 1.1E0) / 4096)) AS INT) AS parts, CAST(greatest(1, ceil(floor(COUNT(*) * 1.1E0) / 134217728)) AS INT) AS least FROM boxes")
def ix22(v):
    """Partitions of 4 KB each for the boxes as text, and of a block for as many bytes as there are boxes."""
    size, n = src24(v).first()["size"], v.boxes.count()
    return v.spark.range(1).select(F.lit(partition_count(size, 4096)).alias("parts"), F.lit(partition_count(n, 1 << 27)).alias("least"))


_D = "SELECT CAST(least(floor((lng - 115.75E0) / CAST(0.07250000000000014 AS DOUBLE)), 19) AS INT) AS col, CAST(least(floor((lat - 39.5E0) / 0.05E0), 19) AS INT) AS row, COUNT(*) AS n FROM gps GROUP BY 1, 2"


def _density(v):
    return sampling.density(v.gps, AREA, 20, 20, "lng", "lat")


@query("smp_smp5_density", f"SELECT col, row, n, round(115.75E0 + (col + 0.5E0) * CAST(0.07250000000000014 AS DOUBLE), 6) AS cx FROM ({_D}) d")
def smp5(v):
    return _density(v).select("col", "row", "n", F.round("cx", 6).alias("cx"))


@query("smp_smp5_densest", f"SELECT col, row, n FROM ({_D}) d ORDER BY n DESC, col, row LIMIT 40")
def smp5_top(v):
    return sampling.densest(_density(v), 0.1).select("col", "row", "n")


@query("smp_smp6_percentiles", f"SELECT p AS percent, n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, COUNT(*) OVER () AS total FROM ({_D}) d) t JOIN (VALUES (10), (50), (90), (99)) k(p) ON t.r = least(total - 1, (total * p) // 100)")
def smp6(v):
    return sampling.count_percentiles(_density(v), [10, 50, 90, 99])


@query("smp_smp7_proportional_counts", f"SELECT col, row, (n + 5) // 10 AS points FROM ({_D}) d WHERE (n + 5) // 10 > 0")
def smp7(v):
    made = sampling.proportional_points(_density(v), Grid(AREA, 20, 20), 10)
    return made.groupBy("col", "row").agg(F.count(F.lit(1)).alias("points"))


@query("smp_smp8_cell_bounds", f"SELECT col, row, round(115.75E0 + col * CAST(0.07250000000000014 AS DOUBLE), 6) AS x1, round(39.5E0 + (row + 1) * 0.05E0, 6) AS y2 FROM ({_D}) d")
def smp8(v):
    dx, dy = (AREA[2] - AREA[0]) / 20, (AREA[3] - AREA[1]) / 20
    return _density(v).select("col", "row", F.round(F.col("cx") - dx / 2, 6).alias("x1"), F.round(F.col("cy") + dy / 2, 6).alias("y2"))


@query("smp_smp1_bernoulli")
def smp1(v):
    return sampling.bernoulli(v.gps, 0.1).select("event_id")


@query("smp_smp3_exact", "SELECT CAST(least(500, COUNT(*)) AS INT) AS n, CAST(least(500, COUNT(*)) AS INT) AS known FROM gps")
def smp3(v):
    """500 points, no two alike and each one of the table's."""
    picked = sampling.exact(v.gps, 500).select("event_id").distinct()
    known = picked.join(v.gps.select("event_id"), "event_id", "left_semi").agg(F.count(F.lit(1)).cast("int").alias("known"))
    return picked.agg(F.count(F.lit(1)).cast("int").alias("n")).join(known)


@query("smp_smp4_by_bytes", "SELECT COUNT(*) AS n, CAST(SUM(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def smp4(v):
    """A budget of all bytes takes every text; half of it takes half the bytes, less than the longest text missing, or the query fails."""
    size = F.octet_length("text") + 1
    texts = v.documents.where("text is not null")
    whole = texts.agg(F.sum(size).alias("bytes"), F.max(size).alias("longest")).first()
    half = sampling.by_bytes(texts, "text", whole["bytes"] // 2, "doc_id").agg(F.sum(size)).first()[0]
    if not whole["bytes"] // 2 - whole["longest"] < half <= whole["bytes"] // 2:
        raise AssertionError(f"{half} of {whole['bytes']} bytes")
    picked = sampling.by_bytes(texts, "text", whole["bytes"], "doc_id")
    return picked.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


@query("snk_snk10_cells_text", "SELECT printf('%.6f %.6f %.6f %.6f 0', x1, y1, x2, y2) AS value FROM " + grid_cells_sql(Grid.build(None, AREA, 12)))
def snk10(v):
    return sinks.cells_text(Grid.build(None, AREA, 12).frame(v.spark))


@query("snk_snk11_index_text", "SELECT CAST(cell_id AS VARCHAR) || chr(9) || printf('%.6f %.6f', x1, y1) || chr(9) || printf('%.6f %.6f', x2, y2) AS value FROM " + grid_cells_sql(Grid.build(None, AREA, 12)))
def snk11(v):
    return sinks.index_lines(Grid.build(None, AREA, 12).frame(v.spark))


@query("snk_snk12_points_text", "SELECT CAST(id AS VARCHAR) || ' ' || CAST(CAST(x1 AS BIGINT) AS VARCHAR) || ' ' AS value FROM boxes")
def snk12(v):
    return sinks.point_lines(v.boxes.select("id", F.col("x1").cast("long").alias("x1")), "id", "x1")


@query("src_src7_index_round_trip", f"SELECT CAST(cell_id AS INT) AS cell_id, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM {grid_cells_sql(Grid.build(None, AREA, 12))}")
def src7(v):
    from trackloom.sources.readers import index_text

    return index_text(sinks.index_lines(Grid.build(None, AREA, 12).frame(v.spark))).select("cell_id", "x1", "y2")


@query("src_src18_random_points", "SELECT CAST(5000 AS BIGINT) AS n, TRUE AS inside")
def src18(v):
    from trackloom.sources.readers import random_points

    made = random_points(v.spark, 5000, SPACE, "gaussian")
    ok = F.col("x").between(SPACE[0], SPACE[3]) & F.col("y").between(SPACE[1], SPACE[4]) & F.col("z").between(SPACE[2], SPACE[5])
    return made.agg(F.count(F.lit(1)).alias("n"), F.min(ok).alias("inside"))


@query("ix_ix24_random_index", "SELECT CAST(3000 AS BIGINT) AS n")
def ix24(v):
    """Random boxes, dealt by their low corners to the spaces of a grid, written and counted from the master table."""
    from trackloom.sources.readers import random_boxes

    rows = random_boxes(v.spark, 3000, SPACE, 20).withColumn("cell_id", _GRID4.assign("x1", "y1", "z1"))
    return sinks.write_store(rows, _store(v, "random")).agg(F.sum("record_count").alias("n"))


@query("ix_ix8_kd_by_cells", f"SELECT event_id, CAST(coalesce(cell_id, -1) AS BIGINT) AS cell_id FROM gps LEFT JOIN {grid_cells_sql(Grid.build(None, AREA, 12))} ON lng >= c.x1 AND lng < c.x2 AND lat >= c.y1 AND lat < c.y2")
def ix8_cells(v):
    return locate(v.gps, Grid.build(None, AREA, 12).frame(v.spark)).select("event_id", "cell_id")
