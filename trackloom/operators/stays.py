"""Stay points, clusters and districts from cell-tower logs, as window functions and joins.

calls(user, sec, bid) and towers(bid, lon, lat, region). A record touches its
cell and the cells around it; a stay is a run of touches of a cell. The
end of a cell's last stay is its previous touch, so `lag` and a running sum give
the stays without walking through a user's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.grid import MiningGrid
from trackloom.operators.scratch import cut

HOUR = 3600
#: Hours of the rules for day and night (fixed values).
NIGHT = {"smear": 8, "least": 3}
DAY = {"smear": 3, "least": 2}
HORIZON, JUMP, GATE, KEEP = 12, 2, 6, 6
#: Districts of the analysed city by number (fixed values), given as a parameter where names are wanted.
OVERRIDES = {9244: 4}
#: Towers up to which a report holds all of them in each task, and users whose report is made in one row.
FEW_TOWERS, MOST_USERS = 2_000_000, 1000


def hour_of(sec) -> Column:
    return F.floor(F.pmod(F.col(sec), F.lit(86400)) / HOUR).cast("int")


def weekday_of(sec) -> Column:
    """1 Sunday to 7 Saturday."""
    return (F.pmod(F.floor(F.col(sec) / 86400) + 4, F.lit(7)) + 1).cast("int")


def night_calls(calls: DataFrame) -> DataFrame:
    h = hour_of("sec")
    return calls.where((h < 9) | (h > 21))


def day_calls(calls: DataFrame, first_day: int = 3) -> DataFrame:
    """Hours 6 to 17 of weekdays numbered first_day and up; 3 leaves out Sunday and Monday and keeps Saturday."""
    return calls.where(hour_of("sec").between(6, 17) & (weekday_of("sec") >= first_day))


def legacy_night(calls: DataFrame) -> DataFrame:
    return calls.where(~hour_of("sec").between(9, 19))


def legacy_day(calls: DataFrame) -> DataFrame:
    return calls.where(weekday_of("sec").between(2, 6) & hour_of("sec").between(9, 16))


def on_grid(calls: DataFrame, towers: DataFrame, grid: MiningGrid) -> DataFrame:
    """calls with their tower's cell; unknown towers and towers outside the grid drop out."""
    cells = towers.select("bid", "region", grid.cell("lon", "lat").alias("cell")).where("cell is not null")
    return calls.join(cells, "bid")


def _previous(records: DataFrame) -> DataFrame:
    order = Window.partitionBy("user").orderBy("sec", "bid", *(["seq"] if "seq" in records.columns else []))
    return records.withColumns({"seq_no": F.row_number().over(order), "prev": F.lag("cell").over(order), "prev_sec": F.lag("sec").over(order)})


def touches(records: DataFrame, grid: MiningGrid, smear: float, horizon: float = HORIZON, jump: float = JUMP) -> DataFrame:
    """(user, seq_no, sec, cell, gap): cells that each record touches; gap null extends at any distance in time.

    The first record and one that is far from the last in space or time touch
    their surroundings with the jump gap; one in the same cell extends them; one
    in a neighbouring cell extends the old surroundings and touches the new
    with the smear gap.
    """
    rows = _previous(records)
    here, there = grid.around("cell"), grid.around("prev")
    soon = (F.col("sec") - F.col("prev_sec")) < horizon * HOUR
    same = (F.col("cell") == F.col("prev")) & soon
    beside = F.array_contains(there, F.col("cell")) & (F.col("cell") != F.col("prev")) & soon
    tag = lambda cells, gap: F.transform(cells, lambda c: F.struct(c.alias("cell"), F.lit(gap).cast("long").alias("gap")))
    smeared, jumped = int(smear * HOUR), int(jump * HOUR)
    touched = (
        F.when(F.col("prev").isNull(), tag(here, jumped))
        .when(same, tag(here, None))
        .when(beside, F.concat(tag(there, None), tag(F.array_except(here, there), smeared)))
        .otherwise(tag(here, jumped))
    )
    out = rows.select("user", "seq_no", "sec", F.explode(touched).alias("t"))
    return out.select("user", "seq_no", "sec", "t.cell", "t.gap")


def stays_of(touched: DataFrame) -> DataFrame:
    """(user, cell, begin, end) from touches: a new stay begins where the gap is reached."""
    w = Window.partitionBy("user", "cell").orderBy("seq_no")
    last = F.lag("sec").over(w)
    new = last.isNull() | (F.col("gap").isNotNull() & ((F.col("sec") - last) >= F.col("gap")))
    rows = touched.withColumn("new", new.cast("int")).withColumn("stay", F.sum("new").over(w))
    return rows.groupBy("user", "cell", "stay").agg(F.min("sec").alias("begin"), F.max("sec").alias("end")).drop("stay")


def frequent(stays: DataFrame, least: float, gate: int = GATE, keep: int = KEEP) -> DataFrame:
    """(user, cell, stays, dwell): cells with at least `gate` stays of which more than `keep` last `least` hours."""
    long = F.col("end") - F.col("begin") >= int(least * HOUR)
    cells = stays.groupBy("user", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("stays"), F.sum(F.when(long, F.col("end") - F.col("begin")).otherwise(0)).alias("dwell"))
    return cells.where((F.col("n") >= gate) & (F.col("stays") > keep)).drop("n")


def legacy_stays(records: DataFrame, grid: MiningGrid, horizon: float, longer_than: float) -> DataFrame:
    """(user, cell, begin, end): runs of one cell, a step to a neighbour extending and closing a run; smeared to all neighbours."""
    rows = _previous(records)
    w = Window.partitionBy("user").orderBy("seq_no")
    soon = (F.col("sec") - F.col("prev_sec")) < int(horizon * HOUR)
    same = (F.col("cell") == F.col("prev")) & soon
    beside = F.array_contains(grid.around("prev"), F.col("cell")) & (F.col("cell") != F.col("prev")) & soon
    rows = rows.withColumns({"new": F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1), "hop": F.coalesce(beside, F.lit(False))})
    rows = rows.withColumn("run", F.sum("new").over(w)).withColumn("hop_sec", F.when(F.lead("hop").over(w), F.lead("sec").over(w)))
    runs = rows.groupBy("user", "run", "cell").agg(F.min("sec").alias("begin"), F.greatest(F.max("sec"), F.max("hop_sec")).alias("end"))
    runs = runs.where(F.col("end") - F.col("begin") > int(longer_than * HOUR))
    return runs.select("user", F.explode(grid.around("cell")).alias("cell"), "begin", "end")


def region_stays(records: DataFrame, gap: float, stay: float) -> DataFrame:
    """(user, region, begin, end): records of one region at most gap hours apart, lasting at least stay hours."""
    order = Window.partitionBy("user").orderBy("sec", "region")
    new = F.coalesce((F.lag("region").over(order) != F.col("region")) | (F.col("sec") - F.lag("sec").over(order) > int(gap * HOUR)), F.lit(True))
    rows = records.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy("user", "run", "region").agg(F.min("sec").alias("begin"), F.max("sec").alias("end"))
    return runs.where(F.col("end") - F.col("begin") >= int(stay * HOUR)).drop("run")


def visited_days(stays: DataFrame) -> DataFrame:
    """(user, day, region): the days, since 1970, on which a stay begins and ends."""
    day = lambda c: F.floor(F.col(c) / 86400).cast("long")
    return stays.select("user", "region", F.explode(F.array_distinct(F.array(day("begin"), day("end")))).alias("day")).distinct().select("user", "day", "region")


def merge_stays(stays: DataFrame, gap: float, least: float, number: int) -> DataFrame:
    """(user, cell, begin, end): stays of a cell less than gap hours apart joined, short ones dropped, cells with fewer than `number` dropped."""
    w = Window.partitionBy("user", "cell").orderBy("begin", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = stays.withColumn("new", F.coalesce(F.col("begin") - upto >= int(gap * HOUR), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("user", "cell", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")
    runs = runs.where(F.col("end") - F.col("begin") >= int(least * HOUR))
    return runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user", "cell"))).where(F.col("_n") >= number).drop("_n")


# clusters of a user's cells


def _edges(cells: DataFrame, grid: MiningGrid) -> DataFrame:
    """(user, a, b): cells of a user that share an edge, both ways."""
    c, r = F.pmod(F.col("cell"), F.lit(grid.columns)), F.floor(F.col("cell") / grid.columns)
    beside = F.array(F.when(c > 0, F.col("cell") - 1), F.when(c < grid.columns - 1, F.col("cell") + 1), F.when(r > 0, F.col("cell") - grid.columns), F.when(r < grid.rows - 1, F.col("cell") + grid.columns))
    near = cells.select("user", F.col("cell").alias("a"), F.explode(F.array_compact(beside)).alias("b"))
    return near.join(cells.select("user", F.col("cell").alias("b")), ["user", "b"], "left_semi").select("user", "a", "b")


def clusters(cells: DataFrame, grid: MiningGrid, neighbours: int = 0, max_rounds: int = 200) -> DataFrame:
    """cells(user, cell) with `cluster`, the least cell that density clustering at distance one reaches.

    With neighbours 0 every cell is a core and clusters are the connected groups
    of cells that share edges; else a core has that many neighbours, cells
    beside a core belong to its cluster (the least of several), others to none.
    Labels spread in rounds, each written out, until none changes.
    """
    cells = cut(cells.select("user", "cell").distinct())
    edges = cut(_edges(cells, grid))
    cores = cells
    if neighbours:
        cores = cut(edges.groupBy("user", F.col("a").alias("cell")).count().where(F.col("count") >= neighbours).select("user", "cell"))
    inner = edges.join(cores.withColumnRenamed("cell", "a"), ["user", "a"], "left_semi").join(cores.withColumnRenamed("cell", "b"), ["user", "b"], "left_semi")
    labels = cores.withColumn("cluster", F.col("cell"))
    for _ in range(max_rounds):
        heard = inner.join(labels.select("user", F.col("cell").alias("b"), F.col("cluster").alias("c")), ["user", "b"]).groupBy("user", F.col("a").alias("cell")).agg(F.min("c").alias("c"))
        spread = labels.join(heard, ["user", "cell"], "left").select("user", "cell", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"), (F.col("c") < F.col("cluster")).alias("moved"))
        # a label's own label is at least as small: halves long chains
        jump = spread.select("user", F.col("cell").alias("cluster"), F.col("cluster").alias("up"))
        spread = cut(spread.join(jump, ["user", "cluster"], "left").select("user", "cell", F.coalesce("up", "cluster").alias("cluster"), "moved"))
        labels = spread.drop("moved")
        if not spread.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    if not neighbours:
        return labels
    border = edges.join(labels.select("user", F.col("cell").alias("b"), "cluster"), ["user", "b"]).join(cores.withColumnRenamed("cell", "a"), ["user", "a"], "left_anti")
    return labels.unionByName(border.groupBy("user", F.col("a").alias("cell")).agg(F.min("cluster").alias("cluster")))


def cluster_centres(labels: DataFrame, grid: MiningGrid) -> DataFrame:
    """(user, cluster, cells, centre): the cell at the truncated mean column and row."""
    c, r = F.pmod(F.col("cell"), F.lit(grid.columns)), F.floor(F.col("cell") / grid.columns)
    mean = lambda v: F.floor(F.sum(v) / F.count(F.lit(1)))
    out = labels.groupBy("user", "cluster").agg(F.count(F.lit(1)).alias("cells"), mean(c).alias("c"), mean(r).alias("r"))
    return out.select("user", "cluster", "cells", (F.col("c") + F.col("r") * grid.columns).cast("int").alias("centre"))


def core_cells(labels: DataFrame, grid: MiningGrid) -> DataFrame:
    """Cells all of whose neighbours on the grid are in their cluster; clusters without such keep their mean cell."""
    around = labels.withColumn("n", F.explode(grid.neighbours("cell")))
    has = labels.select("user", "cluster", F.col("cell").alias("n"), F.lit(1).alias("is"))
    full = around.join(has, ["user", "cluster", "n"], "left").groupBy("user", "cluster", "cell").agg(F.count(F.lit(1)).alias("want"), F.count("is").alias("got"))
    full = full.where("want = got").select("user", "cluster", "cell")
    rest = cluster_centres(labels, grid).join(full, ["user", "cluster"], "left_anti").select("user", "cluster", F.col("centre").alias("cell"))
    return full.unionByName(rest)


# districts and centres of cells


def cell_towers(towers: DataFrame, grid: MiningGrid) -> DataFrame:
    return towers.withColumn("cell", grid.cell("lon", "lat")).where("cell is not null")


def cell_regions(towers: DataFrame, grid: MiningGrid, overrides: dict[int, int] | None = None) -> DataFrame:
    """(cell, region) of every cell that has towers in it or around it.

    The most frequent district among a cell's own towers, the least of equals;
    without own towers the same among those of the neighbouring cells.
    """
    placed = cell_towers(towers, grid)
    own = placed.groupBy("cell", "region").agg(F.count(F.lit(1)).alias("n"))
    near = placed.select("region", F.explode(grid.neighbours("cell")).alias("cell")).groupBy("cell", "region").agg(F.count(F.lit(1)).alias("n"))
    near = near.join(own.select("cell").distinct(), "cell", "left_anti")
    best = F.max(F.struct("n", (-F.col("region")).alias("r")))
    out = own.unionByName(near).groupBy("cell").agg((-best["r"]).alias("region"))
    for cell, region in (overrides or {}).items():
        out = out.withColumn("region", F.when(F.col("cell") == cell, region).otherwise(F.col("region")))
    return out


def cell_centres(cells: DataFrame, towers: DataFrame, grid: MiningGrid) -> DataFrame:
    """cells(cell) with lon and lat: the mean of the towers in the cell, else the cell's middle."""
    mean = cell_towers(towers, grid).groupBy("cell").agg(F.avg("lon").alias("tower_lon"), F.avg("lat").alias("tower_lat"))
    lon, lat = grid.centre("cell")
    return cells.join(mean, "cell", "left").withColumns({"lon": F.coalesce("tower_lon", lon), "lat": F.coalesce("tower_lat", lat)}).drop("tower_lon", "tower_lat")


def weighted_centres(cores: DataFrame, towers: DataFrame, grid: MiningGrid) -> DataFrame:
    """(user, cluster, lon, lat): mean of the core cells' centres, weighted by their towers (at least one)."""
    weight = cell_towers(towers, grid).groupBy("cell").agg(F.count(F.lit(1)).alias("w"))
    rows = cell_centres(cores, towers, grid).join(weight, "cell", "left").withColumn("w", F.coalesce("w", F.lit(1)))
    mean = lambda v: F.sum(F.col(v) * F.col("w")) / F.sum("w")
    return rows.groupBy("user", "cluster").agg(mean("lon").alias("lon"), mean("lat").alias("lat"))


def longest_cell(labels: DataFrame, dwell: DataFrame) -> DataFrame:
    """(user, cluster, cell): the cell of the greatest dwell time, the least of equals."""
    best = F.max(F.struct("dwell", (-F.col("cell")).alias("c")))
    return labels.join(dwell.select("user", "cell", "dwell"), ["user", "cell"]).groupBy("user", "cluster").agg((-best["c"]).alias("cell"))


def dwell_time(stays: DataFrame) -> DataFrame:
    return stays.groupBy("user", "cell").agg(F.sum(F.col("end") - F.col("begin")).alias("dwell"))


def user_report(centres: DataFrame, towers: DataFrame, grid: MiningGrid, overrides: dict[int, int] | None = None, shape=lambda bids: bids) -> DataFrame:
    """(user, districts, locations, bids): sorted arrays for a user's cluster centres (user, centre); bids as shape(bids) makes them.

    Users of one area share its bids, which are gathered and shaped once for
    each MOST_USERS of them, in their row: neither the pairs of users and towers
    nor those of areas and towers are dealt out while the towers are few.
    """
    cells = centres.select("user", F.col("centre").alias("cell")).distinct()
    places = cell_centres(cells, towers, grid).join(cell_regions(towers, grid, overrides), "cell", "left")
    area = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("cell"), grid.around))))
    out = places.groupBy("user").agg(
        F.array_sort(F.collect_set(F.coalesce("region", F.lit(-1)))).alias("districts"),
        F.array_sort(F.collect_set(F.struct("lon", "lat"))).alias("locations"),
        area.alias("area"),
    )
    out = out.withColumn("part", F.floor(F.row_number().over(Window.partitionBy("area").orderBy("user")) / MOST_USERS))
    of_area = out.groupBy("area", "part").agg(F.collect_list(F.struct("user", "districts", "locations")).alias("users"))
    # Few bytes before, many after: a number of parts of its own, which adaptive execution does not lower.
    of_area = of_area.repartition(int(towers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "area", "part")
    here = cell_towers(towers, grid).groupBy("cell").agg(F.collect_set("bid").alias("bids"))
    if towers.limit(FEW_TOWERS + 1).count() <= FEW_TOWERS:
        every = here.agg(F.map_from_entries(F.collect_list(F.struct("cell", "bids"))).alias("every"))
        bids = F.flatten(F.filter(F.transform("area", lambda c: F.element_at("every", c)), lambda b: b.isNotNull()))
        found = of_area.crossJoin(F.broadcast(every)).withColumn("bids", bids).drop("every")
    else:
        named = of_area.select("area").distinct().withColumn("cell", F.explode("area")).join(here, "cell")
        named = named.groupBy("area").agg(F.flatten(F.collect_list("bids")).alias("bids"))
        found = of_area.join(named, "area", "left")
    found = found.withColumn("bids", shape(F.when(F.size("bids") > 0, F.sort_array(F.array_distinct("bids")))))
    return found.select(F.explode("users").alias("u"), "bids").select("u.*", "bids")


def live_places(calls: DataFrame, towers: DataFrame, grid: MiningGrid | None = None, rule: dict | None = None, gate: int = GATE, keep: int = KEEP) -> DataFrame:
    """The whole chain for filtered calls: (user, cluster, cells, centre)."""
    grid, rule = grid or MiningGrid(), rule or NIGHT
    stays = stays_of(touches(on_grid(calls, towers, grid), grid, rule["smear"]))
    return cluster_centres(clusters(frequent(stays, rule["least"], gate, keep), grid), grid)


def active_days(calls: DataFrame, recorded: int, threshold: float = 0.3) -> DataFrame:
    """(user, days, tourist): distinct days with calls; tourists have fewer than the threshold's share of the recorded days."""
    out = calls.groupBy("user").agg(F.count_distinct(F.floor(F.col("sec") / 86400)).alias("days"))
    return out.withColumn("tourist", F.col("days") / recorded < threshold)
