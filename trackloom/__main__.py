"""python -m trackloom list | run NAME FOLDER [--out PATH] | index KIND FOLDER CELLS [--out PATH]

CELLS is a number, or a block's size such as 64.m: then as many cells as blocks of the points as text."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trackloom.functions.options import size
from trackloom.operators.partition import KINDS, build_index, partition_count
from trackloom.plans import catalog
from trackloom.plans.views import Views
from trackloom.sources.sinks import index_lines

AREA = (115.75, 39.5, 117.2, 40.5)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trackloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("folder")
    index = commands.add_parser("index", help="build a spatial index of the GPS points")
    index.add_argument("kind", choices=sorted(KINDS))
    index.add_argument("folder")
    index.add_argument("cells")
    for p in (run, index):
        p.add_argument("--out", help="write here instead of showing rows")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("trackloom").getOrCreate()
    if given.command == "run":
        rows = catalog.QUERIES[given.name](spark, given.folder)
        rows.write.parquet(given.out) if given.out else rows.show(100, truncate=False)
        return 0
    points = Views(spark, given.folder).gps
    if given.cells.isdigit():
        cells = int(given.cells)
    else:
        text = points.select(F.octet_length(F.concat_ws(",", *(F.col(c).cast("string") for c in points.columns))).alias("n"))
        cells = partition_count(text.agg(F.sum("n")).first()[0] or 0, size(given.cells))
    lines = index_lines(build_index(given.kind, points, AREA, cells, "lng", "lat").frame(spark))
    lines.write.text(given.out) if given.out else lines.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
