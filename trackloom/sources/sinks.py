"""Writers: partitioned stores with a master table, keyed stores, text and binary exports."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.codecs import row_key, salted_region
from trackloom.functions.geom import BOX
from trackloom.operators.globalindex import clip, expand, master_of
from trackloom.operators.partition import PACKED, REPLICATED

#: Partitions up to which their numbers of parts are broadcast.
FEW_PARTITIONS = 100_000


#: Rows of a file of a store, about.
FILE_ROWS = 1_000_000


def write_store(
    rows: DataFrame,
    path: str,
    by: str = "cell_id",
    sort: tuple[str, ...] = (),
    size: Column | None = None,
    cells: DataFrame | None = None,
    compression: str = "zstd",
    policy: str | None = None,
    file_rows: int = FILE_ROWS,
) -> DataFrame:
    """Write rows(x1..z2, by) as one folder for each partition, and the master table; returns the latter.

    Rows are dealt by partition and a hash of the row, as many parts of a
    partition as its number of rows asks for, so that a large one becomes several
    files rather than one long task; the sort makes row groups skippable within
    a file. Sizes are those of the files, unless `size` gives a row's.

    With cells (space_id, x1..z2) the policy says what bounds the master table has, see bounded().
    """
    # A row for each partition: the number of parts comes from the counts.
    parts = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_parts"))
    parts = F.broadcast(parts) if parts.limit(FEW_PARTITIONS + 1).count() <= FEW_PARTITIONS else parts
    spread = rows.join(parts.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    spread = spread.withColumn("_part", F.pmod(F.xxhash64(*BOX), F.col("_parts"))).drop("_parts")
    dealt = spread.repartition(F.col(by), F.col("_part")).sortWithinPartitions(by, *(sort or BOX[:3])).drop("_part")
    dealt.write.mode("overwrite").option("compression", compression).partitionBy(by).parquet(f"{path}/data")
    stored = rows.sparkSession.read.parquet(f"{path}/data")
    table = master_of(stored, by, size)
    if size is None:
        files = stored.select(F.col(by).alias("space_id"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("bytes"))
        files = files.groupBy("space_id", "f").agg(F.first("bytes").alias("bytes")).groupBy("space_id").agg(F.sum("bytes").alias("size"))
        columns = table.columns
        table = table.drop("size").join(files.withColumnRenamed("space_id", "_of"), F.col("space_id").eqNullSafe(F.col("_of"))).select(*columns)
    table = bounded(table, cells, policy) if cells is not None else table
    table = table.withColumn("filename", F.concat(F.lit(f"{by}="), F.col("space_id").cast("string")))
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/_master")
    return rows.sparkSession.read.parquet(f"{path}/_master")


def bounded(table: DataFrame, cells: DataFrame, policy: str | None) -> DataFrame:
    """A master table, with its contents' bounds, under a policy.

    Packed partitions have the bounds of their content, cut to the cell where
    shapes are replicated. Others have their cell's, and where shapes are in one
    cell only, grown to hold the content. Without a policy the content's are cut.
    """
    if policy in PACKED and policy not in REPLICATED:
        return table
    if policy is None or policy in PACKED:
        return clip(table, cells)
    grown = expand(table, cells)
    return clip(grown, cells) if policy in REPLICATED else grown


def spill(spark: SparkSession, path: str, out: str, limit: int, number: int) -> list[int]:
    """Move the rows of regions with more than `limit` rows from the keyed store to `out`; returns the regions.

    The store is that of jobs.ingest: batch=N/region=R. Rows are written to a
    folder of the spill's number before their folders are deleted, so a spill that
    fails is run again under its number. Regions are as many as cells.
    """
    stored = spark.read.parquet(path)
    full = [r["region"] for r in stored.groupBy("region").count().where(F.col("count") > limit).select("region").orderBy("region").collect()]
    if full:
        stored.where(F.col("region").isin(full)).drop("batch").write.mode("overwrite").partitionBy("region").parquet(f"{out}/spill={number}")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for region in full:
            for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/region={region}")):
                files.delete(found.getPath(), True)
        spark.catalog.refreshByPath(path)
    return full


def keyed(rows: DataFrame, cell: str = "cell_id") -> DataFrame:
    """GPS rows of the keyed store: region, row_key, lo, la, s."""
    region = salted_region(cell, "car_id")
    out = rows.withColumn("region", region)
    return out.select("region", row_key("region", "car_id", "time").alias("row_key"), F.col("lng").cast("float").alias("lo"), F.col("lat").cast("float").alias("la"), F.col("speed").cast("int").alias("s"))


def create_store_table(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (row_key BINARY, lo FLOAT, la FLOAT, s INT, region BIGINT) USING parquet PARTITIONED BY (region) LOCATION '{path}'")


def cells_text(cells: DataFrame, level: int = 0) -> DataFrame:
    """`x1 y1 x2 y2 level` lines with six decimals."""
    return cells.select(F.format_string("%.6f %.6f %.6f %.6f %d", "x1", "y1", "x2", "y2", F.lit(level)).alias("value"))


def index_lines(cells: DataFrame) -> DataFrame:
    """`id TAB x1 y1 TAB x2 y2` lines with six decimals."""
    return cells.select(F.format_string("%d\t%.6f %.6f\t%.6f %.6f", "cell_id", "x1", "y1", "x2", "y2").alias("value"))


def point_lines(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return rows.select(F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"), F.lit("")).alias("value"))


def tsv(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("value"))


def index_bytes(cells: list[tuple]) -> bytes:
    """The binary index of a list of cells, or of spaces: a count, then an int id and its doubles each, big-endian."""
    return struct.pack(">i", len(cells)) + b"".join(struct.pack(f">i{len(c) - 1}d", *c) for c in cells)


def user_outputs(report: DataFrame, path: str) -> None:
    """Districts, locations and towers of users in a folder each."""
    report.select("user", "districts").write.mode("overwrite").parquet(f"{path}/districts")
    report.select("user", "locations").write.mode("overwrite").parquet(f"{path}/locations")
    report.select("user", "bids").write.mode("overwrite").parquet(f"{path}/bases")
