"""Readers: GPS lines, call logs, towers, shapes, indexes, stores, replay and synthetic data."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.geom import BOX, col, from_csv
from trackloom.operators.globalindex import MASTER

GPS = "time long, car_id int, lng float, lat float, speed int"


def gps_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """`time TAB car,lng,lat,speed` lines as (time, car_id, lng, lat, speed); the speed is truncated.

    A line without exactly one tab is an error when strict, else it is left out,
    as is a line with a field that is no number.
    """
    parts = F.split(column, "\t")
    checked = F.when(F.size(parts) != 2, F.raise_error(F.concat(F.lit("no GPS line: "), F.col(column)))).otherwise(parts) if strict else parts
    rows = lines.select(checked.alias("p")) if strict else lines.where(F.size(parts) == 2).select(parts.alias("p"))
    f = F.split(F.col("p")[1], ",")
    at = lambda i: F.get(f, F.lit(i))
    out = rows.select(
        F.col("p")[0].try_cast("long").alias("time"),
        at(0).try_cast("int").alias("car_id"),
        at(1).try_cast("float").alias("lng"),
        at(2).try_cast("float").alias("lat"),
        at(3).try_cast("float").cast("int").alias("speed"),
    )
    return out if strict else out.na.drop()


def call_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """`user,yyyy-MM-dd HH:mm:ss,tower` lines as (user, ts, sec, bid); lines without a readable time are left out."""
    f = F.split(column, ",")
    ts = F.try_to_timestamp(F.get(f, F.lit(1)), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = lines.where(F.size(f) >= 3).select(f[0].alias("user"), ts.alias("ts"), f[2].alias("bid")).where("ts is not null")
    return rows.withColumn("sec", F.unix_timestamp("ts"))


def gps_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return gps_lines(spark.read.text(path), strict=strict)


def call_logs(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """Gzipped logs under day=yyyymmdd folders; only the days asked for are listed and read."""
    logs = spark.read.schema("value string, day string").text(path)
    picked = logs.where(F.col("day").between(first_day, last_day))
    return call_lines(picked)


def recorded_days(spark: SparkSession, path: str, first_day: str, last_day: str) -> int:
    """Number of day folders in a range, without reading their files."""
    found = spark.read.schema("value string, day string").text(path).where(F.col("day").between(first_day, last_day))
    return found.select("day").distinct().count()


def towers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bid string, lon float, lat float, region int").csv(path, sep="\t")


def points(spark: SparkSession, path: str, sep: str = " ", encoding: str = "UTF-8") -> DataFrame:
    """`x y` lines; further columns are ignored, lines without two numbers left out."""
    return spark.read.schema("x double, y double").option("encoding", encoding).csv(path, sep=sep).na.drop()


def shapes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Text of points, rectangles (rect) or boxes (box), one shape a line, as columns."""
    return spark.read.text(path).select(from_csv("value", kind).alias("s")).select("s.*")


def lines_with_partition(spark: SparkSession, path: str, master: DataFrame) -> DataFrame:
    """Lines of a store's files beside the bounds of the partition that each file holds."""
    lines = spark.read.text(path).withColumn("filename", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1))
    return lines.join(master.select("filename", "space_id", *BOX), "filename", "left")


def index_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """`id TAB x1 y1 TAB x2 y2` lines as cells."""
    f = F.split(F.trim(column), r"[\t ]+")
    names = ("x1", "y1", "x2", "y2")
    return lines.where(F.size(f) >= 5).select(f[0].cast("int").alias("cell_id"), *(f[i + 1].cast("double").alias(n) for i, n in enumerate(names)))


def index_binary(spark: SparkSession, path: str) -> DataFrame:
    """Cells from a binary index: a count, then an int id and four doubles each, big-endian."""
    return _binary(spark, path, ("cell_id", "x1", "y1", "x2", "y2"))


def spaces_binary(spark: SparkSession, path: str) -> DataFrame:
    """Spaces with a third dimension from a binary file: a count, then an int id and six doubles each, big-endian."""
    return _binary(spark, path, ("space_id", *BOX))


def _binary(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    n = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("int")
    # The layout as a string, which every Python can send to its workers; a Struct cannot be pickled.
    record = f">i{len(names) - 1}d"
    size = struct.calcsize(record)
    cell = files.where(n > 0).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "content")
    cell = cell.select(F.expr(f"substring(content, 5 + i * {size}, {size})").alias("cell"))

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(struct.unpack(record, c) for c in b.column("cell").to_pylist()), strict=True)
            columns = [pa.array(r, pa.float64() if i else pa.int32()) for i, r in enumerate(rows)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, list(names))

    return cell.mapInArrow(decode, ", ".join(f"{c} {'double' if i else 'int'}" for i, c in enumerate(names)))


def sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """(time, rec) of a Hadoop sequence file of long keys and text values."""
    found = spark.sparkContext.sequenceFile(path, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return spark.createDataFrame(found, "time long, rec string")


def master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MASTER).parquet(f"{path}/_master")


def master_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Master table from `id,x1,y1,z1,x2,y2,z2,count,size,file` lines."""
    return lines.select(F.from_csv(column, MASTER).alias("m")).select("m.*")


def store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a partitioned store; filters on its partition column are pruned to folders."""
    return spark.read.parquet(f"{path}/data")


def store_count(spark: SparkSession, path: str) -> int:
    return store(spark, path).count()


def path_size(master_table: DataFrame) -> DataFrame:
    """Bytes of a store from its master table alone."""
    return master_table.agg(F.sum("size").alias("size"))


def replay_groups(rows: DataFrame, time: str = "time", value: str = "rec") -> DataFrame:
    """(time, recs): the records of each time, in order of time."""
    return rows.groupBy(time).agg(F.array_sort(F.collect_list(value)).alias("recs")).orderBy(time)


def replay_files(rows: DataFrame, path: str, files: int, time: str = "time") -> None:
    """Write at most `files` files in order of time, to be replayed as a stream one file for each trigger.

    A file stream takes files in order of their modification times, so these
    are set a second apart.
    """
    rows.repartitionByRange(files, time).sortWithinPartitions(time).write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {f.getPath().getName(): f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")}
    oldest = min((f.getModificationTime() for f in found.values()), default=0) - 1000 * len(found)
    for i, name in enumerate(sorted(found)):
        system.setTimes(found[name].getPath(), oldest + 1000 * i, -1)


def replay_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def socket_stream(spark: SparkSession, host: str = "localhost", port: int = 19999) -> DataFrame:
    """GPS lines from a text socket."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return gps_lines(lines, strict=False)


def random_points(spark: SparkSession, n: int, area, distribution: str = "uniform", seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(id, x, y, z) in a box (x1, y1, z1, x2, y2, z2); gaussian has a deviation of 0.2 of the half-width, cut at the edges."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    if distribution not in ("uniform", "gaussian"):
        raise ValueError(f"unknown distribution {distribution!r}")

    def place(i: int) -> Column:
        low, high = area[i], area[i + 3]
        if distribution == "uniform":
            return F.lit(low) + F.rand(seed + i) * (high - low)
        centred = F.greatest(F.least(F.randn(seed + i) * 0.2, F.lit(1.0)), F.lit(-1.0))
        return F.lit((low + high) / 2) + centred * ((high - low) / 2)

    return rows.select("id", *(place(i).alias(k) for i, k in enumerate("xyz")))


def random_boxes(spark: SparkSession, n: int, area, edge: int, seed: int = 1) -> DataFrame:
    """(id, x1..z2): boxes with whole edges from 2 to edge + 1, cut at the area."""
    low = random_points(spark, n, area, seed=seed)
    size = lambda i: F.floor(F.rand(seed + 10 + i) * edge) + 2
    high = [F.least(F.col(k) + size(i), F.lit(float(area[i + 3]))).alias(f"{k}2") for i, k in enumerate("xyz")]
    return low.select("id", *(F.col(k).alias(f"{k}1") for k in "xyz"), *high)


def web_lines(lines: DataFrame, host: str = "api.weixin.qq.com", field: int = 10, column: str = "value") -> DataFrame:
    """Tab-separated lines whose field (from 0) holds a host, in order."""
    f = F.split(col(column), "\t")
    return lines.where(F.get(f, F.lit(field)).contains(host)).orderBy(column)


def words(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.explode(F.split(column, " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def limits(rows: DataFrame) -> DataFrame:
    """Greatest and least x, y, z and the number of rows."""
    return rows.agg(*(F.max(k).alias(f"max_{k}") for k in "xyz"), *(F.min(k).alias(f"min_{k}") for k in "xyz"), F.count(F.lit(1)).alias("n"))
