"""Helpers shared by the text operators: tables, scratch space, components."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.operators.scratch import place

#: The folder that holds the package.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Largest table, in rows, that an operator may broadcast after counting it.
MAX_BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder for intermediate tables: spark.checkpoint.dir, which only a local session may leave unset."""
    return place(spark, "trackloom")


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared scratch folder and read it back.

    Cuts the lineage without depending on executors: a lost executor costs a
    re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by cut()."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it has at most limit rows; df should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


#: Rows and bytes of an Arrow batch; one setting for all operators, as it holds for the session when a plan runs.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch, so a batch of long texts fits a worker.

    Also lets Python workers find this package where the driver found it; on a
    cluster without shared folders it is installed or sent with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment
    if HOME not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), HOME]))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b); returns (node, root), root the least node.

    Alternating large-star and small-star steps: each keeps the number of edges
    at or below the input's and the rounds grow with the logarithm of the
    longest path. A step is one partial aggregation and one join; a hub with a
    third of all edges is pre-aggregated map-side and its join side is an
    ordinary skewed join that adaptive execution splits. Nodes without edges
    are not in the result. Null ends are dropped, loops ignored.
    """
    spark = edges.sparkSession
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    if mark[0] == 0:
        return _rooted(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        drop_scratch(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return _rooted(now)
    raise RuntimeError("components did not settle")


def _rooted(stars: DataFrame) -> DataFrame:
    """(node, root) of each end of stars(u, v), roots included."""
    named = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return named.unionByName(named.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def row_keys(id_col: str, text):
    """Two hashes that tell rows apart by id and text; never null."""
    ident = F.col(id_col).cast("string")
    return F.xxhash64(ident, text).alias("k1"), F.xxhash64(F.lit(1), text, ident, F.lit(2)).alias("k2")


def let(value, body):
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """df with `no`, its rows' places 0, 1, ... in ascending order of keys (nulls first), and their number.

    A range partitioning sorts; the offsets of the partitions, one row for
    each, are all that is summed in one place.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_p")).count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    out = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn("no", F.col("_start") + low).drop("_p", "_at", "_start"), rows.count()
