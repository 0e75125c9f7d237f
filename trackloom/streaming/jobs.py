"""Streaming jobs: store ingest, per-window SQL, window history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.operators.joins import locate
from trackloom.sources.sinks import keyed


def ingest(gps: DataFrame, cells: DataFrame, path: str, checkpoint: str, trigger: str | None = None, outside: bool = False) -> StreamingQuery:
    """Locate each point in its cell and append it to the keyed store, a folder for each region.

    A batch is written to a folder of its own number, so that a batch run
    again after a failure replaces what it had written. Points outside all
    cells go to the folder `outside` if asked for.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = locate(batch, cells).persist()
        keyed(rows.where("cell_id >= 0")).write.mode("overwrite").partitionBy("region").parquet(f"{path}/batch={number}")
        if outside:
            rows.where("cell_id < 0").write.mode("overwrite").parquet(f"{path}-outside/batch={number}")
        rows.unpersist()

    writer = gps.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def each_batch_sql(gps: DataFrame, sql: str, sink: Callable[[DataFrame, int], None], checkpoint: str, view: str = "taxi_messages") -> StreamingQuery:
    """Run any SQL over the view of each micro-batch and hand the result to a sink."""

    def run(batch: DataFrame, number: int) -> None:
        batch.createOrReplaceTempView(view)
        sink(batch.sparkSession.sql(sql), number)

    return gps.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_windows(results: DataFrame, keep: int = 10) -> DataFrame:
    """Rows of the last `keep` windows of a table of window results."""
    starts = results.select("w_start").distinct().orderBy(F.desc("w_start")).limit(keep)
    return results.join(F.broadcast(starts), "w_start", "left_semi")


def to_memory(rows: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def to_console(rows: DataFrame, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("console").outputMode(mode).start()
