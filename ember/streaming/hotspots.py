"""Hotspot streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ember.operators.ranking import hotspot_cell
from ember.session import scratch


def stream_hotspots(
    stream: DataFrame, height: Column, width: Column, lateness: str = "1 hour", period: str = "1 day", time: str = "ts", carry: Sequence[str] = ("score",), ties: Sequence[str] = ()
) -> DataFrame:
    """One winning report per ground cell and period, by the rule of ``dedup_hotspots``.

    The best candidate of a cell is all that is kept of it; it leaves when the
    watermark, ``lateness`` behind the newest report, passes the end of the
    period, so state follows the arrival rate and not the history.  Later
    reports of a closed period are dropped.  Among reports of equal rank the
    smallest ``ties`` win, whatever the order of arrival.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    # naming the time keeps these filters above the watermark, which rows without a fire move as well
    timely = F.col(time).isNotNull()
    cells = hotspot_cell(timed.where(F.when(timely, F.col("valid")))).where(F.when(timely, F.col("shared_grid") | (F.col("cls") == 1)))
    context = F.least(F.col("rw") + 1, F.col("cl") + 1, height - F.col("rw"), width - F.col("cl"))
    rank = F.struct((-context).alias("p"), F.col("scene_id"), *ties)
    payload = F.struct("scene_id", "observed_at", "rw", "cl", "cls", *carry)
    won = cells.groupBy(F.window(time, period), "shared_grid", "cell_owner", "cell_row", "cell_col").agg(F.min_by(payload, rank).alias("_w"))
    return won.where(F.col("_w.cls") == 1).select(F.col("window.start").alias("period"), "shared_grid", "cell_owner", "cell_row", "cell_col", "_w.*").drop("cls")


def _drain(query: DataFrame, out: str, progress: str, mode: str) -> None:
    running = query.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start(out)
    running.awaitTermination()


def run_to_table(query: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table of the shared folder and read it back.

    Output and progress live in the checkpoint folder, so a restarted driver
    resumes instead of starting over.
    """
    spark: SparkSession = query.sparkSession
    out = scratch(spark, name)
    _drain(query, out, scratch(spark, f"{name}-progress"), mode)
    return spark.read.schema(query.schema).parquet(out)


def run_to_end(build: Callable[[DataFrame], DataFrame], events: DataFrame, time: str, name: str) -> DataFrame:
    """Like :func:`run_to_table` for a query that answers when the watermark passes.

    After the events are drained, one row far in the future arrives by a second
    source and moves the watermark past everything that still waits.  The row
    has nulls but for ``time``; what waits for it is never answered.
    """
    spark: SparkSession = events.sparkSession
    closing, out, progress = scratch(spark, f"{name}-closing"), scratch(spark, name), scratch(spark, f"{name}-progress")
    spark.createDataFrame([], events.schema).write.parquet(closing)
    query = build(events.unionByName(spark.readStream.schema(events.schema).parquet(closing)))
    _drain(query, out, progress, "append")
    last = [(F.to_timestamp(F.lit("2200-01-01")) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    spark.range(1).select(*last).write.mode("append").parquet(closing)
    _drain(query, out, progress, "append")
    return spark.read.schema(query.schema).parquet(out)
