"""Streams over the events table, run until they have read all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograin.params import Params
from lograin.plans import inputs
from lograin.session import scratch_path
from lograin.streaming import alerts, stats


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of entries, file by file.

    The table may be a file or a folder of files; a pattern as path serves both.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return inputs.event_lines(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


def _run(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    out = scratch_path(spark, name)
    writer = rows.writeStream.outputMode("append").format("parquet")
    writer = writer.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True)
    writer.start(out).awaitTermination()
    return spark.read.parquet(out)


def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, event_stream(spark, sf_dir), "entries")


def _finish(writer, out: str) -> None:
    writer.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()


def stream_log_stats(spark: SparkSession, sf_dir: str, params: Params) -> DataFrame:
    out = scratch_path(spark, "stats")
    _finish(stats.parts_writer(event_stream(spark, sf_dir), params, out), out)
    return stats.latest_rows(spark, out)


def ordered_feed(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    """The events as a stream of so many files, a file a micro-batch, each later in time than the one before."""
    entries, out = inputs.event_entries(spark, sf_dir), scratch_path(spark, "feed")
    cuts = entries.agg(F.percentile_approx("ts", [i / files for i in range(1, files)])).first()[0] or []
    # the lines are made once, by all tasks; only the copy of a piece into its file is one task's
    piece = sum((F.when(F.col("ts") > cut, 1).when(F.col("ts") <= cut, 0) for cut in cuts), F.lit(0))
    staged = scratch_path(spark, "pieces")
    entries.withColumn("piece", piece).write.partitionBy("piece").parquet(staged)
    rows = spark.read.schema(entries.withColumn("piece", piece.cast("int")).schema).parquet(staged)
    for number in range(len(cuts) + 1):
        rows.filter(F.col("piece") == number).drop("piece").coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(out)


def stream_alerts(spark: SparkSession, sf_dir: str, params: Params, files: int = 4) -> DataFrame:
    """Alerts that micro-batches give while the feed goes on, and those at its end."""
    out = scratch_path(spark, "alerts")
    _finish(alerts.alert_writer(ordered_feed(spark, sf_dir, files), params, out, delay="1 minute"), out)
    alerts.flush_alerts(spark, params, out)
    return alerts.stream_alerts(spark, out)


def stream_interval_reports(spark: SparkSession, sf_dir: str, params: Params, files: int = 4) -> DataFrame:
    """Report lines of every interval, written by the micro-batches that find it ended."""
    out = scratch_path(spark, "flushed")
    _finish(stats.parts_writer(ordered_feed(spark, sf_dir, files), params, out, delay="1 minute"), out)
    stats.flush(spark, out, params)
    lines = spark.read.text(f"{out}/reports", lineSep="\n")
    return lines.select(F.to_timestamp_ntz("window_start", F.lit("yyyy-MM-dd'T'HHmmss")).alias("window_start"), F.col("value").alias("line"))
